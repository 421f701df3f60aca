"""From a question to its searches: variations by rules, a pool for each variation, filters and scans of named authors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import bound, query_terms, searchable, terms
from quern.operators.retrieval import RRF_K, top

MOST_TERMS, MOST_REVIEW_TERMS = 12, 30
MOST_FILTERS = 4
SCAN_QUOTA = 80


@dataclass(frozen=True)
class Rule:
    """If a folded question holds one word of every group, these variations and terms join it; a word between spaces is a whole one."""

    groups: tuple[tuple[str, ...], ...]
    variations: tuple[str, ...]
    terms: tuple[str, ...] = field(default=())


# The rules, the phrases of a request for a review, and the topics that a review covers.
RULES = (
    Rule((("fmea", "fmeca"),), ("analise de modos e efeitos de falha", "failure mode and effects analysis", "risk priority number rpn npr criticality")),
    Rule((("weibull", "rul"),), ("confiabilidade weibull vida util remanescente", "reliability weibull remaining useful life mttf b10")),
    Rule((("autoencoder", "anomalia"),), ("detector de anomalias por erro de reconstrucao", "autoencoder anomaly detection reconstruction error")),
    Rule((("inversor", "fotovoltaic", " pv "),), ("inversor fotovoltaico falhas componentes", "PV inverter failure modes reliability")),
    Rule(
        (("anomalia", "anomaly", "deteccao", "detection"), ("inversor", "inverter", "fotovoltaico", "photovoltaic", "pv")),
        ("anomaly detection solar PV inverter isolation forest autoencoder", "Ahirwar Francisti Ibrahim Sharma Ghoneim anomaly detection PV inverter"),
        ("ahirwar", "francisti", "ibrahim", "sharma", "ghoneim", "anomaly", "detection", "inverter"),
    ),
    Rule((("rcm", "manutencao"),), ("manutencao centrada em confiabilidade RCM", "reliability centered maintenance preventive predictive")),
    Rule((("paderborn",),), ("Paderborn dataset IGBT three phase inverter Stender", "data set description three phase IGBT two level inverter"), ("stender", "igbt", "data", "set", "description")),
)
REVIEW_MARKS = (
    "literatura completa", "literatura toda", "revisao bibliografica", "revisao da literatura", "estado da arte", "todos os artigos",
    "todas as fontes", "todas as referencias", "todos os autores", "panorama", "sintese da literatura", "survey", "review",
    "literatura da dissertacao", "literatura do mestrado", "literatura sobre", "cite a literatura", "cite as referencias", "cite as fontes",
    "cite artigos", "cite papers", "cite os artigos", "cite os autores", "citar artigos", "liste artigos", "listar artigos",
    "completa da dissertacao", "fundamentacao teorica", "referencial teorico", "bibliografia completa",
)
REVIEW_TOPICS = (
    "FMEA FMECA failure mode and effects analysis criticality NPR RPN",
    "RCM reliability centered maintenance manutencao centrada em confiabilidade",
    "inversor fotovoltaico on-grid trifasico PV inverter falhas",
    "autoencoder anomaly detection erro de reconstrucao normalidade",
    "machine learning fault detection PV inverter diagnostico",
    "Weibull RUL remaining useful life MTTF B10 confiabilidade",
    "filtro LCL IGBT capacitor contactor sensor CA inversor",
    "manutencao preditiva monitoramento de condicao prognostico",
    "harmonicos THD sinais eletricos CA inversor fotovoltaico",
    "isolation forest random forest XGBoost classificacao falhas PV",
    "dataset GPVS-Faults microrede fotovoltaica inversor falhas F0 F1 F7",
    "FMECA NPR criticidade inversor lado CA componente critico",
)


def strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def expand(questions: DataFrame, rules: tuple[Rule, ...] = RULES, marks: tuple[str, ...] = REVIEW_MARKS, topics: tuple[str, ...] = REVIEW_TOPICS) -> DataFrame:
    """questions (query, text) with ``review``, ``variations`` (the question first, each once) and ``terms``; rules are read within the row."""

    def work(plain: Column) -> Column:
        has = lambda word: F.contains(plain, F.lit(word))
        has_any = lambda words: F.lit(False) if not words else any_of([has(w) for w in words])
        review = has_any(marks)
        fired = [(all_of([has_any(g) for g in r.groups]), r) for r in rules]
        more = [F.when(hit, strings(r.variations)).otherwise(strings(())) for hit, r in fired]
        words = [F.when(hit, strings(r.terms)).otherwise(strings(())) for hit, r in fired if r.terms]
        broad = list(dict.fromkeys(w.lower() for t in topics for w in t.split() if len(w) > 3))
        more.append(F.when(review, strings(topics)).otherwise(strings(())))
        words.append(F.when(review, strings(broad)).otherwise(strings(())))
        told = F.array_distinct(F.concat(query_terms(F.col("text"), 10_000), *words))
        return F.struct(
            review.alias("review"),
            F.array_distinct(F.concat(F.array(F.coalesce("text", F.lit(""))), *more)).alias("variations"),
            F.slice(F.coalesce(told, strings(())), F.lit(1), F.when(review, MOST_REVIEW_TERMS).otherwise(MOST_TERMS)).alias("terms"),
        )

    plain = F.concat(F.lit(" "), F.coalesce(searchable(F.col("text")), F.lit("")), F.lit(" "))
    return questions.select("query", "text", bound(plain, work).alias("_w")).select("query", "text", "_w.*")


def any_of(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def all_of(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def variation_queries(expanded: DataFrame, pool: int = 60, least: int = 10, most: int = 50) -> DataFrame:
    """(query, variation, term, cap): the distinct terms of each variation, and how many hits it may bring."""
    rows = expanded.select("query", F.size("variations").alias("_n"), F.posexplode("variations").alias("variation", "_text"))
    cap = F.least(F.greatest(F.lit(least), F.floor(F.lit(pool) / F.col("_n"))), F.lit(most)).cast("int")
    return rows.select("query", "variation", cap.alias("cap"), F.explode(F.array_distinct(terms(F.col("_text")))).alias("term"))


def pooled(hits: DataFrame, n: int) -> DataFrame:
    """(query, item, score, best, variations, place): hits (query, variation, item, rank) of all variations in one pool, by the sum of their reciprocal ranks."""
    one = hits.groupBy("query", "item").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.array_sort(F.collect_set("variation")).alias("variations"))
    return top(one, "query", [F.desc(F.round("score", 12)), F.asc("item")], n, "place")


def author_filters(asked: DataFrame, authors: DataFrame, most: int = MOST_FILTERS) -> DataFrame:
    """(query, author, token, place): the authors (token, author) that a question's tokens (query, token) name, the first ``most`` by token and then author."""
    named = asked.distinct().join(authors.distinct(), "token").groupBy("query", "author").agg(F.min("token").alias("token"))
    return top(named, "query", [F.asc("token"), F.asc("author")], most, "place")


def author_scan(filters: DataFrame, chunks: DataFrame, quota: int = SCAN_QUOTA) -> DataFrame:
    """(query, author, file, chunk, rank): the first ``quota`` chunks (author, file, chunk) of every file of each named author, so that none is crowded out.

    Files are cut to their quota before any question meets them.
    """
    first = top(chunks, ["author", "file"], [F.asc("chunk")], quota)
    return filters.select("query", "author").distinct().join(first, "author")


def spread_by_file(scanned: DataFrame, n: int) -> DataFrame:
    """The first n chunks a question with ``place``: the first of every file, then the second of every file, and so on."""
    w = Window.partitionBy("query").orderBy("rank", "author", F.asc_nulls_last("file"), "chunk")
    return scanned.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
