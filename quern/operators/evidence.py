"""Evidence packages, claim validation, anchored graphs and path search, metrics of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import markers, once, searchable, terms


def package(items: DataFrame, query: str, order: str, excluded: list[str]) -> DataFrame:
    """items with ``evidence`` E1, E2, ... a query; incomplete ones and excluded source types are left out."""
    good = items.where("document_id is not null and coalesce(raw_text, '') <> ''").where(~F.coalesce(F.col("source_type").isin(excluded), F.lit(False)))
    return good.withColumn("evidence", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(query).orderBy(order))))


def validate_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (claim, ids, level, page, year, quote) with ``errors``, sorted codes; empty if all is grounded.

    evidence is (evidence, pages, year, raw_text). Page, year and quote must be found in one of the cited pieces.
    """
    cited = claims.select("claim", F.explode_outer(F.array_distinct("ids")).alias("evidence"))
    found = cited.join(evidence, "evidence", "left")
    facts = found.groupBy("claim").agg(
        F.count("evidence").alias("n"),
        F.count_if(F.col("evidence").isNotNull() & F.col("raw_text").isNull()).alias("unknown"),
        F.flatten(F.collect_list("pages")).alias("pages"),
        F.collect_set("year").alias("years"),
        F.collect_list(searchable(F.col("raw_text"))).alias("texts"),
    )
    quote = searchable(F.col("quote"))
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), name)
    errors = F.array(
        code(F.col("n") == 0, "no_evidence"),
        code(F.col("unknown") > 0, "unknown_evidence"),
        code(~F.col("level").isin("direct", "indirect", "inference"), "bad_level"),
        code(F.col("page").isNotNull() & ~F.array_contains("pages", F.col("page")), "page"),
        code(F.col("year").isNotNull() & ~F.array_contains("years", F.col("year")), "year"),
        code(F.col("quote").isNotNull() & ~F.exists("texts", lambda t: t.contains(quote)), "quote"),
    )
    return claims.join(facts, "claim").withColumn("errors", F.array_sort(F.array_compact(errors))).select("claim", "errors")


def check_answer(answer: Column, known: Column) -> Column:
    """unknown and missing markers of an answer, and whether it should be withheld."""
    used = markers(answer)
    unknown = F.array_except(used, known)
    return F.struct(unknown.alias("unknown"), F.array_except(known, used).alias("missing"), ((F.size(used) == 0) | (F.size(unknown) > 0)).alias("withhold"))


def alias_edges(chunks: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(src, dst, relation, chunks): entities of taxonomy (entity, alias) tied to the documents whose text names an alias as whole words.

    Aliases of any number of words are met by equality on runs of that many words, so no text meets every alias.
    """
    aliases = once(taxonomy, a=terms(F.col("alias"))).where(F.size("a") > 0).select("entity", F.array_join("a", " ").alias("alias"), F.size("a").alias("n"))
    lengths = sorted(r["n"] for r in aliases.select("n").distinct().collect())  # how many words aliases have

    def runs(words: Column, n: int) -> Column:
        last = F.size(words) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))) if n > 1 else words

    words = once(chunks, w=terms(F.col("text"))).select("doc_id", "chunk_id", "w")
    found = words.select("doc_id", "chunk_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(runs(F.col("w"), n), F.array().cast("array<string>")) for n in lengths]))).alias("alias"))
    named = found.join(aliases, "alias")
    return named.groupBy(F.concat(F.lit("entity:"), "entity").alias("src"), F.concat(F.lit("document:"), "doc_id").alias("dst")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks")).withColumn("relation", F.lit("SUPPORTED_BY"))


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, path, n): paths of up to ``hops`` edges (src, dst) that visit no node twice."""
    at = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    out = None
    for _ in range(hops):
        step = at.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst").distinct(), "src")
        at = step.where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path"))
        out = at if out is None else out.unionByName(at)
    return out.withColumn("n", F.size("path") - 1)


def ranking_metrics(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, hit, mrr, ndcg) at k from hits (query, item, rank) and wanted (query, item)."""
    wanted = wanted.distinct()
    return counted_metrics(hits.join(wanted, ["query", "item"]), wanted.groupBy("query").agg(F.count("*").alias("need")), k)


def counted_metrics(good: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """The same from the good hits alone (query, rank) and how many there could be (query, need): nothing wanted is written out.

    Precision divides by k even where fewer were returned; the reciprocal rank is cut at k.
    """
    got = good.where(F.col("rank") <= k).groupBy("query").agg(F.count("*").alias("got"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("need", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = need.where("need > 0").join(got, "query", "left")
    return out.select("query", zero(F.col("got") / F.col("need")).alias("recall"), zero(F.col("got") / k).alias("precision"), zero((F.col("got") > 0).cast("double")).alias("hit"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def grouped_gains(hits: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, mrr, dcg, ndcg) at k where each evidence group (query, grp, item, relevance) scores once, at its first hit.

    A group's relevance is the highest of its items and its gain 2**relevance - 1; the ideal order has the most relevant groups first.
    """
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1.0)
    whole = groups.groupBy("query", "grp").agg(F.max("relevance").alias("relevance"))
    first = hits.where(F.col("rank") <= k).join(groups.select("query", "item", "grp").distinct(), ["query", "item"]).groupBy("query", "grp").agg(F.min("rank").alias("rank"))
    got = first.join(whole, ["query", "grp"]).groupBy("query").agg(F.count("*").alias("got"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    best = whole.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "grp")))
    need = best.groupBy("query").agg(F.count("*").alias("need"), F.sum(F.when(F.col("rank") <= k, gain)).alias("ideal"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = need.join(got, "query", "left")
    return out.select("query", zero(F.col("got") / F.col("need")).alias("recall"), zero(F.col("got") / k).alias("precision"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg")).alias("dcg"), zero(F.try_divide("dcg", "ideal")).alias("ndcg"))


def greedy_assignment(cells: DataFrame, query: str) -> DataFrame:
    """One-to-one assignment along the ranks: each hit takes the free group it matches with the highest relevance.

    cells is (query, rank, groups: array<struct<relevance, grp>>); groups are few a query, the fold runs within its row.
    """
    rows = cells.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "groups"))).alias("v"))
    fold = """aggregate(v, cast(array() as array<struct<rank:int,grp:bigint,relevance:int>>), (acc, x) ->
      transform(array(array_max(filter(x.groups, g -> not exists(acc, a -> a.grp = g.grp)))), b ->
        if(b is null, acc, concat(acc, array(named_struct('rank', cast(x.rank as int), 'grp', cast(b.grp as bigint), 'relevance', cast(b.relevance as int))))))[0])"""
    return rows.select(query, F.explode(F.expr(fold)).alias("m")).select(query, "m.*")
