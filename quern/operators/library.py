"""A note and document library: sections, names, gold sets, memories, inventories, fused search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import fold, searchable, terms

# Search terms and what else they may be called, in the languages served.
SYNONYMS = {"house": ["home", "maison", "haus", "casa"], "day": ["jour", "tag", "dia"], "time": ["temps", "zeit", "tiempo"], "world": ["monde", "welt", "mundo"]}
# Headings that open a list of references.
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "referencias", "literatur"]


def stripped(text: Column) -> Column:
    """text without white space, line ends included, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def expanded(found: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Search terms, each followed by its synonyms in either direction, once each and in order."""
    others: dict[str, list[str]] = {}
    for word, same in (SYNONYMS if synonyms is None else synonyms).items():
        group = [word, *same]
        for w in group:
            others.setdefault(w, []).extend(x for x in group if x != w)
    known = F.create_map(*[part for w, same in sorted(others.items()) for part in (F.lit(w), F.array(*[F.lit(x) for x in same]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(known, t), none)))))


def note_terms(text: Column) -> Column:
    """Distinct terms of a note: three characters or more of letters, digits, hyphens and underscores, the first no sign."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0)))


def without_references(text: Column) -> Column:
    """A text up to the first line that is a heading of references."""
    heading = "(?im)^[#\\s\\d.]*(" + "|".join(REFERENCE_HEADINGS) + ")\\s*:?\\s*$"
    return F.regexp_replace(F.element_at(F.split(text, heading, 2), 1), r"\s+$", "")


def sections(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, level, trail, body) of Markdown notes, cut at headings; trail names the headings above, outermost first.

    Text before the first heading is section 0 of level 0. A note is one row; its sections are ordered within it.
    """
    parts = F.split(F.col(text), r"(?m)^(?=#{1,6} )")
    cut = notes.select(key, F.posexplode(F.filter(parts, lambda p: stripped(p) != "")).alias("section", "part"))
    head = F.regexp_extract("part", r"^(#{1,6}) +([^\n]*)", 2)
    level = F.char_length(F.regexp_extract("part", r"^(#{1,6}) ", 1))
    own = cut.select(key, "section", level.alias("level"), F.trim(head).alias("title"), stripped(F.regexp_replace("part", r"^#{1,6} +[^\n]*\n?", "")).alias("body"))
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    # the last heading of each level so far counts if no heading of a lower level came after it
    last = [F.max(F.when(F.col("level") == k, F.struct("section", "title"))).over(before) for k in range(1, 7)]
    seen = own.select("*", *[c.alias(f"_h{k}") for k, c in enumerate(last, 1)])

    def stands(k: int) -> Column:
        ok = F.lit(k) <= F.col("level")
        for j in range(1, k):
            ok = ok & F.coalesce(F.col(f"_h{j}.section") < F.col(f"_h{k}.section"), F.lit(True))
        return ok

    trail = F.array(*[F.when(stands(k), F.col(f"_h{k}.title")) for k in range(1, 7)])
    return seen.select(key, "section", "level", F.array_compact(trail).alias("trail"), "body")


def gold_errors(gold: DataFrame, least: int = 12) -> DataFrame:
    """(id, errors) of gold questions (id, question, relevance, evidence): sorted codes, empty where a question is sound.

    A question is sound if its id and its wording are its own, it is long enough, it has evidence, and its relevances lie in 1 to 3.
    """
    keyed = gold.withColumn("_q", searchable(F.col("question")))
    same_id, same_text = keyed.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_ids")), keyed.groupBy("_q").agg(F.count("*").alias("_texts"))
    rows = keyed.join(same_id, F.col("id").eqNullSafe(F.col("_id")), "left").join(same_text, "_q", "left")
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    errors = F.array(
        code(F.coalesce(F.col("_ids") > 1, F.lit(False)), "duplicate_id"),
        code(F.coalesce(F.col("_texts") > 1, F.lit(False)), "duplicate_question"),
        code(F.char_length("_q") < least, "short_question"),
        code(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence"),
        code(~F.col("relevance").between(1, 3), "relevance"),
    )
    return rows.select("id", F.array_sort(F.array_compact(errors)).alias("errors"))


def memory_states(memories: DataFrame) -> DataFrame:
    """memories (memory, topic, created, content) with ``state``.

    The newest of a topic is active and supersedes the others; a memory whose folded content
    its topic already held is a duplicate, whatever its age.
    """
    signed = memories.withColumn("signature", F.sha2(searchable(F.col("content")), 256))
    first = F.row_number().over(Window.partitionBy("topic", "signature").orderBy("created", "memory"))
    marked = signed.withColumn("_again", first > 1)
    newest = F.row_number().over(Window.partitionBy("topic", "_again").orderBy(F.desc("created"), F.desc("memory")))
    state = F.when(F.col("_again"), "duplicate").when(F.col("_newest") == 1, "active").otherwise("superseded")
    return marked.withColumn("_newest", newest).withColumn("state", state).drop("_again", "_newest", "signature")


def level_hits(hits: DataFrame, expected: DataFrame, levels: list[str], k: int) -> DataFrame:
    """(query, level, hit, mrr) at k: hits (query, rank, levels...) against expected (query, levels...), level by level."""
    out = None
    for level in levels:
        wanted = expected.select("query", level).distinct()
        found = hits.where(F.col("rank") <= k).join(wanted, ["query", level]).groupBy("query").agg(F.min("rank").alias("first"))
        one = expected.select("query").distinct().join(found, "query", "left").select("query", F.lit(level).alias("level"), F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))
        out = one if out is None else out.unionByName(one)
    return out


def capped(hits: DataFrame, query: str, note: str, rank: str, cap: Column) -> DataFrame:
    """hits with at most ``cap`` of one note a query, the best ranked."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(query, note).orderBy(rank))).where(F.col("_k") <= cap).drop("_k")


def newest(items: DataFrame, group: str, order: list[Column], n: int = 10) -> DataFrame:
    """The first n items of each group in an order, with ``place`` and how many the group has: counted, never guessed from what was found."""
    w = Window.partitionBy(group)
    placed = items.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return placed.where(F.col("place") <= n).join(items.groupBy(group).agg(F.count("*").alias("held")), group)


def chunk_id(content: Column, number: Column) -> Column:
    """The id of a chunk: the hash of its file and its five-digit number."""
    return F.concat(F.sha2(content, 256), F.lit("__chunk_"), F.lpad(number.cast("string"), 5, "0"))


def shown_p_value(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "–").when(p < 0.001, "<0.001").otherwise(F.format_number(p, 3))


def greeting(hour: Column) -> Column:
    return F.when(hour < 5, "good night").when(hour < 12, "good morning").when(hour < 18, "good afternoon").otherwise("good evening")


def query_terms_of(text: Column) -> Column:
    """Terms of a query and their synonyms."""
    return expanded(F.array_distinct(terms(text)))
