"""Conversation journals, inventories, memories and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import query_terms
from quern.sources.shared import staged


def last_turns(turns: DataFrame, conv: str, turn: str, n: int) -> DataFrame:
    """The last n turns of each conversation, oldest first by ``place``."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def transcripts(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, transcript): role and text of every turn in order; a conversation is one document by contract."""
    line = F.concat(F.lit("**"), F.col(role), F.lit("**: "), F.coalesce(text, F.lit("")))
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line")))).alias("v"))
    return rows.select(conv, F.array_join(F.transform("v", lambda x: x["line"]), "\n\n").alias("transcript"))


def parse_transcript(docs: DataFrame, text: str) -> DataFrame:
    """docs with one row a turn of a transcript: turn, role, content."""
    parts = F.filter(F.split(text, r"(?m)^(?=\*\*\w+\*\*: )"), lambda x: x.rlike(r"^\*\*\w+\*\*: "))
    rows = docs.select("*", F.posexplode(parts).alias("turn", "part"))
    return rows.withColumn("role", F.regexp_extract("part", r"^\*\*(\w+)\*\*: ", 1)).withColumn("content", F.trim(F.regexp_replace("part", r"^\*\*\w+\*\*: ", ""))).drop("part")


def state_of(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key: the present state of an append-only log."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s")).select(key, "s.*")


def to_consolidate(sessions: DataFrame, today: Column, friday: bool = True) -> DataFrame:
    """Sessions (session, day, interactions, n_chars) with ``due``: on Fridays, from 15 interactions, or three days old; short ones never."""
    on_friday = (F.dayofweek(today) == 6) if friday else F.lit(False)
    due = on_friday | (F.col("interactions") >= 15) | (F.datediff(today, "day") >= 3)
    return sessions.withColumn("due", due & (F.col("n_chars") > 200))


def inventory(disk: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, on_disk, indexed) of everything seen in either."""
    d, i = disk.select(key).distinct().withColumn("on_disk", F.lit(True)), index.select(key).distinct().withColumn("indexed", F.lit(True))
    no = F.lit(False)
    return d.join(i, key, "full").select(key, F.coalesce("on_disk", no).alias("on_disk"), F.coalesce("indexed", no).alias("indexed"))


def recall_memories(queries: DataFrame, memories: DataFrame, n: int) -> DataFrame:
    """(query, memory, score): memories by summed ln((N + 1) / (df + 0.5)) of the terms they share; the n best, newer ids first among equals."""
    m = memories.select("memory", F.explode(query_terms(F.col("text"), 10_000)).alias("term"))
    q = queries.select("query", F.explode(query_terms(F.col("text"), 10_000)).alias("term"))
    total = memories.count()
    wanted = m.join(q.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    s = wanted.join(df, "term").join(q, "term").groupBy("query", "memory").agg(F.sum(F.log((total + 1.0) / (F.col("df") + 0.5))).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.desc("memory"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def related(items: DataFrame, least: int, n: int) -> DataFrame:
    """(item, other, shared, rank): the n items that share the most terms, ``least`` or more.

    Two items that share so many also share one outside the least - 1 commonest terms of each, so only
    those meet; what a pair shares is counted from the two lists of terms.
    """
    t = items.select("item", F.explode(query_terms(F.col("text"), 10_000)).alias("term")).where(F.char_length("term") >= 4)
    telling = t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= 2)
    lists = t.join(telling, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("v"))  # the terms of one item
    lists = staged(lists.select("item", F.transform("v", lambda x: x["term"]).alias("terms")).where(F.size("terms") >= least), "related-terms")
    rare = lists.select("item", F.explode(F.slice("terms", F.lit(1), F.size("terms") - (least - 1))).alias("term"))
    met = rare.join(rare.withColumnRenamed("item", "other"), "term").where("item < other").select("item", "other").distinct()
    both = met.join(lists.withColumnRenamed("terms", "a"), "item").join(lists.select(F.col("item").alias("other"), F.col("terms").alias("b")), "other")
    pairs = both.select("item", "other", F.size(F.array_intersect("a", "b")).cast("long").alias("shared")).where(F.col("shared") >= least)
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("item"), F.col("item").alias("other"), "shared"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("shared"), "other"))).where(F.col("rank") <= n)


def rule(text: Column, rules: list[tuple[str, str]], none: str) -> Column:
    """The name of the first rule whose pattern the text matches."""
    out = F.lit(none)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def numbered(rows: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """rows numbered from 1 in an order: ranges are numbered apart, and only one count a range meets in a single task."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    before = parts.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(before, "_part").withColumn(into, F.col("_before") + inside).drop("_part", "_before")
