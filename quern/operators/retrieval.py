"""Retrieval: BM25 postings, vector neighbours, rank fusion, diversification, packing, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import once, terms
from quern.operators import vectors as V

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60


def tokenised(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, t, len) of a corpus; its terms are worked out once a document."""
    return once(docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")), t=terms(F.col("_text"))).select("doc", "t", F.size("t").alias("len"))


def postings(tokens: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, len) of a tokenised corpus; with wanted (term), only those terms leave the scan."""
    rows = tokens.select("doc", "len", F.explode("t").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and mean length in terms."""
    return docs.select(F.size(terms(F.col(text))).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))


def bm25(docs: DataFrame, doc: str, text: str, queries: DataFrame) -> DataFrame:
    """(query, doc, score, matched) for queries (query, term): sums over the query's terms, higher is better, and how many of them the document has."""
    post = postings(tokenised(docs, doc, text), queries)
    df = post.groupBy("term").agg(F.count("tf").alias("df"))  # reads tf too, so that Spark reuses the exchange of post
    stats = corpus_stats(docs, text).first()  # two numbers
    n, mean = stats["n_docs"], stats["mean_len"] or 1.0
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = post.join(df, "term").select("term", "doc", weight.alias("w"))
    return scored.join(queries.select("query", "term").distinct(), "term").groupBy("query", "doc").agg(F.sum("w").alias("score"), F.count("*").alias("matched"))


def top(df: DataFrame, group: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def nearest(queries: DataFrame, vectors: DataFrame, n: int, same: tuple[str, str] | None = None) -> DataFrame:
    """(query, vec_id, similarity, rank): exact neighbours by cosine of stated queries (query, q), other than themselves; ``same`` names a column of each that must be equal."""
    index = V.build(V.sane(vectors, "vec_id", "embedding", same[1] if same else None))
    return index.search(V.sane(queries, "query", "q", same[0] if same else None), n)


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query, item, source, weight, rank): score and sorted sources."""
    return ranked.groupBy("query", "item").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def diversify(items: DataFrame, query: str, source: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """n items a query with at most ``cap`` of one source, relaxed evenly where too few sources exist."""
    by_source = F.row_number().over(Window.partitionBy(query, source).orderBy(*order))
    by_score = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    tagged = items.withColumn("source_rank", by_source).withColumn("score_rank", by_score)
    return top(tagged, query, [F.greatest(F.col("source_rank"), F.lit(cap)), F.col("score_rank")], n, "place")


def round_robin(items: DataFrame, query: str, source: str, rank: str) -> DataFrame:
    """items with ``place``: one of each source in turn, sources by their first appearance."""
    by_source = Window.partitionBy(query, source)
    tagged = items.withColumn("source_rank", F.row_number().over(by_source.orderBy(rank))).withColumn("source_first", F.min(rank).over(by_source))
    return tagged.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("source_rank", "source_first")))


def pack(items: DataFrame, query: str, place: str, length: str, budget: int, least: int = 300) -> DataFrame:
    """items with ``used`` characters: whole blocks while they fit, the next one cut if more than ``least`` remain."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(query).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - F.col("before")
    used = F.when(F.col(length) <= room, F.col(length)).when(room > least, room).otherwise(0)
    return items.withColumn("before", before).withColumn("used", used.cast("long")).drop("before")


def neighbours(chunks: DataFrame, seeds: DataFrame, group: str, place: str, share: float = 0.85) -> DataFrame:
    """Chunks next to seeds (group, place, score) that are no seeds themselves, at a share of the best seed's score."""
    near = seeds.select(group, "score", F.explode(F.array(F.col(place) - 1, F.col(place) + 1)).alias(place))
    best = near.groupBy(group, place).agg(F.max("score").alias("seed")).join(seeds.select(group, place), [group, place], "left_anti")
    return chunks.join(best, [group, place]).withColumn("score", F.col("seed") * share).drop("seed")


def rerank_score(rrf: Column, overlap: Column, same_author: Column, same_year: Column, folder_weight: Column, textbook: Column) -> Column:
    """The heuristic score: fusion times thirty, lexical overlap, metadata matches, folder weight, textbook penalty."""
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    return rrf * 30 + overlap + flag(same_author, 6.0) + flag(same_year, 3.0) + folder_weight + flag(textbook, -12.0)
