"""Importance resampling towards a target corpus, by hashed counts of words and word pairs.

First pass: every partition counts its features in a vector of ``BUCKETS`` numbers
(np.bincount), and treeReduce adds these vectors, so the driver gets one of 80 KB for
the raw texts and one for the target texts. From both comes one gain a bucket. Second
pass: each text gathers the broadcast gains of its features and sums them by document
(bincount with weights); its weight is their mean. A repeatable Gumbel number of the
doc_id is added, and the highest scores are drawn, which samples without replacement
in proportion to the importance weights. Only (doc_id, counts, score) move, once, to be
numbered in order; texts stay where they are.

Words are runs of digits, a-z (A-Z lower-cased) and of all characters above ASCII, which
in UTF-8 are the bytes from 0x80 on, so texts are cut as bytes. The checksum of a pair
goes on from that of its first word.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; a
text is read in stretches of about a megabyte, whatever its length; a null doc_id draws
its number as an empty id and comes last among equal scores; rows that share doc_id and
score stand in any fixed order; without documents the result is empty, without target
texts all target counts are 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
STRETCH = 1 << 20  # bytes of a text that are cut into words at a time
HELD = 1 << 18  # features that are held before they are summed

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCORED = "doc_id long, n_words long, n_features long, weight long"


def stretches(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, checksums of words and pairs) of a text, a stretch at a time."""
    plain, at, last = text.translate(PLAIN), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + STRETCH)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if words:
            ones = list(map(crc32, words))
            firsts = map(crc32, repeat(b" "), chain([] if last is None else [last], ones))
            pairs = map(crc32, islice(words, int(last is None), None), firsts)
            last = ones[-1]
            yield len(words), np.fromiter(chain(ones, pairs), np.uint32)


def encoded(column: pa.Array) -> Iterator[bytes]:
    return (b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: its features by bucket."""
    total, held, n = np.zeros(BUCKETS, np.int64), [], 0
    for batch in batches:
        for text in encoded(batch.column(0)):
            for _, found in stretches(text):
                held.append(found % BUCKETS)
                n += len(found)
                if n >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts (text) by bucket."""
    parts = texts.mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the raw share), one added to each count."""
    whole, wanted = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = (target + 1.0) * whole / ((raw + 1.0) * wanted)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.float64)


def weigher(gains):
    """mapInArrow function from (doc_id, text) to SCORED; gains is a broadcast of one number a bucket."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = gains.value
        for batch in batches:
            rows = batch.num_rows
            words, features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            held, owners, n = [], [], 0

            def add() -> None:
                if held:
                    sizes = [len(f) for f in held]
                    total[:] += np.bincount(np.repeat(owners, sizes), weights=by_bucket[np.concatenate(held) % BUCKETS], minlength=rows)
                    held.clear()
                    owners.clear()

            for i, text in enumerate(encoded(batch.column(1))):
                for k, found in stretches(text):
                    words[i] += k
                    features[i] += len(found)
                    held.append(found)
                    owners.append(i)
                    n += len(found)
                    if n >= HELD:
                        add()
                        n = 0
            add()
            weight = total.astype(np.int64) // np.maximum(features, 1)  # sums of whole numbers below 2**53 are exact
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return sums


def gumbel(doc_id, seed: int):
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of sha256("seed:doc_id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, score, ...) with ``place`` 1, 2, ... by falling score, then doc_id, then the rest.

    Ranges are numbered apart, each from the rows of the ranges before it; only one count a range meets in one task.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("tie")]
    # how rows fall into ranges depends on a sample, so the ranges are written before they are counted
    parts = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-ranges")
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs; target has (text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(texts.select("text")), bucket_counts(target.select(F.col("text").cast("string").alias("text")))))
    weighed = texts.mapInArrow(weigher(gains), SCORED)
    scored = stage(weighed.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")).withColumn("tie", F.monotonically_increasing_id()), "resample-scores")
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    shown = ["doc_id", "n_words", "n_features", "weight", "score"]
    able = ranked(scored.where(F.col("n_words") >= least_words)).select(*shown, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
    return able.union(scored.where(F.col("n_words") < least_words).select(*shown, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark texts; a quarter of those of 20 words or more is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")).drop("n_words")
