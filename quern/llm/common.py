"""What the training-data operators share: word rules, let-binding, and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16  # of a Bloom filter
PROBES = 4
BROADCAST_BLOCKS = 1_000_000  # of 16 bytes: a filter up to this size is sent to all executors

#: Characters that part words: space, and tab to carriage return.
BREAKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session without one (tests) gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder; on a cluster all executors must share one")
    return tempfile.gettempdir() + "/quern-checkpoints"


def stage_root(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's staged tables; call it when no result that reads them is needed any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def bits52(*parts: Column) -> Column:
    """A repeatable number of 52 bits from the parts, by their md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows by the order of a hash of doc_id, the same on every run.

    A threshold on the hash first leaves about a quarter more than that, so what meets
    in one task to be ordered does not grow with the rows.
    """
    n, span = rows.count(), 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    share = min(1.0, (1.25 * most + 100) / max(n, 1))
    return rows.where(place < int(share * span)).orderBy(place, "doc_id").limit(most)


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_mask(key: Column) -> Column:
    """Four bits of a 64-bit block, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def bloom_blocks(entries: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The filter of entries (key) as rows (block, filter) and its number of blocks, at most ``most``."""
    blocks = max(16, entries.count() * BITS_PER_KEY // 64)
    blocks = min(blocks, most) if most else blocks
    return entries.select(bloom_block(F.col("key"), blocks).alias("block"), bloom_mask(F.col("key")).alias("m")).groupBy("block").agg(F.bit_or("m").alias("filter")), blocks
