"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts lie next to
each other and a group too large for one shard is split inside by doc_id. The
splitters are found without sorting: each round counts the exact bytes below
candidate boundaries (a grid inside the range that holds the wanted byte) over all
partitions, and refines that range until it holds one row or is within tolerance.
Only counts of at most (shards - 1) * 4,096 ranges reach the driver. Then the rows
are exchanged once, by ranges small enough to number in parallel.

Defined cases: a null text has no bytes, size 8 and checksum 0; a null doc_id is a
key of its own; exact repeats of a row share a key and a shard; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage

SHARDS = 24
KEY_BITS = 60
STEP = 12


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sort_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two halves of the sort key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        _hash60(text).alias("hi"),
        _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))).alias("lo"),
    )


def splitters(keyed: DataFrame, shards: int, tolerance: int = 0) -> list[tuple[int, int]]:
    """(hi, lo) of the last key of each shard but the last.

    A key lies past splitter j when the bytes before it reach j / shards of all bytes;
    with tolerance (in bytes) a boundary may stop at any range that small.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    full = (1 << KEY_BITS) - 1
    # each open splitter: the range (column, high half if fixed, prefix, bits of it) and the bytes before that range
    open_: dict[int, tuple[int | None, int, int, int]] = {j: (None, 0, 0, 0) for j in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    while open_:
        groups = {(fixed, prefix, bits) for fixed, prefix, bits, _ in open_.values()}
        held: dict[tuple, list] = {g: [] for g in groups}
        for phase in (False, True):
            for bits in {b for f, _, b in groups if (f is not None) == phase}:
                here = [g for g in groups if (g[0] is not None) == phase and g[2] == bits]
                key = F.col("lo") if phase else F.col("hi")
                parent, child = F.shiftright(key, KEY_BITS - bits), F.shiftright(key, KEY_BITS - bits - STEP)
                some = keyed
                if phase:
                    some = some.where(F.col("hi").isin([f for f, _, _ in here]))
                if bits:
                    some = some.where(parent.isin([p for _, p, _ in here]))
                by = F.col("hi") if phase else F.lit(None).cast("long")
                counts = some.groupBy(by.alias("fixed"), parent.alias("parent"), child.alias("child")).agg(F.sum("size").alias("held"), F.count("*").alias("n"), F.min("hi").alias("a"), F.max("hi").alias("z"))
                for r in counts.collect():
                    if (g := (r["fixed"], r["parent"], bits)) in held:
                        held[g].append(r)
        for rows in held.values():
            rows.sort(key=lambda r: r["child"])
        for j, (fixed, prefix, bits, before) in list(open_.items()):
            last, last_before = None, before
            for r in held[fixed, prefix, bits]:
                if shards * before >= j * total:
                    break
                last, last_before = r, before
                before += r["held"]
            bits += STEP
            if last["n"] == 1 or last["held"] <= tolerance or (fixed is not None and bits >= KEY_BITS):
                end = ((last["child"] + 1) << (KEY_BITS - bits)) - 1
                found[j] = (fixed, end) if fixed is not None else (end, full)
                del open_[j]
            elif fixed is None and last["a"] == last["z"]:
                open_[j] = (last["a"], 0, 0, last_before)
            else:
                open_[j] = (fixed, last["child"], bits, last_before)
    return [found[j] for j in range(1, shards)]


def number_rows(keyed: DataFrame, spread: int = 20_000) -> DataFrame:
    """keyed with ``slot``: 0, 1, ... within each shard in key order.

    Ranges of the key with about ``spread`` rows are numbered apart, each from the count
    of the ranges before it; a text hash with more rows is divided by doc_id.
    """
    n = keyed.count()
    bits = min(20, max(STEP, math.ceil(math.log2(max(n, 1) / spread + 1))))
    most = max(spread, n >> STEP)
    ranges = ["shard", "range", "place", "part"]
    at = F.shiftright("hi", KEY_BITS - bits).alias("range")
    # hashes with many rows, at most 8 * 2**12 of them whatever the table, so their broadcast is bounded
    heavy = keyed.groupBy("hi").count().where(F.col("count") > most // 8).groupBy(at).agg(F.array_sort(F.collect_list("hi")).alias("heavy"))
    cut = keyed.select("*", at).join(F.broadcast(heavy), "range", "left")
    is_heavy = F.coalesce(F.array_contains("heavy", F.col("hi")), F.lit(False))
    below = F.coalesce(F.size(F.filter("heavy", lambda h: h < F.col("hi"))), F.lit(0))
    cut = cut.withColumn("place", F.when(F.col("heavy").isNull(), 0).otherwise(2 * below + is_heavy.cast("int")))
    cut = cut.withColumn("part", F.when(is_heavy, F.shiftright("lo", KEY_BITS - STEP)).otherwise(0)).drop("heavy")
    counts = cut.groupBy(*ranges).count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("range", "place", "part")) - F.col("count")
    starts = stage(counts.select(*ranges, before.alias("start")), "shard-starts")
    inside = F.row_number().over(Window.partitionBy(*ranges).orderBy("hi", "lo"))
    return cut.join(starts, ranges).withColumn("slot", (F.col("start") + inside - 1).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    keyed = stage(sort_keys(docs), "shard-keys")
    ends = splitters(keyed, shards, tolerance)
    past = sum(((((F.col("hi") > h) | ((F.col("hi") == h) & (F.col("lo") > low))).cast("int")) for h, low in ends), F.lit(0))
    placed = number_rows(keyed.withColumn("shard", past))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# CRC-32 bit by bit: the reflected polynomial 0xEDB88320.
SHARD_SQL = r"""
with recursive tab as (select b, (select list_reduce(range(8)::bigint[], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as c from (select unnest(range(256))::bigint as b)),
t as (select list(c order by b) as tab from tab),
d as (select doc_id, coalesce(text, '') as text from documents),
h as (select *, octet_length(encode(text)) + 8 as size, ('0x' || substr(md5(text), 1, 15))::bigint as hi, ('0x' || substr(md5(coalesce(doc_id::varchar, '~')), 1, 15))::bigint as lo from d),
x as (select *, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda v: ('0x' || v)::bigint), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]), 4294967295::bigint)) as crc from h, t),
b as (select *, sum(size) over (order by hi, lo range between unbounded preceding and current row) - sum(size) over (partition by hi, lo) as before, sum(size) over () as total from x),
s as (select *, floor(24 * before::hugeint // total)::int as shard from b)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by hi, lo) - 1 as slot, null::int as grown_shard from s"""
