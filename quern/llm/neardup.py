"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles. One permutation scatters the shingles
over 2**20 places; a second one, shifted round by k places, gives the k-th signature
coordinate as the smallest value it assigns to the set, so two permutations make all
coordinates. Bands of coordinates collect candidates; every link is confirmed on the
full sets. With 6 coordinates a band and 56 bands, a pair at similarity 0.8 shares no
band with probability (1 - 0.8**6)**56 = 4e-8, and pairs above it less; unrelated ones
almost never meet.

Equal sets are folded first and only their smallest doc_id goes on. In a band's bucket
every member is first compared with the bucket's smallest. Where a bucket then holds
several components, the members outside its largest one are compared with a random
member of that one, round after round while one in a hundred links and much is left; in the
end all pairs of different components that share a bucket are compared. Pairs inside
a component need no comparison, and parity bits of the sets (an exact bound on how many
shingles differ) drop most pairs that are too far apart before any text moves, so a
group of near copies costs about its size and not its square.

Defined cases: null and wordless texts have no shingles, link with nothing and stay;
rows that share a doc_id count as one document (a null doc_id: never linked, kept);
very long texts are taken whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BLOCKS, bloom_block, bloom_blocks, bloom_mask, stage
from quern.llm.components import connected, merged

PLACES = 1 << 20
ROWS = 6
BANDS = 56
SEED = 20_240_501
CACHE = 400_000
SALTED = 256  # pairs of one document that may meet in a task

WORDS = 16  # of 64 parity bits

SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, " + ", ".join(f"w{i} long" for i in range(WORDS))


class WordHashes(dict):
    """64-bit hashes of words, each computed once; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(1)
def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the second one as all its runs of ``width`` places, circular."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(PLACES).astype(np.uint32)
    second = rng.permutation(PLACES).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def shingles(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words."""
    found = (text or b"").lower().split()
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    out = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for i in range(min(size, len(h))):
        part = h[i : i + len(out)]
        out = (out ^ (part + np.uint64(i + 1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(items: np.ndarray, width: int) -> np.ndarray:
    """``width`` coordinates of a set, by the shifts of the second permutation."""
    first, runs = permutations(width)
    places = first[(items & np.uint64(PLACES - 1)).astype(np.int64)]
    best = runs[places[:2048]].min(axis=0)
    for i in range(2048, len(places), 2048):
        best = np.minimum(best, runs[places[i : i + 2048]].min(axis=0))
    return best


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = (key ^ parts[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def parity(items: np.ndarray) -> np.ndarray:
    """64 * WORDS bits: each is set if an odd number of the set's shingles fall on it."""
    at = ((items >> np.uint64(24)) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 512):
                sets = [shingles(t, size, hashes) for t in texts[at : at + 512].to_pylist()]
                full = [s for s in sets if len(s)]
                keys = band_keys(np.stack([signature(s, bands * rows) for s in full]), rows) if full else np.zeros((0, bands), np.int64)
                folded = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
                columns = [
                    batch.column(0)[at : at + 512],
                    pa.array(sizes),
                    pa.array(np.array([a for a, _ in folded], np.uint64).view(np.int64)),
                    pa.array(np.array([b for _, b in folded], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                ]
                bits = np.stack([parity(x) for x in sets])
                columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands", *[f"w{i}" for i in range(WORDS)]])

    return sign


def verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple = (0, None)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i in range(batch.num_rows):
                text = left[i].as_py()
                if last[0] != text:  # a doc_id may have several texts
                    last = (text, shingles(text, size, hashes))
                x, y = last[1], shingles(right[i].as_py(), size, hashes)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return verify


def alike(percent: int) -> Column:
    """False only where the parity bits of a pair (a, b) prove it less similar: each differing bit is a shingle that one has and one lacks."""
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(WORDS)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return fits & F.coalesce((100 + percent) * apart <= (100 - percent) * total, F.lit(True))


def side(sizes: DataFrame, name: str) -> DataFrame:
    return sizes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(f"w{i}").alias(f"{name}{i}") for i in range(WORDS)])


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) whose doc_id is in ids.

    A blocked Bloom filter of the ids, of at most BROADCAST_BLOCKS blocks of 16 bytes, drops
    other texts where they are read; the exact join then moves little more than what it keeps.
    """
    known, blocks = bloom_blocks(ids.select(F.col("doc_id").alias("key")), BROADCAST_BLOCKS)
    wanted = bloom_mask(F.col("doc_id"))
    hit = (bloom_block(F.col("doc_id"), blocks) == F.col("block")) & (F.col("filter").bitwiseAND(wanted) == wanted)
    return docs.join(F.broadcast(known), hit).select("doc_id", "text").join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; texts travel only for pairs whose sizes allow it."""
    fit = pairs.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    fit = stage(fit.where(alike(percent)).select("a", "b"), "fitting")
    ids = stage(fit.select(F.col("a").alias("doc_id")).union(fit.select("b")).distinct(), "candidate-ids")
    texts = stage(only(docs, ids).select("doc_id", "text"), "candidate-texts")
    # a document of many pairs is a hot key: its pairs are dealt on as many salts as they ask for, and its text goes to each
    hot = fit.groupBy("a").count().where(F.col("count") > SALTED).select("a", F.ceil(F.col("count") / SALTED).cast("int").alias("salts"))
    salted = fit.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(hot, "a", "left")
    one = one.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return stage(salted.join(two, "b").join(one, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(verifier(size, percent), "a long, b long"), "verified")


def several(signed: DataFrame, folded: DataFrame) -> DataFrame:
    """Links (a, b) between the sets, by their ids, of a doc_id that has several: its rows count as one document."""
    own = signed.where("n_shingles > 0 and doc_id is not null")
    a_set = F.struct("set_hi", "set_lo")
    many = own.groupBy("doc_id").agg(F.min(a_set).alias("x"), F.max(a_set).alias("y")).where("x <> y").select("doc_id")
    ids = own.join(many, "doc_id", "left_semi").join(folded, ["set_hi", "set_lo"]).select("doc_id", "id")
    return stage(ids.join(ids.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "shared-ids")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInArrow(signer(size, bands, rows), SIGNATURE), "signatures")
    whole = ["set_hi", "set_lo"]
    folded = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), *[F.max(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    folded = stage(folded, "folded")
    # rows that share a doc_id but not a text have no one set of bits
    sizes = folded.groupBy("id").agg(F.max("n").alias("n"), *[F.when(F.count("*") == 1, F.max(f"w{i}")).alias(f"w{i}") for i in range(WORDS)])
    singles = signed.join(folded.select(*whole, F.col("id").alias("doc_id")), [*whole, "doc_id"], "left_semi").dropDuplicates([*whole, "doc_id"])
    banded = stage(singles.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")), "banded")
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    shared = stage(banded.join(heads, "key").select("key", "id", "head"), "shared-buckets")
    first = stage(shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "head-pairs")
    found_first = connected(confirmed(first, docs, sizes, size, percent))
    parts = stage(sizes.select("id").join(found_first, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id")), "components")
    compared, turn, found, more = first, 0, True, several(signed, folded)
    while True:
        placed = stage(shared.join(parts, "id").select("key", "id", F.col("component_id").alias("part")), "placed")
        tally = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("pick"))
        largest = F.max_by(F.struct("part", "pick"), "n")
        mixed = tally.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.count("*").alias("parts"), largest.alias("best"))
        mixed = stage(mixed.where("parts > 1"), "mixed-buckets")
        work = mixed.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
        if not work["rows"]:
            break
        last = work["pairs"] <= 4 * work["rows"] or not found
        joined = placed.join(mixed.select("key", "best"), "key")
        if last:
            apart = stage(joined.select("key", "id", "part").join(sizes, "id"), "apart")
            left = apart.select("key", F.col("part").alias("part_a"), F.col("id").alias("a"), F.col("n").alias("n_a"), *[F.col(f"w{i}").alias(f"a{i}") for i in range(WORDS)])
            right = apart.select("key", F.col("part").alias("part_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), *[F.col(f"w{i}").alias(f"b{i}") for i in range(WORDS)])
            pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & alike(percent)).select("a", "b")
        else:
            outside = joined.where("part <> best.part")
            pairs = outside.select(F.least("best.pick", "id").alias("a"), F.greatest("best.pick", "id").alias("b"))
        pairs = stage(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "bucket-pairs")
        links = confirmed(pairs, docs, sizes, size, percent)
        if last:
            more = more.union(links)
            break
        found = 100 * links.count() >= pairs.count()
        compared, turn = compared.union(pairs), turn + 1
        parts = merged(parts, links)
    of_sets = folded.join(merged(parts, more), "id").select(*whole, "component_id")
    out = signed.join(of_sets, whole, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)
