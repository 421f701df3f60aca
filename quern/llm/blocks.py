"""Texts in blocks: a dictionary exchange that looks each distinct unit up once.

A task cuts its documents into blocks. A block keeps the order of its units as codes
and offers its distinct units, dealt into buckets by their hash. One exchange brings
equal buckets of all blocks together, where a distinct unit is looked up once; the
answers go back to the block, which reassembles its documents by position. So a word
costs one row element a block and not one a use, and no word is a hot key.

The exchange carries (key, block, bucket, a, b, c, doc_ids): a block's codes under the
block's number, its units under -1 - bucket, all arrays packed with zstd.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 64 << 20  # of text a bucket
EXCHANGE = "key long, block long, bucket int, a binary, b binary, c binary, doc_ids array<long>"
ANSWERS = "block long, bucket int, a binary, b binary, c binary"

PACKER, UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

#: Only such a space parts a text into units that can be read apart: the white space before it ends there.
INNER = re.compile(r" \s")
CUT = re.compile(r" (?=\S)")


def pack(values: np.ndarray | bytes) -> bytes:
    return PACKER.compress(values if isinstance(values, bytes) else values.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(UNPACKER.decompress(data), dtype)


def pack_codes(codes: np.ndarray) -> bytes:
    """Byte planes compress better than whole numbers."""
    return pack(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Numbering(dict):
    """Numbers its keys in the order they first occur, from a counter that several share."""

    def __init__(self, counter: list[int]):
        super().__init__()
        self.counter = counter

    def __missing__(self, key):
        n = self[key] = self.counter[0]
        self.counter[0] = n + 1
        return n


class SpacedUnits:
    """Units of a text are its pieces between single spaces, each with its leading space: they tokenise apart."""

    def __init__(self):
        counter = [0]
        self.first, self.rest, self.texts = Numbering(counter), Numbering(counter), []

    def codes(self, text: bytes) -> list[int]:
        text = text.decode("utf-8", "replace")
        pieces = CUT.split(text) if INNER.search(text) else text.split(" ")
        out = [self.first[pieces[0]]] if pieces[0] else []
        out.extend(map(self.rest.__getitem__, pieces[1:]))
        return out

    def add(self, text: bytes) -> int:
        """How many units the text has."""
        self.texts.append(np.asarray(self.codes(text), np.int32))
        return len(self.texts[-1])

    def flat(self) -> np.ndarray:
        """The units of all texts added, text after text, by their place in units()."""
        return np.concatenate([np.asarray(c, np.int64) for c in self.texts])

    def units(self) -> list[bytes]:
        out: list[bytes] = [b""] * (len(self.first) + len(self.rest))
        for text, n in self.first.items():
            out[n] = text.encode()
        for text, n in self.rest.items():
            out[n] = b" " + text.encode()
        return out


class LowerWords:
    """Units are the words of the text with A-Z lowered; white space is dropped."""

    def __init__(self):
        self.texts, self.words = [], pa.array([], pa.binary())

    def add(self, text: bytes) -> int:
        words = text.lower().split()
        self.texts.append(pa.array(words, pa.binary()))
        return len(words)

    def flat(self) -> np.ndarray:
        coded = pa.concat_arrays(self.texts).dictionary_encode()
        self.words = coded.dictionary
        return coded.indices.to_numpy().astype(np.int64)

    def units(self) -> list[bytes]:
        """Of the texts in flat()."""
        if not len(self.words):
            return []
        _, ends, held = self.words.buffers()
        ends, held = np.frombuffer(ends, np.int32, len(self.words) + 1, 4 * self.words.offset).tolist(), held.to_pybytes() if held else b""
        return [held[i:j] for i, j in pairwise(ends)]


def cutter(kind: type, buckets: int):
    """mapInArrow function from (doc_id, text) to the rows of the exchange."""

    def flush(block: int, maker, ids: list, counts: list, flags: list) -> Iterator[pa.RecordBatch]:
        flat = maker.flat()
        units = maker.units()
        # frequent units get small codes
        order = np.argsort(-np.bincount(flat, minlength=len(units)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        bucket = np.fromiter(map(xxhash.xxh32_intdigest, units), np.int64, len(units)) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        used = np.bincount(flat, np.repeat(np.asarray(flags, float), counts), len(units)).astype("<i8")
        rows = [(block, block, -1, pack_codes(rank[flat]), pack(rank[by_bucket].astype("<u4")), pack(np.asarray(counts, "<i4")), ids)]
        units, used = [units[i] for i in by_bucket.tolist()], used[by_bucket]
        sizes = np.fromiter(map(len, units), "<u4", len(units))
        for k in range(buckets):
            i, j = edges[k], edges[k + 1]
            if j > i:
                rows.append((-1 - k, block, k, pack(b"".join(units[i:j])), pack(sizes[i:j]), pack(used[i:j]), None))
        names = ["key", "block", "bucket", "a", "b", "c", "doc_ids"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        n, held, maker, ids, counts, flags = 0, 0, kind(), [], [], []
        for batch in batches:
            marks = batch.column(2).to_pylist() if batch.num_columns > 2 else [False] * batch.num_rows
            for doc, text, mark in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), marks, strict=True):
                text = text.as_py() or b""
                ids.append(doc)
                counts.append(maker.add(text))
                flags.append(mark)
                held += len(text) + 64
                if held >= BLOCK_BYTES:
                    yield from flush(task | n, maker, ids, counts, flags)
                    n, held, maker, ids, counts, flags = n + 1, 0, kind(), [], [], []
        if ids:
            yield from flush(task | n, maker, ids, counts, flags)

    return cut


def unit_lists(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(block, bucket, units) of the unit rows of an exchange batch."""
    for key, block, bucket, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
        if key < 0:
            text, ends = UNPACKER.decompress(a), np.cumsum(unpack(b, "<u4")).tolist()
            yield block, bucket, [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def buckets_for(docs: DataFrame) -> int:
    """Buckets by the bytes of all texts, so what meets in one bucket does not grow with them."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(256, held // BUCKET_BYTES)


def exchange(docs: DataFrame, kind: type) -> DataFrame:
    """The exchanged rows of docs (doc_id, text); use the one DataFrame for both sides, so Spark reuses its shuffle."""
    return docs.mapInArrow(cutter(kind, buckets_for(docs)), EXCHANGE).repartition("key")


def reassemble(rows: DataFrame, answers: DataFrame, body: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """body(block's code row, its answer rows) for every block."""
    empty = pa.table({"x": pa.array([], pa.int64())})

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        code = left.filter(pa.compute.greater_equal(left.column("key"), 0)) if left.num_rows else left
        return body(code, right) if code.num_rows else body(empty, right)

    return rows.groupBy("key").cogroup(answers.groupBy("block")).applyInArrow(both, schema)
