"""Byte-level BPE over a global dictionary exchange, and decoding by the token-byte table.

Texts are cut where their pre-tokens part (blocks.SpacedUnits); the distinct words of
all blocks meet by hash, each is split by the tokenizer's pattern and merged once, and
the ids go back to the blocks, which reassemble their documents by position. Decoding
joins the token-byte table (50,256 entries, a fixed size) to the ids, batch by batch;
round_trip does both in one pass over the blocks.

Defined cases: a null text counts as empty and has no ids; very long texts are encoded
whole; a null doc_id stays null; repeated rows each get their row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import ANSWERS, SpacedUnits, exchange, pack, reassemble, unit_lists, unpack, unpack_codes

RANKS = "byte_bpe_50k.tiktoken"
PLACED = 1 << 17  # codes spread at a time
CACHE = 400_000  # units a task remembers between blocks
SLICE_BYTES = 8 << 20  # of ids or decoded text in one Arrow batch, which Python and the JVM both hold; its offsets have 32 bits

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = ENCODED + ", decoded binary"


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def word_encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        of = encoding(path).encode_ordinary
        for batch in batches:
            rows = []
            for block, bucket, units in unit_lists(batch):
                ids = []
                if len(known) > CACHE:
                    known.clear()
                for u in units:
                    found = known.get(u)
                    if found is None:
                        found = known[u] = np.array(of(u.decode()), "<u4").tobytes()
                    ids.append(found)
                rows.append((block, bucket, pack(b"".join(ids)), pack(np.array([len(x) >> 2 for x in ids], "<u4")), None))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "bucket", "a", "b", "c"])

    return encode


def spread(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's run, run after run, and how many each code has."""
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(ends[-1], values.dtype)
    for i in range(0, len(codes), PLACED):  # a part at a time, so that the index stays in the cache
        own, part = codes[i : i + PLACED], n[i : i + PLACED]
        first, last = ends[i], ends[i + len(own)]
        at = np.repeat(starts.take(own) - (ends[i : i + len(own)] - first), part)
        at += np.arange(last - first)
        out[first:last] = values.take(at)
    return out, n


def block_ids(code: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of one block's documents."""
    if not answers.num_rows and "a" not in code.column_names:
        return _ids_table([], np.zeros(0, np.int64), np.zeros(0, "<u4"))
    doc_ids, counts = code.column("doc_ids")[0].as_py(), unpack(code.column("c")[0].as_py(), "<i4")
    flat, order = unpack_codes(code.column("a")[0].as_py()), unpack(code.column("b")[0].as_py(), "<u4")
    answers = answers.sort_by("bucket")
    none = np.zeros(0, "<u4")
    values = np.concatenate([none, *(unpack(x, "<u4") for x in answers.column("a").to_pylist())])
    sizes_in = np.concatenate([none, *(unpack(x, "<u4") for x in answers.column("b").to_pylist())]).astype(np.int64)
    sizes, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    sizes[order], starts[order] = sizes_in, np.cumsum(sizes_in) - sizes_in
    tokens, n = spread(flat, starts, sizes, values)
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
    return _ids_table(doc_ids, np.diff(ends), tokens)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most ``most``; a larger row stands alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Rows of bytes of data between ends, which must fit 32-bit offsets: a row of Spark does, and runs() keeps batches below."""
    if ends[-1] - ends[0] >= 1 << 31:
        raise ValueError("one text needs more than 2 GB; no row of Spark can hold it")
    part = np.ascontiguousarray(data[ends[0] : ends[-1]])
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends - ends[0]).astype("<i4")), pa.py_buffer(part)])


def _ids_table(doc_ids: list, n_tokens: np.ndarray, tokens: np.ndarray) -> pa.Table:
    data, ends = tokens.astype("<u4").view(np.uint8), 4 * np.concatenate([[0], np.cumsum(n_tokens)])
    pieces = [binaries(data, ends[i : j + 1]) for i, j in runs(4 * n_tokens, SLICE_BYTES)]
    ids = pa.chunked_array(pieces, pa.binary())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": ids})


def _reassembled(docs: DataFrame, path: str, body: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    rows = exchange(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SpacedUnits)
    return reassemble(rows, rows.mapInArrow(word_encoder(path), ANSWERS), body, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of every row of docs."""
    return _reassembled(docs, path or public_tokenizers.path(RANKS), block_ids, ENCODED)


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, where each starts, and its size."""
    table = sorted((i, b) for b, i in ranks(path).items())
    size = np.zeros(table[-1][0] + 1, np.int64)
    for i, b in table:
        size[i] = len(b)
    return np.frombuffer(b"".join(b for _, b in table), np.uint8), np.cumsum(size) - size, size


def decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, starts, size = token_bytes(path)
        for batch in batches:
            # a token has few bytes on average, but a batch is cut by what its ids stand for
            lists = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]
            held = np.array([int(size[x].sum()) for x in lists], np.int64)
            for i, j in runs(held, SLICE_BYTES):
                tokens = np.concatenate(lists[i:j])
                text, n = spread(tokens, starts, size, raw)
                ends = np.concatenate([[0], np.cumsum(held[i:j])])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, binaries(text, ends)], names=[*part.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with ``decoded``, the bytes that its ids stand for."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decoder(path or public_tokenizers.path(RANKS)), DECODED)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """decode(encode(docs)) by one Python worker a task, where each of the two would have its own."""
    path = path or public_tokenizers.path(RANKS)
    again = decoder(path)

    def body(code: pa.Table, answers: pa.Table) -> pa.Table:
        coded = block_ids(code, answers)
        return pa.Table.from_batches(again(coded.to_batches()), schema=coded.schema.append(pa.field("decoded", pa.binary())))

    return _reassembled(docs, path, body, DECODED)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trip(docs)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
