"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a word unigram base.

All documents go through the dictionary exchange of quern.llm.blocks: a distinct word
is counted over all training documents and split into subword ids once. A second
exchange counts what follows what in all training texts: at a word's start the subword
after the last one of the word before, inside a word the subword after up to three
earlier ones of that word. A block's distinct pairs meet by hash, are summed, and the
sums go back. The counts are discounted by DISCOUNT a distinct pair, and what that
frees is dealt by the attention model.

The attention model reads subword ids: each has an embedding of its company (what it
follows and what follows it, counted over all training texts and projected on random
signs) and of its class; it predicts the class of the next subword (the FREQUENT most
used alone, the others in bands by use) by masked attention over a window. It learns
from all windows of all training texts: each round takes its share of every block's
windows (12 MB of text) in a random order, in local steps of BATCH windows, and the
blocks' changes are averaged. The shares of all rounds hold every window once; a block
of few windows goes round again until it has made LOCAL steps a round.
Texts are scored in overlapping windows of 16; the first scores all its places, each
further one the 12 that no earlier window scored, many windows at a time.

A training document's own pairs are among the counts, as its own words are in the base.

Defined cases: a null or empty text has one token, its end; very long texts are scored
whole; a null doc_id counts as training; repeated rows each get their row; without
training documents counts are zero; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import ANSWERS, EXCHANGE, LowerWords, Numbering, buckets_for, cutter, pack, pack_codes, reassemble, unit_lists, unpack, unpack_codes
from quern.llm.bpe import RANKS, encoding, runs, spread
from quern.llm.common import stage

END = 50_256
LENGTH = 16
STEP = 12
WIDTH = 16
CLUSTERS = 96
FREQUENT = 64
ROUNDS = 4  # of averaging
LOCAL = 30  # steps of a block in a round, at least
BATCH = 256  # windows of a step
DISCOUNT = 0.75
WINDOWS = 256  # scored at a time
PART = 1 << 18  # subwords scored at a time
ROWS = 192  # of a matrix product at a time
BOUND = np.where(np.tri(LENGTH, dtype=bool), 60, -np.inf).astype(np.float32)  # of the exponents with which a place (row) sees others: none after it
MARK = 65_535  # before a word's first subword
INNER = np.uint64(0x9E3779B97F4A7C15)
FIXED = float(1 << 30)  # sums of changes are added as whole numbers, so their order does not matter

PAIRS = "key long, block long, bucket int, a binary, b binary, c binary, d binary, doc_ids array<long>"
PAIR_SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in "abcd"), ("doc_ids", pa.list_(pa.int64()))])
ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in "abc")])
SUMS = ["kinds", "uses", "starts", *(f"f{i}" for i in range(WIDTH))]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def answering(path: str) -> Callable[[pa.Table], pa.Table]:
    """Subword ids and uses in training of one bucket's words for each block, and their sums as a summary row."""

    def answer(group: pa.Table) -> pa.Table:
        of = encoding(path).encode_ordinary
        number, rows, used = Numbering([0]), [], []
        for batch in group.to_batches():
            for (block, bucket, units), c in zip(unit_lists(batch), batch.column(5).to_pylist(), strict=True):
                rows.append((block, bucket, np.fromiter(map(number.__getitem__, units), np.int64, len(units))))
                used.append(unpack(c, "<i8"))
        found = [of(" " + u.decode("utf-8", "replace")) for u in number]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids, starts = np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()), np.cumsum(sizes) - sizes
        # sums of whole numbers, exact below 2^53
        counts = np.bincount(np.concatenate([c for *_, c in rows]), np.concatenate(used), len(found)).astype("<i8")
        pieces = np.bincount(ids, np.repeat(counts, sizes), END + 1).astype("<i8")
        out = []
        for block, bucket, codes in rows:
            values, n = spread(codes, starts, sizes, ids)
            out.append((block, bucket, pack(values.astype("<u4")), pack(n.astype("<u4")), pack(counts[codes])))
        some = np.flatnonzero(pieces)
        out.append((-1, 0, pack(some.astype("<u4")), pack(pieces[some]), pack(np.array([(counts > 0).sum(), counts.sum()], "<i8"))))
        return table_of(out, ANSWER_SCHEMA)

    return answer


def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n) of the summary rows: subword ids, then -1 for distinct words and -2 for their uses."""
    for batch in batches:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            place = np.concatenate([unpack(a, "<u4").astype(np.int64), [-1, -2]])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([unpack(b, "<i8"), unpack(c, "<i8")]))], names=["place", "n"])


def times(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """rows @ by, a few rows at a time: products that stay in the cache take two thirds of the time."""
    whole = len(rows) - len(rows) % ROWS
    out = np.empty((len(rows), by.shape[1]), rows.dtype)
    np.matmul(rows[:whole].reshape(-1, ROWS, rows.shape[1]), by, out=out[:whole].reshape(-1, ROWS, by.shape[1]))
    np.matmul(rows[whole:], by, out=out[whole:])
    return out


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, a few rows at a time."""
    whole = len(a) - len(a) % ROWS
    parts = a[:whole].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, ROWS, b.shape[1])
    return parts.sum(0) + a[whole:].T @ b[whole:]


def row_sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, each as often as that is long: the product is faster than spreading them."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones((a.shape[-1], a.shape[-1]), a.dtype)).reshape(a.shape)


def turned(a: np.ndarray) -> np.ndarray:
    """The last two axes exchanged, as a copy: a product with it is so much faster that the copy pays."""
    return np.ascontiguousarray(a.transpose(0, 2, 1))


def seen_shares(q: np.ndarray, h: np.ndarray, skip: int) -> np.ndarray:
    """The shares with which places from ``skip`` on, with queries q, see the places with numbers h."""
    a = q @ turned(h)
    # numbers stay far from the limits of exp(); the bound is for models gone astray
    a = np.exp(np.minimum(a, BOUND[skip : h.shape[1], : h.shape[1]], out=a), out=a)
    a /= row_sums(a)
    return a


def powers(rows: np.ndarray, by: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp(rows @ by), its sums by row, the places in it of columns y, and the exponents there.

    Where a sum shows that an exponent is beyond 60 (a model gone astray), all are bounded by 60.
    """
    by = by * by.dtype.type(1 / np.log(2))
    ones, at = np.ones(by.shape[1], by.dtype), np.arange(0, len(rows) * by.shape[1], by.shape[1]) + y
    for most in (None, 60 / np.log(2)):
        p = times(rows, by)
        if most:
            np.minimum(p, most, out=p)
        chosen = p.reshape(-1).take(at)
        with np.errstate(over="ignore"):
            total = np.exp2(p, out=p) @ ones
        if most or total.max() < np.exp(60):
            return p, total, at, chosen * by.dtype.type(np.log(2))


def laid_out(parts: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """All parts in one row, and the same parts as views of it."""
    row, views, at = np.concatenate([w.reshape(-1) for w in parts.values()]), {}, 0
    for name, w in parts.items():
        views[name] = row[at : at + w.size].reshape(w.shape)
        at += w.size
    return row, views


@dataclass
class Attention:
    """One masked attention layer over subword embeddings, and the share of each subword in its class."""

    cluster: np.ndarray
    share: np.ndarray  # natural log of p(subword | class)
    company: np.ndarray  # one row of WIDTH numbers a subword
    parts: dict[str, np.ndarray]

    @staticmethod
    def start(counts: np.ndarray, company: np.ndarray | None = None) -> Attention:
        """Classes by frequency: the most frequent subwords alone, the others in bands of equal use."""
        order = np.argsort(-counts, kind="stable")
        cluster = np.empty(len(counts), np.int64)
        rest = counts[order[FREQUENT:]] + 1.0
        bands = np.minimum(np.cumsum(rest) / rest.sum() * (CLUSTERS - FREQUENT), CLUSTERS - FREQUENT - 1).astype(np.int64)
        cluster[order] = np.concatenate([np.arange(FREQUENT), FREQUENT + bands])
        held = np.bincount(cluster, counts + 1.0, CLUSTERS)
        rng = np.random.default_rng(5)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        parts = {"e": draw(CLUSTERS, WIDTH), "f": draw(WIDTH, WIDTH), "p": draw(LENGTH, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH), "u": draw(WIDTH, CLUSTERS)}
        parts["b"] = np.log(held / held.sum()).astype(np.float32)
        company = np.zeros((len(counts), WIDTH), np.float32) if company is None else company
        return Attention(cluster, np.log((counts + 1.0) / held[cluster]), company, parts)

    def hidden(self, x: np.ndarray) -> tuple:
        w = self.parts
        h = w["e"][self.cluster[x]] + self.company[x] @ w["f"] + w["p"][: x.shape[1]]
        q, k, v = h @ w["q"], h @ w["k"], h @ w["v"]
        s = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5)
        s += np.triu(np.full((x.shape[1], x.shape[1]), -1e9, np.float32), 1)
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        mixed = s @ v
        return h, q, k, v, s, mixed, h + mixed @ w["o"]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """What leads from a place's numbers to its query of the numbers of others, and to what it adds where it is seen.

        The products q k' and v o, worked out once, spare every place its key and its way out.
        """
        w = self.parts
        return w["q"] @ w["k"].T * w["q"].dtype.type(WIDTH**-0.5), w["v"] @ w["o"]

    def reader(self) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
        """log_p with what does not depend on the windows worked out before: faster for many windows."""
        w = self.parts
        embedded = (w["e"][self.cluster] + self.company @ w["f"]).astype(np.float32)
        to_q, to_v = self.joined()
        to_class = np.concatenate([w["u"], w["b"][None]])

        def log_p(x: np.ndarray, y: np.ndarray, skip: int) -> np.ndarray:
            h = embedded.take(x, 0)
            h += w["p"]
            q, v = h[:, skip:] @ to_q, times(h.reshape(-1, WIDTH), to_v).reshape(h.shape)
            last = np.empty((len(x), LENGTH - skip, WIDTH + 1), np.float32)
            np.add(h[:, skip:], seen_shares(q, h, skip) @ v, out=last[:, :, :WIDTH])
            last[:, :, WIDTH] = 1
            _, total, _, chosen = powers(last.reshape(-1, WIDTH + 1), to_class, y[:, skip:].reshape(-1))
            return (chosen - np.log(total)).reshape(len(x), -1)

        return log_p

    def log_p(self, x: np.ndarray, y: np.ndarray, skip: int) -> np.ndarray:
        """Natural log p of classes y after the windows x of subwords, from place ``skip`` on."""
        out = self.hidden(x)[-1][:, skip:] @ self.parts["u"] + self.parts["b"]
        top = out.max(2)
        chosen = np.take_along_axis(out, y[:, skip:, None], 2)[..., 0]
        out -= top[..., None]
        np.exp(out, out=out)
        return chosen - top - np.log(out.sum(2))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, skip: int = 0) -> dict[str, np.ndarray]:
        """Gradients of the mean loss over the places with weight, from place ``skip`` on."""
        w = self.parts
        kind = w["u"].dtype
        ids = x.reshape(-1)
        own, near = self.cluster.take(ids), self.company.take(ids, 0)
        flat = times(near, w["f"])
        flat += w["e"].take(own, 0)
        h = flat.reshape(*x.shape, WIDTH)
        h += w["p"][: x.shape[1]]
        to_q, to_v = self.joined()
        q, v = h[:, skip:] @ to_q, times(flat, to_v).reshape(h.shape)
        a = seen_shares(q, h, skip)
        last = np.empty((len(x), x.shape[1] - skip, WIDTH + 1), kind)  # the last column is for b
        np.add(h[:, skip:], a @ v, out=last[:, :, :WIDTH])
        last[:, :, WIDTH] = 1
        last = last.reshape(-1, WIDTH + 1)
        p, total, at, _ = powers(last, np.concatenate([w["u"], w["b"][None]]), y[:, skip:].reshape(-1))
        p.reshape(-1)[at] -= total
        share = (weight[:, skip:].reshape(-1) / (weight[:, skip:].sum() * total)).astype(kind)[:, None]
        last *= share
        g_last = crossed(last, p)
        g = {"u": g_last[:-1], "b": g_last[-1]}
        d_last = times(p, np.ascontiguousarray(w["u"].T))
        d_last *= share
        d_last = d_last.reshape(len(x), -1, WIDTH)
        d_a = d_last @ turned(v)
        d_a -= row_sums(d_a * a)
        d_a *= a
        d = np.empty((*x.shape, 2 * WIDTH), kind)
        d[:, :skip, :WIDTH] = 0
        np.matmul(d_a, h, out=d[:, skip:, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), d_last, out=d[:, :, WIDTH:])
        d = d.reshape(-1, 2 * WIDTH)
        g_qv = crossed(flat, d)
        # of the parts of the two products in joined()
        scale = kind.type(WIDTH**-0.5)
        g["q"], g["k"] = g_qv[:, :WIDTH] @ w["k"] * scale, g_qv[:, :WIDTH].T @ w["q"] * scale
        g["v"], g["o"] = g_qv[:, WIDTH:] @ w["o"].T, w["v"].T @ g_qv[:, WIDTH:]
        d_flat = times(d, np.concatenate([to_q.T, to_v.T]))
        d_h = d_flat.reshape(h.shape)
        d_h += d_a.transpose(0, 2, 1) @ q
        d_h[:, skip:] += d_last
        g["p"] = np.zeros_like(w["p"])
        g["p"][: x.shape[1]] = d_h.sum(0)
        order, n = np.argsort(own.astype(np.uint8), kind="stable"), np.bincount(own, minlength=CLUSTERS)
        some = np.flatnonzero(n)
        g["e"] = np.zeros_like(w["e"])
        g["e"][some] = np.add.reduceat(d_flat.take(order, 0), (np.cumsum(n) - n)[some])
        g["f"] = crossed(near, d_flat)
        return g

    def learn(self, tokens: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, rate: float, turn: int = 0, rounds: int = 1) -> None:
        """Steps of Adam on the turn's share of all windows of the texts (subword ids, each with its end); rng is the same each turn."""
        n = window_counts(lengths)
        ends, starts = np.cumsum(n), np.cumsum(lengths) - lengths
        order, owner = rng.permutation(int(ends[-1])), np.repeat(np.arange(len(n)), n)
        # all weights lie in one row, so that Adam takes few and long operations
        row, self.parts = laid_out(self.parts)
        gradient, g = laid_out({name: np.zeros_like(w) for name, w in self.parts.items()})
        m, v, t = np.zeros_like(row), np.zeros_like(row), 0
        for at, skip in batches_of(order, ends - n, turn, rounds):
            t += 1
            doc = owner.take(at)
            # a place counts in the window that scores it
            x, y, weight, _ = window_rows(tokens, starts[doc], lengths[doc], at - (ends - n)[doc])
            for name, found in self.step(x, self.cluster.take(y), weight, skip).items():
                g[name][...] = found
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            row -= rate / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[k].reshape(-1) for k in sorted(self.parts)]).astype(np.float64)

    def moved(self, by: np.ndarray) -> None:
        at = 0
        for k in sorted(self.parts):
            w = self.parts[k]
            self.parts[k] = (w + by[at : at + w.size].reshape(w.shape)).astype(np.float32)
            at += w.size

    def copy(self) -> Attention:
        return Attention(self.cluster, self.share, self.company, dict(self.parts))

    def places(self, tokens: np.ndarray, lengths: np.ndarray, read: Callable | None = None) -> np.ndarray:
        """Natural log p of each subword of the texts that stand one after the other in tokens, each with its end; read: reader(), if there is one already."""
        out, read = np.append(self.share.take(tokens), 0), read or self.reader()
        n, starts = window_counts(lengths), np.cumsum(lengths) - lengths
        for later in (0, 1):
            ends = np.cumsum(n - 1 if later else np.minimum(n, 1))
            skip = (LENGTH - STEP) * later
            for i in range(0, int(ends[-1]) if len(ends) else 0, WINDOWS):
                at = np.arange(i, min(i + WINDOWS, ends[-1]))
                doc = np.searchsorted(ends, at, "right")
                number = at - np.where(doc > 0, ends[doc - 1], 0) + later
                x, y, weight, place = window_rows(tokens, starts[doc], lengths[doc], number)
                # what no window scores goes to the last place
                out[np.where(weight[:, skip:] > 0, place[:, skip:], len(tokens))] += read(x, self.cluster.take(y), skip)
        return out[:-1]

    def score(self, tokens: np.ndarray, lengths: np.ndarray, counted: np.ndarray | None = None, free: np.ndarray | None = None, read: Callable | None = None) -> np.ndarray:
        """log10 p of each of the texts; counted and free are as in discounted(), by place; read as in places()."""
        p = self.places(tokens, lengths, read)
        if counted is not None:
            p = np.log(counted + free * np.exp(p))
        return np.bincount(np.repeat(np.arange(len(lengths)), lengths), p, len(lengths)) / np.log(10)


def discounted(seen: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the counts say of a subword after what stands before it, and the share that they leave to the model.

    seen: how often it follows that in the training texts; total and kinds: how often and
    by how many subwords that is followed there.
    """
    return np.maximum(seen - DISCOUNT, 0) / np.maximum(total, 1), np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)


def window_counts(lengths: np.ndarray) -> np.ndarray:
    """How many windows cover each text."""
    return 1 + np.maximum(0, -(-(lengths - LENGTH) // STEP))


def batches_of(order: np.ndarray, heads: np.ndarray, turn: int, rounds: int) -> Iterator[tuple[np.ndarray, int]]:
    """A turn's share of the windows in ``order`` and the first place that counts, a batch at a time: first windows of texts (heads) and later ones apart.

    The shares of all rounds together hold every window; where there are few, each share goes round again to make LOCAL steps.
    """
    size = max(LOCAL * BATCH, -(-len(order) // rounds))
    share = order[np.arange(turn * size, (turn + 1) * size) % len(order)]
    first = np.isin(share, heads)
    parts = [(part, skip) for own, skip in ((share[first], 0), (share[~first], LENGTH - STEP)) if len(own) for part in np.array_split(own, -(-len(own) // BATCH))]
    for i in np.random.default_rng(turn).permutation(len(parts)):
        yield parts[i]


def window_rows(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple:
    """Inputs, targets, weights (0 beyond the text) and places in tokens of windows, each the number-th of a text."""
    at = (starts + number * STEP)[:, None] + np.arange(-1, LENGTH)
    span = tokens.take(at, mode="clip")
    span[number == 0, 0] = END
    weight = np.arange(LENGTH) < (lengths - number * STEP)[:, None]
    return span[:, :-1], span[:, 1:], weight.astype(np.float32), at[:, 1:]


def held_out(doc_id):
    """crc32 of doc_id as text, mod 7, is 2; a null doc_id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def is_training(doc_id: int | None) -> bool:
    """held_out, for one id and turned round."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


class Spelled:
    """The texts of a block as words, and its distinct words as subwords; the end is the last word of each text."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        # counts: words of each text, the end included; sizes: subwords of each distinct word
        self.flat, self.counts, self.sizes, self.values = flat, counts, sizes, values
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def with_ends(flat: np.ndarray, counts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Spelled:
        flat = np.insert(flat.astype(np.int64), np.cumsum(counts), len(sizes))
        return Spelled(flat, counts + 1, np.append(sizes, 1), np.append(values, END))

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of all texts and how many each has."""
        tokens, n = spread(self.flat, self.starts, self.sizes, self.values)
        return tokens, self.of_texts(n)

    def chosen_texts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """texts() of the chosen ones, as 16-bit numbers: Arrow copies a word's subwords in one piece."""
        starts = np.append(self.starts, len(self.values)) * 2
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(starts), pa.py_buffer(self.values.astype("<u2"))])
        found = words.take(pa.array(self.flat[np.repeat(chosen, self.counts)]))
        _, ends, held = found.buffers()
        ends = np.frombuffer(ends, np.int64, len(found) + 1)[np.append(0, np.cumsum(self.counts[chosen]))] // 2
        return np.frombuffer(held, "<u2", ends[-1]), np.diff(ends)

    def of_texts(self, by_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        return np.add.reduceat(by_word, np.cumsum(self.counts) - self.counts) if len(self.counts) else by_word[:0]

    def first_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word's pair (subword before the word << 16 | its first subword), and the distinct pairs."""
        first, last = self.values[self.starts], self.values[self.starts + self.sizes - 1]
        before = np.empty(len(self.flat), np.int64)
        before[1:] = last[self.flat[:-1]]
        before[np.cumsum(self.counts) - self.counts] = END
        coded = pa.array((before << 16 | first[self.flat]).astype("<u4")).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_numpy()

    def inner_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in values of the later subwords of words, number of each one's pair (hash of those before << 16 | it), and the distinct pairs."""
        inside = np.ones(len(self.values), bool)
        inside[self.starts] = False
        at = np.flatnonzero(inside)
        depth = at - np.repeat(self.starts, self.sizes)[at]
        h, values = np.zeros(len(at), np.uint64), self.values.astype(np.uint64)
        for back in (1, 2, 3):
            h ^= np.where(depth >= back, values.take(at - back, mode="clip"), np.uint64(MARK))
            h *= INNER
            h ^= h >> np.uint64(29)
        coded = pa.array((h & ~np.uint64(0xFFFF)) | values[at]).dictionary_encode()
        return at, coded.indices.to_numpy(), coded.dictionary.to_numpy()


def dealt(pairs: np.ndarray, by: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs by bucket (of ``by``) and value, and the edges of the buckets in it."""
    bucket = (by.astype(np.uint64) * INNER >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(pairs)
    order = order[np.argsort(bucket[order].astype(np.min_scalar_type(buckets)), kind="stable")]
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def tokeniser(ends: int, buckets: int):
    """A block's words and subwords as one code row and its distinct pairs, dealt into buckets, as rows of a second exchange."""

    def tokenise(code: pa.Table, answers: pa.Table) -> pa.Table:
        if "a" not in code.column_names:
            return PAIR_SCHEMA.empty_table()
        doc_ids, counts = code.column("doc_ids")[0].as_py(), unpack(code.column("c")[0].as_py(), "<i4").astype(np.int64)
        flat, order = unpack_codes(code.column("a")[0].as_py()), unpack(code.column("b")[0].as_py(), "<u4")
        answers = answers.sort_by("bucket")
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in answers.column(name).to_pylist())])
        values, sizes_in, uses_in = join("a", "<u4").astype(np.int64), join("b", "<u4").astype(np.int64), join("c", "<i8")
        sizes, starts, uses = (np.zeros(len(order), np.int64) for _ in range(3))
        sizes[order], starts[order], uses[order] = sizes_in, np.cumsum(sizes_in) - sizes_in, uses_in
        values, _ = spread(np.arange(len(order)), starts, sizes, values)
        block = Spelled.with_ends(flat, counts, sizes, values)
        uses = np.append(uses, ends)
        known = block.of_texts((uses > 0)[block.flat].astype(np.float64))
        base = block.of_texts(np.log10(uses + 1.0)[block.flat])
        taught = np.repeat(np.array([is_training(d) for d in doc_ids], float), block.counts)
        number, first = block.first_pairs()
        first_used = np.bincount(number, taught, len(first)).astype("<i8")
        at, inside, inner = block.inner_pairs()
        word_used = np.bincount(block.flat, taught, len(block.sizes))
        inner_used = np.bincount(inside, np.repeat(word_used, block.sizes)[at], len(inner)).astype("<i8")
        key = code.column("key")[0].as_py()
        rows = [(key, key, buckets, pack_codes(block.flat), pack(block.counts.astype("<i8")), pack(np.concatenate([known, base]).astype("<f8")), pack(np.concatenate([[len(block.sizes)], block.sizes, block.values]).astype("<u4")), doc_ids)]
        by_first, first_edges = dealt(first, first, buckets)
        by_inner, inner_edges = dealt(inner, inner >> np.uint64(16), buckets)
        for k in range(buckets):
            a, b = by_first[first_edges[k] : first_edges[k + 1]], by_inner[inner_edges[k] : inner_edges[k + 1]]
            if len(a) or len(b):
                used = pack(np.concatenate([first_used[a], inner_used[b]]))
                rows.append((-1 - k, key, k, pack_codes(np.diff(first[a], prepend=np.uint32(0))), pack(inner[b]), used, None, None))
        return table_of(rows, PAIR_SCHEMA)

    return tokenise


def signs(n: int) -> np.ndarray:
    """A random row of WIDTH / 2 signs for each subword."""
    return np.random.default_rng(8).integers(0, 2, (n, WIDTH // 2)) * 2 - 1


def totals(groups: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each value, the distinct values, and their summed counts."""
    coded = pa.array(np.concatenate(groups)).dictionary_encode()
    number, names = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    return number, names, np.bincount(number, np.concatenate(counts), len(names)).astype(np.int64)


def pair_answers(group: pa.Table) -> pa.Table:
    """Uses in all training texts of each block's pairs of one bucket, for inner pairs with uses and kinds of what stands before; then the sums of the bucket by subword."""
    rows = list(zip(*(group.column(n).to_pylist() for n in ("block", "bucket", "a", "b", "c")), strict=True))
    first = [np.cumsum(unpack_codes(a), dtype=np.uint32) for _, _, a, _, _ in rows]
    inner = [unpack(b, "<u8") for _, _, _, b, _ in rows]
    used = [unpack(c, "<i8") for *_, c in rows]
    number, names, n = totals(first, [u[: len(a)] for u, a in zip(used, first, strict=True)])
    inside, inner_names, inner_n = totals(inner, [u[len(a) :] for u, a in zip(used, first, strict=True)])
    _, context = np.unique(inner_names >> np.uint64(16), return_inverse=True)
    context_n, context_kinds = np.bincount(context, inner_n), np.bincount(context, inner_n > 0)
    facts = np.stack([inner_n, context_n[context], context_kinds[context]]).astype("<i8") if len(context) else np.zeros((3, 0), "<i8")
    out, i, j = [], 0, 0
    for (block, bucket, *_), a, b in zip(rows, first, inner, strict=True):
        out.append((block, bucket, pack(n[number[i : i + len(a)]].astype("<i8")), pack(np.ascontiguousarray(facts[:, inside[j : j + len(b)]])), None))
        i, j = i + len(a), j + len(b)
    before, after, n = (names >> 16).astype(np.int64)[n > 0], (names & 0xFFFF).astype(np.int64)[n > 0], n[n > 0]
    some, index = np.unique(np.concatenate([before, after]), return_inverse=True)
    sums = np.zeros((len(some), len(SUMS)), np.int64)
    left, right = index[: len(before)], index[len(before) :]
    np.add.at(sums, (left, 0), 1)
    np.add.at(sums, (left, 1), n)
    np.add.at(sums, (right, 2), n)
    sign = signs(END + 1)
    for k in range(WIDTH // 2):
        np.add.at(sums, (left, 3 + k), n * sign[after, k])
        np.add.at(sums, (right, 3 + WIDTH // 2 + k), n * sign[before, k])
    out.append((-1, 0, pack(some.astype("<u4")), pack(sums.astype("<i8")), None))
    return table_of(out, ANSWER_SCHEMA)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, kinds, uses, f0, ...) of the summary rows."""
    for batch in batches:
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            values = unpack(b, "<i8").reshape(-1, len(SUMS))
            yield pa.RecordBatch.from_arrays([pa.array(unpack(a, "<u4").astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=["place", *SUMS])


def company(sums: np.ndarray) -> np.ndarray:
    """Embeddings from the projected counts: means over a subword's uses, centred, scaled, and shrunk where it is rare."""
    half = WIDTH // 2
    out = np.zeros((len(sums), WIDTH))
    for side in (0, 1):
        n, own = sums[:, 1 + side], slice(side * half, (side + 1) * half)
        part = sums[:, 3 + side * half : 3 + (side + 1) * half] / np.maximum(n, 1)[:, None]
        weight = n / max(n.sum(), 1)
        part = part - weight @ part
        out[:, own] = part / np.maximum(np.sqrt(weight @ part**2), 1e-9) * (n / (n + 20))[:, None]
    return np.clip(out, -4, 4).astype(np.float32)


def read_block(code: dict) -> tuple[Spelled, np.ndarray]:
    held = unpack(code["d"], "<u4").astype(np.int64)
    sizes, values = held[1 : 1 + held[0]], held[1 + held[0] :]
    return Spelled(unpack_codes(code["a"]).astype(np.int64), unpack(code["b"], "<i8"), sizes, values), unpack(code["c"], "<f8")


def trainer(model: Attention, turn: int):
    """mapInArrow function from code rows to (place, change): the blocks' changes of the weights, times their windows, and those windows at place -1."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, change, weight = model.flat(), 0, 0
        for batch in batches:
            for code in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block, taught = read_block(code)[0], np.array([is_training(d) for d in code["doc_ids"]], bool)
                if not taught.any():
                    continue
                tokens, lengths = block.chosen_texts(taught)
                own, windows = model.copy(), int(window_counts(lengths).sum())
                own.learn(tokens, lengths, np.random.default_rng([code["key"] & 0xFFFFFFFF, code["key"] >> 32]), 0.02 * (1 - turn / (ROUNDS + 1)), turn, ROUNDS)
                change, weight = change + np.rint((own.flat() - before) * FIXED).astype(np.int64) * min(windows, 1 << 24) // (1 << 10), weight + min(windows, 1 << 24)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(before))), pa.array(np.append(weight, change).astype(np.int64))], names=["place", "change"])

    return train


def fit(model: Attention, codes: DataFrame) -> None:
    """Rounds of local learning on all blocks and averaging; codes are the code rows of the second exchange."""
    for turn in range(ROUNDS):
        moved, weight = np.zeros(len(model.flat())), 0
        # one row a weight of the model
        for place, change in codes.mapInArrow(trainer(model, turn), "place long, change long").groupBy("place").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect():
            if place < 0:
                weight = int(change)
            else:
                moved[place] = float(change)
        if weight:
            model.moved(moved * (1 << 10) / FIXED / weight)


def scorer(model: Attention, uses: np.ndarray, kinds: np.ndarray, schema: pa.Schema):
    """uses and kinds, by subword: how often and by how many first subwords of words it is followed."""

    def score(code: pa.Table, answers: pa.Table) -> pa.Table:
        if "a" not in code.column_names:
            return schema.empty_table()
        code = code.to_pylist()[0]
        block, facts = read_block(code)
        known, base = facts.reshape(2, -1)
        answers = answers.sort_by("bucket")
        number, first = block.first_pairs()
        at, inside, inner = block.inner_pairs()
        by_first, _ = dealt(first, first, code["bucket"])
        by_inner, _ = dealt(inner, inner >> np.uint64(16), code["bucket"])
        seen_first, inner_facts = np.zeros(len(first)), np.zeros((3, len(inner)))
        seen_first[by_first] = np.concatenate([np.zeros(0), *(unpack(x, "<i8") for x in answers.column("a").to_pylist())])
        inner_facts[:, by_inner] = np.concatenate([np.zeros((3, 0)), *(unpack(x, "<i8").reshape(3, -1) for x in answers.column("b").to_pylist())], 1)
        before = (first >> 16).astype(np.int64)
        # worked out once for the distinct pairs and for each subword of each distinct word
        counted_first, free_first = discounted(seen_first, uses[before], kinds[before])
        counted, free = np.zeros(len(block.values)), np.ones(len(block.values))
        counted[at], free[at] = (x[inside] for x in discounted(*inner_facts))
        edges, scores, read = np.concatenate([[0], np.cumsum(block.counts)]), [], model.reader()
        # texts of about PART subwords at a time, for the size of what is known of each place
        for i, j in runs(block.of_texts(block.sizes[block.flat]), PART):
            own = slice(edges[i], edges[j])
            pair = number[own]
            places, n = spread(block.flat[own], block.starts, block.sizes, np.arange(len(block.values)))
            heads = np.cumsum(n) - n
            by_count, left = counted.take(places), free.take(places)
            by_count[heads], left[heads] = counted_first[pair], free_first[pair]
            scores.append(model.score(block.values.take(places), np.add.reduceat(n, edges[i:j] - edges[i]), by_count, left, read))
        scores = np.concatenate(scores)
        return pa.table([pa.array(code["doc_ids"], pa.int64()), pa.array(block.counts), pa.array(known.astype(np.int64)), pa.array(base), pa.array(scores)], schema=schema)

    return score


@dataclass
class Learned:
    """What was learned from the training documents, and all documents as rows of the second exchange."""

    model: Attention
    sums: np.ndarray  # SUMS of each subword
    train_tokens: int
    train_words: int  # distinct ones
    codes: DataFrame
    seen: DataFrame


def learn(docs: DataFrame, path: str) -> Learned:
    """Learn from the training documents of docs (doc_id, text)."""
    buckets = buckets_for(docs)
    rows = stage(docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train")).mapInArrow(cutter(LowerWords, buckets), EXCHANGE), "lm-blocks")
    answers = stage(rows.where("key < 0").groupBy("key").applyInArrow(answering(path), ANSWERS), "lm-answers")
    gathered = answers.where("block = -1").mapInArrow(piece_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts, distinct, uses = np.zeros(END + 1), 0, 0
    for place, n in gathered.collect():  # at most one row a subword of the tokenizer
        if place >= 0:
            counts[place] = n
        else:
            distinct, uses = (n, uses) if place == -1 else (distinct, n)
    ends = docs.where(~held_out(F.col("doc_id"))).count()
    counts[END] = ends
    spelled = stage(reassemble(rows.where("key >= 0"), answers.where("block >= 0"), tokeniser(ends, buckets), PAIRS), "lm-spelled")
    seen = stage(spelled.where("key < 0").groupBy("key").applyInArrow(pair_answers, ANSWERS), "lm-pairs")
    sums = np.zeros((END + 1, len(SUMS)), np.int64)
    by_place = seen.where("block = -1").mapInArrow(summed, "place long, " + ", ".join(f"{c} long" for c in SUMS)).groupBy("place").agg(*[F.sum(c).alias(c) for c in SUMS])
    for row in by_place.toPandas().to_numpy():  # as above
        sums[row[0]] = row[1:]
    model = Attention.start(counts, company(sums))
    codes = spelled.where("key >= 0")
    fit(model, codes)
    return Learned(model, sums, int(uses) + ends, int(distinct) + (ends > 0), codes, seen.where("block >= 0"))


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of = learn(docs, path or public_tokenizers.path(RANKS))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    uses, kinds = of.sums[:, SUMS.index("uses")], of.sums[:, SUMS.index("kinds")]
    scored = reassemble(of.codes, of.seen, scorer(of.model, uses, kinds, schema), "doc_id long, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(of.train_tokens + of.train_words + 1)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(of.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
