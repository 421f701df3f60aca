"""Corpus bookkeeping: languages, themes, chunks, exact duplicates, artefact states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import terms

# Words that mark a language, and words that mark a theme of the invented vocabulary.
LANGUAGE_MARKS = {
    "en": ["the", "and", "of", "was", "with", "that", "is"],
    "fr": ["le", "les", "des", "une", "est", "dans", "sur", "pour"],
    "de": ["der", "die", "und", "das", "den", "mit", "von", "sich"],
    "es": ["el", "los", "que", "las", "del", "con", "por", "para"],
}
THEMES = {"motion": ["from", "to", "by", "into"], "place": ["in", "on", "at", "under"], "being": ["is", "was", "are", "be"]}


def best_class(text: Column, marks: dict[str, list[str]], none: str) -> Column:
    """The class with the most marking words in the whole text; the first of equals, ``none`` without any."""
    marking = sorted({w for words in marks.values() for w in words})
    told = F.filter(terms(text), lambda x: x.isin(marking))

    def best(found: Column) -> Column:
        hits = lambda own: F.size(F.filter(found, lambda x: x.isin(own)))
        top = F.array_max(F.array(*[F.struct(hits(w).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, w) in enumerate(marks.items())]))
        return F.when(top["n"] > 0, top["k"]).otherwise(none)

    # the few marking words are found once, then told apart
    return F.element_at(F.transform(F.array(told), best), 1)


def language(text: Column) -> Column:
    return best_class(text, LANGUAGE_MARKS, "unknown")


def fixed_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs (doc_id, text) as chunks of ``size`` characters, each starting size - overlap after the last."""
    stride = size - overlap
    last = F.greatest(F.char_length("text") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / stride).cast("int"))
    return docs.select("doc_id", "text", F.explode(starts).alias("chunk_index")).select("doc_id", "chunk_index", F.col("text").substr(F.col("chunk_index") * stride + 1, F.lit(size)).alias("chunk"))


def semantic_chunks(docs: DataFrame, size: int, overlap: int, least: int) -> DataFrame:
    """docs (doc_id, text) as chunks cut at a paragraph, else a sentence, else a space in the last 40 % of ``size``."""

    def cut(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                floor = at + int(size * 0.6)
                end = max((p + len(m) for m in ("\n\n", ". ", " ") if (p := text.rfind(m, floor, end)) >= 0), default=end, key=lambda p: (text[p - 2 : p] == "\n\n", text[p - 2 : p] == ". ", p))
            piece = text[at:end].strip()
            if len(piece) >= least:
                yield piece
            if end == len(text):
                return
            at = max(end - overlap, at + 1)

    def chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, k, c) for i, t in zip(part["doc_id"], part["text"], strict=True) for k, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])

    return docs.mapInPandas(chunks, "doc_id long, chunk_index int, chunk string")


def first_of_equal(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key column, key): the smallest id of each text, compared lower-cased with white space squeezed; partial sums meet hot texts."""
    digest = F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)
    return docs.groupBy(digest.alias("key")).agg(F.min(key).alias(key))


def artefact_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(artefact, state) from recorded and present hashes: pending without a record, stale on a difference, else ready."""
    both = old.withColumnRenamed("hash", "old").join(new.withColumnRenamed("hash", "new"), "artefact", "full")
    state = F.when(F.col("old").isNull(), "pending").when(F.col("new").isNull() | (F.col("old") != F.col("new")), "stale").otherwise("ready")
    return both.select("artefact", state.alias("state"))
