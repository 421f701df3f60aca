"""Texts that differ by a few letters, found without comparing all: shared rare grams, then edit distance.

Two texts within ``most`` edits share one of their first ``GRAM * most + 1`` grams, when
grams stand from the rarest to the commonest and equal ones in a text are told apart. So
only texts that meet there, at nearly the same place and length, are compared. Texts too
short to have that many grams are matched by what is left of them after deletions. Equal
texts are one text; null and empty ones are like none.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import searchable
from quern.sources.shared import staged

GRAM = 2
RELATED = 0.72


def gram_rows(texts: DataFrame) -> DataFrame:
    """(text, len, pos, gram, k): the padded grams of each text; k tells equal ones apart."""
    padded = F.concat(F.repeat(F.lit("\x02"), GRAM - 1), F.col("text"), F.repeat(F.lit("\x03"), GRAM - 1))
    grams = F.transform(F.sequence(F.lit(1), F.col("len") + (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM)))
    rows = texts.select("text", "len", F.posexplode(grams).alias("pos", "gram"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("text", "gram").orderBy("pos")))


def deletions(text: Column, most: int) -> Column:
    """What is left of a short text after up to ``most`` deletions, itself included."""
    left = F.array(text)
    for _ in range(most):
        shorter = F.flatten(F.transform(left, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))))
        left = F.array_distinct(F.concat(left, shorter))
    return left


def like_pairs(texts: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance) of all distinct texts (text) with a < b within ``most`` edits."""
    prefix = GRAM * most + 1
    rows = staged(texts.where(F.length("text") > 0).select("text").distinct().withColumn("len", F.char_length("text")), "like-texts")
    grams = gram_rows(rows.where(F.col("len") + GRAM - 1 >= prefix))
    uses = grams.groupBy("gram", "k").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("text").orderBy("uses", "gram", "k")
    first = staged(grams.join(uses, ["gram", "k"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= prefix).select("text", "len", "pos", "gram", "k"), "like-prefixes")
    short = rows.where(F.col("len") + GRAM - 1 < prefix + most).select("text", F.explode(deletions(F.col("text"), most)).alias("rest"))
    other = lambda df: df.select(*[F.col(c).alias(c if c in ("gram", "k", "rest") else f"{c}2") for c in df.columns])
    near = (F.col("text") < F.col("text2")) & (F.abs(F.col("len") - F.col("len2")) <= most) & (F.abs(F.col("pos") - F.col("pos2")) <= most)
    met = first.join(other(first), ["gram", "k"]).where(near).select("text", "text2")
    met = met.unionByName(short.join(other(short), "rest").where("text < text2").select("text", "text2")).distinct()
    found = met.select(F.col("text").alias("a"), F.col("text2").alias("b"), F.levenshtein("text", "text2", most).alias("distance"))
    return found.where(F.col("distance") >= 0)


def titles_related(reference: Column, candidate: Column) -> Column:
    """Whether one folded title holds the other, or their matching blocks make up RELATED of both; blank titles are related to none."""

    @F.pandas_udf("boolean")
    def related(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> bool:
            low, high = sorted((x or "", y or ""), key=len)
            return bool(low) and (low in high or SequenceMatcher(None, x, y).ratio() >= RELATED)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return related(searchable(reference), searchable(candidate))
