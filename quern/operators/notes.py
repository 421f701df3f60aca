"""Search of notes: the best of several signals, what a note is worth by its kind and state, and a cap for each note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import query_terms
from quern.operators.catalogue import NOT_CURRENT, standing
from quern.operators.library import note_terms

# What confidence and kind of a note add to its score, and what a state that is no longer current takes away.
CONFIDENCE = {"alta": 0.12, "media": 0.06, "baixa": 0.0}
KINDS = {"curada": 0.10, "memoria_validada": 0.12, "memoria_consolidada": 0.08, "conceito_obsidian": 0.05, "experimento_obsidian": 0.05, "literatura_obsidian": -0.04}
SESSIONS = {"sessao_atual": -0.08, "sessao_arquivada": -0.10}
SESSION_ASKED = 0.24
SUPERSEDED = -0.18
OVERLAP = 0.08
LEXICAL = 0.72
CAP, HISTORICAL_CAP = 2, 5


def semantic_signal(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def worth(kind: Column, confidence: Column, status: Column, historical: Column) -> Column:
    """What kind, confidence and state add; sessions count when the question is about what was."""
    add = F.lit(0.0)
    for name, value in KINDS.items():
        add = F.when(kind == name, value).otherwise(add)
    for name, value in SESSIONS.items():
        add = F.when(kind == name, F.when(historical, SESSION_ASKED).otherwise(value)).otherwise(add)
    sure = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        sure = F.when(confidence == name, value).otherwise(sure)
    return add + sure + F.when(standing(status).isin(*NOT_CURRENT), SUPERSEDED).otherwise(0.0)


def search_notes(signals: DataFrame, chunks: DataFrame, questions: DataFrame, n: int = 5) -> DataFrame:
    """(query, chunk, note, score, current, place): the n best chunks of each question, at most two of one note, five if the question is about what was.

    signals is (query, chunk, signal), of which the best counts; chunks (chunk, note, text, kind, confidence,
    status), of which only those with a signal are read further; questions (query, text, historical).
    """
    best = signals.groupBy("query", "chunk").agg(F.max("signal").alias("signal"))
    asked = questions.select("query", "historical", query_terms(F.col("text"), 10_000).alias("_terms"))
    rows = best.join(chunks, "chunk").join(asked, "query")
    shared = F.coalesce(F.size(F.array_intersect("_terms", note_terms(F.col("text")))), F.lit(0))
    score = F.col("signal") + OVERLAP * shared + worth(F.col("kind"), F.col("confidence"), F.col("status"), F.col("historical"))
    rows = rows.select("query", "chunk", "note", "historical", score.alias("score"), (~standing(F.col("status")).isin(*NOT_CURRENT)).alias("current"))
    order = [F.desc(F.round("score", 9)), F.asc("chunk")]
    own = F.row_number().over(Window.partitionBy("query", "note").orderBy(*order))
    kept = rows.withColumn("_own", own).where(F.col("_own") <= F.when(F.col("historical"), HISTORICAL_CAP).otherwise(CAP))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return placed.where(F.col("place") <= n).select("query", "chunk", "note", "score", "current", "place")
