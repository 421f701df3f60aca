"""Rows of files by their numbers: windows of raw samples are read from where they stand, without numbering a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of Parquet files with ``file`` and ``row``, the number of a row in its file, which the reader knows."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def slices(rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(window, file, place, ...) of rows (file, row, ...) for windows (window, file, start, stop), each of at most ``width`` rows from start up to before stop.

    Rows and windows meet by file and stretch of ``width`` rows: a window lies in two stretches at most, so
    neither side is compared with all of the other, however many windows a file has or how they overlap.
    """
    stretch = F.floor(F.col("row") / width)
    at = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    wanted = windows.where("stop > start").select("window", "file", "start", "stop", F.explode(at).alias("_at"))
    met = rows.withColumn("_at", stretch).join(wanted, ["file", "_at"]).where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("stop")))
    return met.withColumn("place", F.col("row") - F.col("start")).drop("_at", "start", "stop", "row")


def incomplete(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, wanted, held) of windows whose rows are not all there."""
    held = found.groupBy("window").agg(F.count("*").alias("held"))
    out = windows.join(held, "window", "left").select("window", (F.col("stop") - F.col("start")).alias("wanted"), F.coalesce("held", F.lit(0)).alias("held"))
    return out.where("held <> wanted")
