"""Table sources: the Parquet tables by name, and readers for the other formats served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out to all cores by key where it comes in fewer splits than there are; a large table stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt out for work on its texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV source with a declared schema that fails on rows that break it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, sep=sep)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files, such as Markdown notes."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, suffix: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, length, sha256, content) of files, optionally of one suffix and up to a size."""
    files = spark.read.format("binaryFile").load(path)
    if suffix:
        files = files.where(F.lower("path").endswith(suffix.lower()))
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def is_pdf(content) -> object:
    """Whether bytes start like a PDF."""
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def preview(df: DataFrame, rows: int = 40) -> tuple[DataFrame, int, int]:
    """The first rows for display, with the whole table's row and column counts."""
    return df.limit(rows), df.count(), len(df.columns)


def front_matter(notes: DataFrame) -> DataFrame:
    """notes (path, content) with ``meta`` (a map of the leading key: value block) and ``body``."""
    block = r"(?s)^\s*---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    head = F.regexp_extract("content", block, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1)).alias("v")))
    seen = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    body = F.when(F.col("content").rlike(block), F.regexp_extract("content", block, 2)).otherwise(F.col("content"))
    return notes.withColumn("meta", F.map_from_entries(seen)).withColumn("body", body)
