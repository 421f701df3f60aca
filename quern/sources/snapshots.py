"""Portable snapshots: gzip JSON lines with a manifest line, export, import, migration, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, document_id string, chunk_index long, raw_text string, retrieval_text string, metadata map<string,string>, embedding array<double>"


def row_digest(*columns: str) -> Column:
    """sha256 of a row's values; nulls and their places count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def content_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows and a digest that does not depend on order.

    Row digests are summed as four 52-bit parts, so nothing but four numbers a task meets in the end.
    """
    digest = row_digest(*columns)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws("|", "rows", *[f"p{i}" for i in range(4)]), 256).alias("digest"))


def export_snapshot(records: DataFrame, path: str, version: int = 2) -> None:
    """Write records as gzip JSON lines with a manifest beside them; a failed write leaves no manifest."""
    records.write.mode("error").json(f"{path}/chunks", compression="gzip")
    written = read_chunks(records.sparkSession, path)
    manifest = content_digest(written, "id", "raw_text").withColumn("schema_version", F.lit(version))
    manifest.coalesce(1).write.mode("error").json(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{path}/chunks")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rows long, digest string, schema_version int").json(f"{path}/manifest")


def validate_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row a broken rule: counts, digest, unique ids, complete records."""
    chunks, manifest = read_chunks(spark, path), read_manifest(spark, path).first()
    now = content_digest(chunks, "id", "raw_text").first()
    repeated = chunks.groupBy("id").count().where("count > 1").count()
    broken = chunks.where("id is null or document_id is null or coalesce(raw_text, '') = ''").count()
    found = [("rows", manifest["rows"] != now["rows"]), ("digest", manifest["digest"] != now["digest"]), ("unique_id", repeated > 0), ("complete", broken > 0)]
    return spark.createDataFrame([(n,) for n, bad in found if bad], "rule string")


def import_snapshot(current: DataFrame, incoming: DataFrame, merge: bool) -> DataFrame:
    """The collection after an import: strict needs an empty one, merge appends ids it lacks."""
    if not merge:
        if not current.isEmpty():
            raise ValueError("a strict import needs an empty collection")
        return incoming
    return current.unionByName(incoming.join(current.select("id"), "id", "left_anti"), allowMissingColumns=True)


def migrate_v1(old: DataFrame) -> DataFrame:
    """Records of version 1 (id, document, metadata, embedding) as version 2, text unchanged."""
    return old.select(
        "id",
        F.split("id", "__chunk_")[0].alias("document_id"),
        F.try_element_at(F.split("id", "__chunk_"), F.lit(2)).try_cast("long").alias("chunk_index"),
        F.col("document").alias("raw_text"),
        F.col("document").alias("retrieval_text"),
        "metadata",
        "embedding",
    )


def update_metadata(records: DataFrame, patches: DataFrame, file_key: str = "file") -> DataFrame:
    """records with the metadata of patches (file, patch map) laid over theirs."""
    joined = records.withColumn("_file", F.col("metadata")[file_key]).join(patches.select(F.col("file").alias("_file"), "patch"), "_file", "left")
    kept = F.map_filter("metadata", lambda k, _: ~F.coalesce(F.map_contains_key("patch", k), F.lit(False)))
    return joined.withColumn("metadata", F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "patch"))).drop("_file", "patch")


def upsert(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changes replace those of current with the same key; new ones are added."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def sync(current: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, action) for an incremental sync by content hash: insert, update, keep or delete.

    current and seen are (id, hash); ids of failed (id) could not be read and are kept.
    """
    both = current.withColumnRenamed("hash", "old").join(seen.withColumnRenamed("hash", "new"), "id", "full").join(failed.select("id", F.lit(True).alias("failed")), "id", "left")
    action = F.when(F.col("failed") | (F.col("old") == F.col("new")), "keep").when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select("id", action.alias("action"))
