"""Notes of a vault: what is left out and why, and the kept ones with title, state, links and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import fold, has_secret, wikilinks
from quern.operators.catalogue import YES, standing
from quern.sources.tables import front_matter

# Folders of a vault that hold no notes, and states of private ones.
LEFT_OUT = [".obsidian", ".trash", ".git", "templates", "anexos", "attachments", "node_modules"]
PRIVATE = ["privado", "private", "confidencial"]


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the Markdown files under root, by path from there; the glob reaches the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    inside = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rpartition("/")[2].replace(".", "\\.") + "/", "")
    return files.select(inside.alias("path"), F.decode("content", "UTF-8").alias("content"))


def yes(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*YES)


def scan(notes: DataFrame, index_key: str = "index") -> DataFrame:
    """notes (path, content) with ``left_out`` (null: kept), title, status, links and sha256; a note is left out by the first reason that holds.

    ``index_key`` is the key of the front matter by which a note asks not to be indexed.

    Reasons: not Markdown, a folder that holds no notes, not for the index, private, empty, a secret in it.
    """
    rows = front_matter(notes)
    meta = lambda key: F.try_element_at("meta", F.lit(key))
    folders = F.transform(F.split("path", "/"), fold)
    status = standing(meta("status"))
    body = F.trim(F.regexp_replace("body", r"^\s+|\s+\z", ""))
    why = (
        F.when(~F.lower("path").endswith(".md"), "kind")
        .when(F.arrays_overlap(folders, F.array(*[F.lit(f) for f in LEFT_OUT])), "folder")
        .when(meta(index_key).isNotNull() & ~yes(meta(index_key)), "not_indexed")
        .when(F.coalesce(yes(meta("privado")), F.lit(False)) | status.isin(*PRIVATE), "private")
        .when(F.coalesce(body, F.lit("")) == "", "empty")
        .when(has_secret(F.col("content")), "secret")
    )
    heading = F.nullif(F.regexp_extract("body", r"(?m)^# +(.+?)\s*$", 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(?i)\.md\z", "")
    title = F.coalesce(F.nullif(F.trim(meta("titulo")), F.lit("")), heading, stem)
    return rows.select("path", why.alias("left_out"), title.alias("title"), status.alias("status"), wikilinks(F.col("body")).alias("links"), F.sha2("content", 256).alias("sha256"), "body")
