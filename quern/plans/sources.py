"""Raw windows by row number, and documents read as the notes of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.base import Plan
from quern.plans.texts import MASK
from quern.sources import slices as L
from quern.sources import vault as V
from quern.sources.tables import table

plan = Plan()


@plan.query("""with w as (select user_id as win, min(event_id) as start from events group by user_id), e as (select win, event_id - start as place, value from w join events on event_id >= start and event_id < start + 200)
select win as "window", count(*) as n, round(sum(value), 6) as total, round(sum(value * place), 4) as weighted from e group by win""")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the 200 raw rows of the file from their first event on; rows stand by event_id, so its number is the row's."""
    path = f"{sf_dir}/events.parquet"
    rows = L.numbered_rows(spark, path, ["value"])
    file = table(spark, sf_dir, "events").select(F.col("_metadata.file_name").alias("file"), "user_id", F.col("_metadata.row_index").alias("row"))
    windows = file.groupBy("file", F.col("user_id").alias("window")).agg(F.min("row").alias("start")).withColumn("stop", F.col("start") + 200)
    found = L.slices(rows, windows, 200)
    return found.groupBy("window").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("place")), 4).alias("weighted"))


@plan.query("""with d as (select doc_id, text, lang, source, quality from documents left join (select doc_id, min(quality) as quality from labels group by doc_id) using (doc_id)),
n as (select doc_id, case when lang = 'es' then 'Templates/' else 'notes/' end || coalesce(source, 'none') || '/' || doc_id || case when doc_id % 50 = 7 then '.txt' else '.md' end as path,
  '---' || chr(10) || 'titulo: Note ' || doc_id || chr(10) || 'status: ' || case when quality = 0 then 'Private' else 'ativo' end || chr(10) || '---' || chr(10) || coalesce(text, '') as content, lang, quality, text from d)
select doc_id, case when path like '%.txt' then 'kind' when lang = 'es' then 'folder' when quality = 0 then 'private' when trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = '' then 'empty' end as left_out, 'Note ' || doc_id as title, case when quality = 0 then 'private' else 'ativo' end as status, sha256(content) as sha256 from n""".replace("'empty' end as", f"'empty' when {MASK.replace('text', 'content')} <> content then 'secret' end as"))
def vault_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: their language is the folder, bad quality makes them private, and those with secrets are left out."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    name = F.concat(F.when(F.col("lang") == "es", "Templates/").otherwise("notes/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 7, ".txt").otherwise(".md"))
    head = F.concat(F.lit("---\ntitulo: Note "), F.col("doc_id").cast("string"), F.lit("\nstatus: "), F.when(F.col("quality") == 0, "Private").otherwise("ativo"), F.lit("\n---\n"))
    notes = d.select("doc_id", name.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    out = V.scan(notes.select("path", "content"))
    number = F.regexp_extract("path", r"/(\d+)\.\w+\z", 1).cast("long")
    return out.select(number.alias("doc_id"), "left_out", "title", "status", "sha256")
