"""Titles that are nearly the same, over the documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import searchable
from quern.operators import likeness as K
from quern.plans.base import Plan
from quern.plans.texts import SEARCH
from quern.sources.tables import table

plan = Plan()


@plan.query(f"""with t as (select distinct left({SEARCH.replace('lower(text)', 'lower(left(text, 48))')}, 40) as t from documents)
select a.t as a, b.t as b, levenshtein(a.t, b.t) as distance from t a join t b on a.t < b.t and abs(length(a.t) - length(b.t)) <= 2 where length(a.t) > 0 and levenshtein(a.t, b.t) <= 2""")
def like_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents, as titles, that differ by at most two edits."""
    title = F.substring(searchable(F.substring("text", 1, 48)), 1, 40)
    return K.like_pairs(table(spark, sf_dir, "documents").select(title.alias("text"))).select("a", "b", F.col("distance").cast("long").alias("distance"))


@plan.query()
def page_titles_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's title and the words of its address tell of the same thing."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", K.titles_related(F.regexp_replace("url", "[/._-]+", " "), title).alias("related"))
