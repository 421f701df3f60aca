"""What queries over the lexical index exchange, against the texts they read."""

import os

import pytest
from pyspark.sql import functions as F
from test_lexical import written

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES = ["rerank", "variation_search", "hybrid_search", "rrf_fusion", "note_search", "ir_grouped_gain", "per_note_cap", "budget_prefix", "round_robin_pack", "greedy_assignment"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with documents in as many files as need no dealing out, and the bytes of their texts."""
    root = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SMALL):
        if name != "documents.parquet":
            os.symlink(f"{SMALL}/{name}", root / name)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(8, "doc_id").write.parquet(f"{root}/documents.parquet")
    return root, docs.agg(F.sum(F.octet_length("text"))).first()[0]


@pytest.mark.parametrize("name", QUERIES)
def test_little_is_exchanged(spark, tables, name):
    root, text = tables
    before = written(spark)
    rows = entry.queries()[name](spark, f"{root}{'/.' * (1 + QUERIES.index(name))}").collect()  # an index of its own
    assert rows and written(spark) - before < 1.5 * text  # 2.8 to 3.5 times the texts when tokens met by document
