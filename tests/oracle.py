"""Compare a query with its DuckDB text on the same tables, as the driver does."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) else repr(v)
    return v if isinstance(v, int) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(_plain(x) for x in r) for r in frame[cols].itertuples(index=False)), key=repr)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    different = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not different, different[:3]
