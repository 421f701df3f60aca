"""fidelity_join compares users with other users: its status can be each of the three."""

from oracle import same

from quern import registry

EVENTS = [
    # the even users' mean lies between the odd users' means, that of the odd ones beyond the even users'
    *[("both", u, v) for u, v in ((1, 0.0), (2, 1.0), (3, 4.0), (4, 2.0), (3, 3.0))],
    # odd users lie wide apart, even ones beyond them
    *[("apart", u, v) for u, v in ((1, 1.0), (3, 2.0), (2, 5.0), (4, 6.0), (None, 7.0))],
    *[("even", u, v) for u, v in ((2, 1.0), (4, None))],
    *[(None, u, v) for u, v in ((2, 1.0), (5, 1.0), (-7, 2.0))],
]


def test_fidelity_statuses(spark, tmp_path):
    spark.createDataFrame(EVENTS, "event_type string, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "made"))
    (path,) = (tmp_path / "made").glob("*.parquet")
    path.rename(tmp_path / "events.parquet")
    rows = {(r["model"], r["half"]): (r["n"], r["low"], r["high"], r["status"]) for r in registry.QUERIES["fidelity_join"](spark, str(tmp_path)).collect()}
    assert rows == {
        ("both", 0): (2, 0.0, 3.5, "inside"),
        ("both", 1): (2, 1.0, 2.0, "outside"),
        ("apart", 0): (2, 1.0, 2.0, "outside"),
        ("apart", 1): (3, 5.0, 7.0, "outside"),
        ("even", 0): (0, None, None, "missing"),
        (None, 0): (2, 1.0, 2.0, "inside"),
        (None, 1): (1, 1.0, 1.0, "outside"),
    }
    same(spark, str(tmp_path), registry.QUERIES["fidelity_join"], registry.ORACLE_SQL["fidelity_join"])
