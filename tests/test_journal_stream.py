"""The journal as a stream: counters and timers over micro-batches."""

import datetime

from quern.streaming import streams


def test_sessions_become_due_once(spark, tmp_path):
    at = lambda hours: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)
    batches = [
        [(1, at(i)) for i in range(3)] + [(2, at(0))],
        [(1, at(4)), (1, at(5)), (3, at(30))],
        [(3, at(90)), (1, at(91))],
        [(4, at(400))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "session long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    seen = []
    for i in range(len(batches)):  # one file a micro-batch, in order
        source = spark.readStream.schema("session long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / f"b={i}"))
        query = streams.journal(source, "session", "ts", "1 hour", 4, 48).writeStream.format("memory").queryName(f"journal_{i}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted((r["session"], r["n"], r["reason"]) for r in spark.table(f"journal_{i}").collect()))
    assert seen[0] == [] and seen[1] == [] and seen[3] == []
    whole = spark.readStream.schema("session long, ts timestamp, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("b")
    query = streams.journal(whole, "session", "ts", "1 hour", 4, 48).writeStream.format("memory").queryName("journal_all").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [(r["session"], r["n"], r["reason"]) for r in spark.table("journal_all").collect()]
    assert (1, 5, "count") in rows and (2, 1, "wait") in rows
    assert len({(s, r) for s, _, r in rows}) == len(rows)
