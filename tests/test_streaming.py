"""Streams over the event files give what batches over the table give."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return path


def ran(spark, tmp_path, stream, mode="append"):
    flows.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode)
    return spark.read.parquet(str(tmp_path / "out" / "batch=*"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_verdicts_match_the_window(spark, folder, tmp_path):
    got = ran(spark, tmp_path, flows.verdicts(flows.read(spark, folder, 10)))
    want = flows.verdicts_of_batch(spark.read.parquet(folder))
    assert rows(got, "user_id", "event_id", "verdict") == rows(want, "user_id", "event_id", "verdict")


def test_state_of_verdicts_ends_and_goes_on_after_a_restart(spark, tmp_path):
    days = [(1, 0, 7, "a"), (2, 1, 7, "a"), (3, 1, 8, "x"), (4, 30, 7, "b"), (5, 31, 9, "c"), (6, 60, 9, "c"), (7, 90, 8, "x"), (8, 91, 9, "d")]
    make = lambda rows, n: spark.createDataFrame(rows, "event_id long, h long, user_id long, event_type string").selectExpr(
        "event_id", "timestamp '2024-01-01 00:00:00.5' + make_interval(0, 0, 0, 0, h) as ts", "user_id", "event_type", "1.0D as value", "'' as props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ttl = timedelta(hours=10)
    for n, row in enumerate(days):
        make([row], n)
        if n in (3, 7):  # two runs from one checkpoint
            stream = flows.verdicts(flows.read(spark, str(tmp_path / "in"), 1), ttl, "1 hour")
            got = ran(spark, tmp_path, stream)
    want = flows.verdicts_of_batch(spark.read.parquet(str(tmp_path / "in")), ttl)
    assert rows(got, "user_id", "event_id", "verdict") == rows(want, "user_id", "event_id", "verdict")
    assert {r.event_id: r.verdict for r in got.collect()} == {1: "new", 2: "duplicate", 3: "new", 4: "new", 5: "new", 6: "new", 7: "new", 8: "new"}
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state")).count()
    assert left <= 2  # of the last ten hours and a watermark, not of all three users


def test_closed_windows_match_the_batch(spark, folder, tmp_path):
    got = ran(spark, tmp_path, flows.windowed(flows.read(spark, folder, 10), "1 hour"))
    want = flows.windowed(spark.read.parquet(folder), "1 hour")
    closed = got.agg(F.max("start")).first()[0]
    columns = ("start", "event_type", "n")
    assert got.count() > 0
    assert rows(got, *columns) == rows(want.where(F.col("start") <= closed), *columns)


def test_repeats_within_the_watermark_go(spark, folder, tmp_path):
    stream = flows.read(spark, folder, 10)
    got = ran(spark, tmp_path, flows.deduplicated(stream.union(stream)))
    assert got.count() == spark.read.parquet(folder).select("event_id").distinct().count()


def test_undated_rows_have_a_way_of_their_own(spark):
    events = spark.createDataFrame([(1, None), (2, "2024-01-01 00:00:00")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.event_id for r in flows.dated(events).collect()] == [2]
    assert [r.event_id for r in flows.undated(events).collect()] == [1]
