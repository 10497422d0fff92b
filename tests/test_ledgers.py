"""Budgets, keyed fingerprints and first-wins stores against plain versions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from millrace.functions.keyed import fingerprint, hmac_sha256
from millrace.operators import budgets, stores


@pytest.mark.parametrize("key", [b"", b"key", b"k" * 64, b"long" * 40])
def test_hmac_is_that_of_the_library(spark, key):
    texts = ["", "a", "Ünï शु", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", hmac_sha256(key, F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts] + [None]
    got = spark.createDataFrame([(" Some@ID ",)], "t string").select(fingerprint(key, F.col("t"))).first()[0]
    assert got == hmac.new(key, b"some@id", hashlib.sha256).hexdigest()


def test_a_refused_request_uses_up_nothing(spark):
    asked = [(1, "d", "t", 6.0, "reserve"), (2, "d", "t", 5.0, "reserve"), (3, "d", "t", 4.0, "reserve"), (4, "d", "u", 9.0, "reserve"), (5, "d", "u", 3.0, None), (6, "d", "t", 5.0, "refund"), (7, "d", "u", 5.0, "reserve"),
             (8, "d", "u", 0.0, "reserve"), (9, "d", "u", None, "reserve"), (10, None, None, 11.0, "reserve"), (11, None, None, 2.0, "reserve"), (12, None, None, 99.0, "refund"), (13, "d", "u", -4.0, "refund")]
    df = spark.createDataFrame(asked, "id long, day string, who string, units double, action string").withColumn("admitted_by", F.lit("own"))
    got = {r.id: (r.admitted, r.tenant_used, r.global_used) for r in budgets.reserved(df, ["day"], "who", ["id"], "units", 10, 13, F.col("action")).collect()}
    assert got == {
        1: (True, 6, 6), 2: (False, 6, 6), 3: (True, 10, 10), 4: (False, 0, 10), 5: (True, 3, 13), 6: (True, 5, 8), 7: (True, 8, 13), 8: (True, 8, 13), 9: (True, 8, 13),
        10: (False, 0, 0), 11: (True, 2, 2), 12: (True, 0, 0), 13: (True, 8, 13),
    }
    assert budgets.reserved(df.limit(0), ["day"], "who", ["id"], "units", 10, 13).count() == 0


def test_one_large_group_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        df = spark.range(5000).selectExpr("id", "'all' as day", "id % 7 as who", "cast(id * 7919 % 101 as double) as units")
        got = [(r.admitted, r.tenant_used, r.global_used) for r in budgets.reserved(df, ["day"], "who", ["id"], "units", 900, 5000).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used, total, want = [0.0] * 7, 0.0, []
    for i in range(5000):
        u = i * 7919 % 101
        ok = used[i % 7] + u <= 900 and total + u <= 5000
        if ok:
            used[i % 7] += u
            total += u
        want.append((ok, used[i % 7], total))
    assert got == want and not all(w[0] for w in want)


def test_stores_keep_what_came_first(spark):
    stored = spark.createDataFrame([("t", "a", "old"), (None, "n", "old")], "tenant string, k string, v string")
    rows = spark.createDataFrame([(2, "t", "b", "late"), (1, "t", "b", "early"), (1, "t", "a", "new"), (1, "u", "a", "other"), (5, None, "n", "new")], "at long, tenant string, k string, v string")
    got = stores.first_wins(stored, rows, ["tenant", "k"], ["at"]).collect()
    assert {tuple(r) for r in got} == {("t", "a", "old"), (None, "n", "old"), ("t", "b", "early"), ("u", "a", "other")} and len(got) == 4
    listed = rows.select("tenant", fingerprint(b"s", F.col("k")).alias("key_hmac")).where("tenant = 't'")
    seen = spark.createDataFrame([("t", " B "), ("u", "b"), ("t", "c"), ("t", None), (None, "a")], "tenant string, who string")
    assert [r.suppressed for r in stores.suppressed(seen, listed, "tenant", "who", b"s").orderBy("tenant", "who").collect()].count(True) == 1
    gold = spark.createDataFrame([("x", "seed", "official", "B", "X"), ("y", "canary", "third_party", "D", "Y"), ("z", "holdout", "official", "A", "Z")], "asset_key string, split string, relation string, least_grade string, entity_name string")
    look = spark.createDataFrame([("x", "fake x"), ("x", "fake"), ("y", "fake y")], "asset_key string, entity_name string")
    assert {tuple(r) for r in stores.with_canaries(gold, look).collect()} == {("x", "canary", "third_party", "D", "fake"), ("y", "canary", "third_party", "D", "Y"), ("z", "holdout", "official", "A", "Z")}


def test_proposals_are_published_or_dropped_by_run(spark):
    from millrace.operators import graph

    rows = [("a", "B", "r", "v1", "live", "A", "n", "v2", "one"), ("b", "B", "r", None, "live", "C", None, None, "two"), ("c", "B", "r", "v1", "live", None, None, None, None), ("d", "B", "r", "v1", "live", "A", "n", "v2", None)]
    columns = ["asset_id", "grade", "reasons", "scorer_version", "status", "proposed_grade", "proposed_reasons", "proposed_scorer", "proposed_run"]
    stored = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    done = lambda apply, run: {r.asset_id: (r.grade, r.reasons, r.scorer_version, r.proposed_grade) for r in graph.settled_proposals(stored, F.lit(apply), run).collect()}
    assert done(True, "one") == {"a": ("A", "n", "v2", None), "b": ("B", "r", None, "C"), "c": ("B", "r", "v1", None), "d": ("B", "r", "v1", "A")}
    assert done(False, None) == {"a": ("B", "r", "v2", None), "b": ("B", "r", None, None), "c": ("B", "r", "v1", None), "d": ("B", "r", "v2", None)}
    assert done(True, None)["b"] == ("C", "r", None, None)
    urgent = spark.createDataFrame([("a", "D", "x", None), ("b", "C", "x", "hijacked"), ("c", "A", "x", None)], "asset_id string, grade string, reasons string, status string")
    act = lambda **k: {r.asset_id: r.action for r in graph.regraded(stored, urgent, "v2", "now", **k).collect()}
    assert act() == {"a": "published", "b": "published", "c": "parked", "d": "same"}
    assert act(proposed=True) == {"a": "parked", "b": "parked", "c": "parked", "d": "same"} and act(publish=True)["c"] == "published"
