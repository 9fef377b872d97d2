import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import incremental as I
from quern.plans.runtime import scratch

T = lambda h: dt.datetime(2025, 6, 1) + dt.timedelta(hours=h)
ROWS = "source string, record_id bigint, updated_at timestamp_ntz, ingested_at timestamp_ntz"
RUNS = "source string, run_id string, attempt int, started_at timestamp_ntz, last_updated timestamp_ntz, run_status string"


def brute(rows, runs):
    taken = set()
    for s in {r[0] for r in runs}:
        lo, first = None, True
        for _, _, _, st, hi, _ in sorted((r for r in runs if r[0] == s and r[5] == "success"), key=lambda r: r[3]):
            for a, b, u, i in rows:
                if a == s and u and i and hi and (first or u > lo) and u <= hi and i <= st:
                    taken.add((a, b, u))
            lo, first = hi, False
    return sorted({(a, b, u) for a, b, u, _ in rows if u} - taken)


def test_pending_against_brute_force(spark):
    runs = [("o", "1", 1, T(10), T(9), "success"), ("o", "2", 1, T(20), T(19), "failed"), ("o", "3", 1, T(40), T(39), "success"), ("o", "4", 1, T(60), T(30), "success"), ("o", "5", 1, T(80), T(78), "success"), ("c", "1", 1, T(50), T(45), "success"), ("c", "2", 1, T(70), None, "killed")]
    rows = [(s, k % 17, T(k * 1.7), T(k * 1.7 + (25 if k % 5 == 0 else 0.1))) for k in range(50) for s in ("o", "c")]
    rows += [("o", 99, None, T(1)), ("o", 98, T(3), None), ("o", 3, T(3 * 1.7), T(90)), ("x", 1, T(1), T(2))]
    got = I.pending_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS))
    assert sorted(map(tuple, got.collect())) == brute(rows, runs)


def test_pending_without_runs_or_rows(spark):
    rows, runs = spark.createDataFrame([("o", 1, T(1), T(1))], ROWS), spark.createDataFrame([], RUNS)
    assert I.pending_changes(rows, runs).count() == 1
    assert I.pending_changes(rows.limit(0), runs).count() == 0
    assert [tuple(r) for r in I.next_watermarks(runs, rows.select("source", "record_id", "updated_at"), ["o"]).collect()] == [("o", None, 1, T(1))]


def test_fingerprints_ignore_order_and_count_repeats(spark):
    a = spark.createDataFrame([("d", 1, None), ("d", 2, "x"), (None, 3, "y")], "p string, a int, b string")
    one = lambda d: sorted(map(tuple, I.fingerprints(d, ["p"]).collect()), key=str)
    assert one(a) == one(a.orderBy(F.desc("a")).repartition(3))
    assert one(a) != one(a.union(a.where("a = 2")))


def test_refresh_touches_only_changed_partitions_and_survives_a_crash(spark):
    def src(rows):
        return spark.createDataFrame(rows, "day string, v int")

    seen = []

    def compute(d):
        seen.append(sorted(r[0] for r in d.select("day").distinct().collect()))
        return d.groupBy("day").agg(F.sum("v").alias("total"))

    t = I.IncrementalTable(spark, scratch(spark, "t"), ["day"])
    t.refresh(src([("a", 1), ("b", 2), ("b", 3)]), compute)
    read = lambda: sorted((r["day"], r["total"]) for r in t.read().collect())
    assert read() == [("a", 1), ("b", 5)]
    changed = src([("a", 1), ("b", 2), ("c", 7)])
    with pytest.raises(RuntimeError):
        t.refresh(changed, compute, fail_before_commit=True)
    t.refresh(changed, compute)
    assert read() == [("a", 1), ("b", 2), ("c", 7)] and seen == [["a", "b"], ["b", "c"], ["b", "c"]]
    assert t.refresh(changed, compute).count() == 0
    t.refresh(src([("c", 7)]), compute)
    assert read() == [("c", 7)]


def test_a_changed_partition_without_rows_and_a_gone_one_are_emptied(spark):
    t = I.IncrementalTable(spark, scratch(spark, "t"), ["day"])
    src = lambda rows: spark.createDataFrame(rows, "day string, v int")
    compute = lambda d: d.where("v > 0")
    read = lambda: sorted((r["day"], r["v"]) for r in t.read().collect())
    t.refresh(src([("a", 1), ("b:x", 2), ("c%20=d", 3)]), compute)
    assert read() == [("a", 1), ("b:x", 2), ("c%20=d", 3)]
    t.refresh(src([("a", -1), ("c%20=d", 3)]), compute)
    assert read() == [("c%20=d", 3)]
    t.refresh(src([]), compute)
    assert read() == []


def test_null_partition(spark):
    t = I.IncrementalTable(spark, scratch(spark, "t"), ["day"])
    src = lambda rows: spark.createDataFrame(rows, "day string, v int")
    t.refresh(src([(None, 1), ("a", 2)]), lambda d: d)
    t.refresh(src([("a", 2)]), lambda d: d)
    assert [(r["day"], r["v"]) for r in t.read().collect()] == [("a", 2)]
