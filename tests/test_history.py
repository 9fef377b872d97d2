import datetime as dt

from pyspark.sql import functions as F

from quern.functions.text import fold_name
from quern.operators.history import versions

D = lambda m, d=1: dt.date(2025, m, d)
SCHEMA = "cid bigint, on_date date, city string, seg string, loaded timestamp_ntz, effective_date string"


def run(spark, data):
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    v = versions(df, "cid", "on_date", {"city": fold_name(F.col("city")), "seg": F.col("seg")}, "loaded")
    return sorted((r["cid"], str(r["effective_date"]), str(r["end_date"]), r["is_current"]) for r in v.collect())


def test_islands_nulls_and_spelling(spark):
    L = dt.datetime(2025, 1, 1)
    data = [
        (1, D(1), "Đà Nẵng", "A", L), (1, D(2), "DA  NANG ", "A", L), (1, D(3), None, "A", L), (1, D(4), "Huế", None, L), (1, D(5), "hue", "B", L), (1, D(7), "da nang", "B", L),
        (2, D(1), "X", "A", L), (2, D(1), "Y", "A", L + dt.timedelta(1)), (2, D(1), "Y", "A", L + dt.timedelta(1)), (2, D(3), "Y", "A", L),
        (None, D(1), "X", "A", L), (3, None, "X", "A", L),
    ]
    assert run(spark, data) == [(1, "2025-01-01", "2025-03-31", False), (1, "2025-04-01", "2025-04-30", False), (1, "2025-05-01", "2025-06-30", False), (1, "2025-07-01", "None", True), (2, "2025-01-01", "None", True)]
    assert run(spark, []) == []


def test_unknown_first_value(spark):
    assert run(spark, [(1, D(1), None, "A", None), (1, D(2), "X", "A", None)]) == [(1, "2025-01-01", "2025-01-31", False), (1, "2025-02-01", "None", True)]


def test_folding(spark):
    forms = ["Thạnh Phú Đông", "thanh  phu dong", " THẠNH PHÚ ĐÔNG ", "Thạnh Phú Đông"]
    assert {r[0] for r in spark.createDataFrame([(f,) for f in forms], "c string").select(fold_name(F.col("c"))).collect()} == {"thanhphudong"}
