from pyspark.sql import functions as F

from quern.operators import dedup as D

SCHEMA = "id bigint, k string, p int, note string"


def test_uuid_spellings(spark):
    u = "5e1082c0-7ee5-42e3-ac88-8455074cbd1e"
    forms = [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, " " + u, "URN:UUID:" + u.upper()]
    keys = spark.createDataFrame([(f,) for f in forms + [None, "not a uuid", u[:-1]]], "k string").select(D.uuid_key(F.col("k"))).collect()
    assert len({r[0] for r in keys[: len(forms)]}) == 1 and keys[len(forms)][0] is None
    assert len({r[0] for r in keys}) == 4


def test_keeps_exactly_one(spark, rows):
    df = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "a", 2, "z"), (4, None, 1, "n"), (5, None, 1, "n"), (6, "b", None, "q"), (7, "c", 1, None), (8, "c", 1, None)], SCHEMA)
    assert [r[0] for r in rows(D.deduplicate(df, ["k", "p"], "id"))] == [1, 3, 4, 5, 6, 7]
    assert [r[0] for r in rows(D.duplicates(df, ["k", "p"], "id"))] == [2, 8]


def test_full_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1, "x")] * 3 + [(1, "a", 1, "y")], SCHEMA)
    assert D.deduplicate(df, ["k", "p"], "id").count() == 1
    assert D.deduplicate(df.limit(0), ["k"], "id").count() == 0 and D.duplicates(df.limit(0), ["k"], "id").count() == 0


def test_hot_identifier_takes_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_LEAST", 10)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 2))).alias("k"))
    got = {r[0] for r in D.duplicates(df, ["k"], "id").collect()}
    first, expected = {}, set()
    for i, k in sorted(map(tuple, df.collect())):
        if first.setdefault(k, i) != i:
            expected.add(i)
    assert got == expected and D.deduplicate(df, ["k"], "id").count() == len(first)


def test_null_order_comes_last(spark):
    df = spark.createDataFrame([(None, "a", 1, "x"), (2, "a", 1, "y"), (None, "b", 1, "z")], SCHEMA)
    assert [r["note"] for r in D.duplicates(df, ["k"], "id").collect()] == ["x"]
    assert sorted(r["note"] for r in D.deduplicate(df, ["k"], "id").collect()) == ["y", "z"]
