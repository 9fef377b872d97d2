"""Operators against brute force on small tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import delta, graph, layout, provenance as P, quality, sequences, sketches, temporal, versions
from quern.plans.ordering import range_sorted, with_running
from quern.plans.runtime import scratch

T = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)


def test_running_totals_over_ranges(spark):
    df = spark.createDataFrame([(i % 3, i * 37 % 101, 1) for i in range(100)], "g int, v int, one int")
    got = {(r["g"], r["v"]): r["n"] for r in with_running(range_sorted(df, [F.col("g"), F.col("v")], 5), {"n": "one"}, ["g"]).collect()}
    assert got == {(g, v): sum(1 for i in range(100) if i % 3 == g and i * 37 % 101 <= v) for g in range(3) for v in [i * 37 % 101 for i in range(100) if i % 3 == g]}


def test_asof_ties_lookback_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", T(10)), (2, "a", T(5)), (3, None, T(10)), (4, "b", T(100)), (5, "a", None)], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", T(10), 1, "late"), ("a", T(10), 0, "early"), ("b", T(1), 0, "old"), (None, T(1), 0, "none"), ("a", T(11), 2, "after")], "k string, ts timestamp_ntz, arr int, v string")
    got = {r["id"]: r["r_v"] for r in temporal.asof_join(left, right, ["k"], "ts", "ts", ["v"], F.expr("interval 50 seconds"), "arr").collect()}
    assert got == {1: "late", 2: None, 3: None, 4: None, 5: None}


def test_session_gap_is_inclusive(spark):
    df = spark.createDataFrame([("u", T(0), 1), ("u", T(60), 2), ("u", T(121), 3), ("u", None, 4)], "u string, ts timestamp_ntz, i int")
    assert {r["i"]: r["session_no"] for r in temporal.sessions(df, "u", "ts", 60, "i").collect()} == {1: 1, 2: 1, 3: 2, 4: None}


def test_exponential_mean(spark):
    vals = [3.0, 5.0, 4.0, 8.0, 2.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(vals)] + [("short", 0, 1.0)], "k string, i int, v double")
    e, out = sum(vals[:3]) / 3, []
    out.append(e)
    for v in vals[3:]:
        e = 0.5 * v + 0.5 * e
        out.append(e)
    got = sorted((r["i"], r["ema"]) for r in temporal.exponential_mean(df, ["k"], ["i"], "v", 3).collect())
    assert [i for i, _ in got] == [2, 3, 4] and all(abs(a - b) < 1e-9 for (_, a), b in zip(got, out))


def test_graph_operators(spark):
    rnd = random.Random(3)
    es = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(70)} | {(100, 101), (101, 102)}
    df = spark.createDataFrame(sorted(es), "src bigint, dst bigint")
    und = {(min(e), max(e)) for e in es if e[0] != e[1]}
    tri = {t for t in itertools.combinations(sorted({v for e in und for v in e}), 3) if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= und}
    assert {tuple(r) for r in graph.triangles(df).collect()} == tri
    comp = {v: v for e in und for v in e}
    for _ in range(60):
        for a, b in und:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["v"]: r["component"] for r in graph.components(df).collect()} == comp
    ranks = {r["v"]: r["rank"] for r in graph.pagerank(df, 30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    vs = sorted({v for e in es for v in e})
    pr = {v: 1 / len(vs) for v in vs}
    outs = {v: [b for a, b in es if a == v] for v in vs}
    for _ in range(30):
        hang = sum(pr[v] for v in vs if not outs[v])
        pr = {v: 0.15 / len(vs) + 0.85 * (sum(pr[a] / len(outs[a]) for a, b in es if b == v) + hang / len(vs)) for v in vs}
    assert all(abs(ranks[v] - pr[v]) < 1e-9 for v in vs)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src bigint, dst bigint")
    assert {r["component"] for r in graph.components(path).collect()} == {0}
    assert graph.is_cyclic([{"a", "b"}, {"b", "c"}, {"a", "c"}]) and not graph.is_cyclic([{"a", "b"}, {"b", "c"}, {"c", "d"}])


def test_cascade(spark):
    ex = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 1.5), (3, 4, 0.1)], "src bigint, dst bigint, amount double")
    buf = spark.createDataFrame([(2, 4.0), (3, 2.0), (4, 1.0)], "v bigint, buffer double")
    assert {tuple(r) for r in graph.cascade(ex, buf, spark.createDataFrame([(1,)], "v bigint")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_delta_join_equals_recompute(spark):
    a0, a1 = [(1, "x"), (2, "y"), (2, "y")], [(2, "y"), (3, "z")]
    b0, b1 = [(1, 10), (2, 20)], [(2, 20), (2, 21), (3, 30)]
    A, B = "k int, l string", "k int, r int"

    def rel(rows, schema):
        return delta.consolidate(delta.signed(spark.createDataFrame(rows, schema)))

    def diff(old, new, schema):
        return delta.consolidate(rel(new, schema).unionByName(rel(old, schema).withColumn("_diff", -F.col("_diff"))))

    def full(x, y):
        j = rel(x, A).withColumnRenamed("_diff", "p").join(rel(y, B).withColumnRenamed("_diff", "q"), "k")
        return j.select("k", "l", "r", (F.col("p") * F.col("q")).alias("_diff"))

    change = delta.joined(rel(a0, A), diff(a0, a1, A), rel(b0, B), diff(b0, b1, B), ["k"])
    got = delta.consolidate(full(a0, b0).unionByName(change.select("k", "l", "r", "_diff")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full(a1, b1).collect()))


def test_histograms(spark):
    vals = [1, 1, 1, 2, 3, 10, 11, 50, 51, 52]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v int")
    depth = sorted(map(tuple, quality.equi_depth(df, "v", 4).collect()))
    s = sorted(vals)
    assert depth == [(b, len(g), g[0], g[-1]) for b, g in ((i, s[i * 2 : (i + 1) * 2] if i < 3 else s[6:]) for i in range(4))]
    assert sorted(map(tuple, quality.max_diff(df, "v", 3).collect())) == [(0, 5, 1.0, 3.0), (1, 2, 10.0, 11.0), (2, 3, 50.0, 52.0)]
    assert quality.equi_width(spark.createDataFrame([(5,), (5,)], "v int"), "v", 7).collect()[0]["n"] == 2


def test_versions(spark):
    t = versions.VersionedTable(spark, scratch(spark, "v"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    t.append(df)
    t.append(spark.createDataFrame([(3, "c", 9)], "k int, s string, extra int"))
    t.delete("k = 1")
    assert t.read(1).count() == 2 and t.read(2).columns == ["k", "s", "extra"] and t.read().count() == 2
    assert sorted(r["_change"] for r in t.changes(2, 3).collect()) == ["delete"]
    t.rollback(1)
    assert t.read().count() == 2 and len(t.vacuum(1)) == 2 and t.read().count() == 2


def test_compacted_log_and_changed_columns(spark):
    log = spark.createDataFrame([(1, 1, "c"), (1, 2, "d"), (2, 1, "d"), (3, 1, "c"), (3, 2, "d"), (3, 3, "c")], "k int, pos int, op string")
    assert sorted(map(tuple, versions.compact_log(log, ["k"], ["pos"], "op").collect())) == [(1, 2, "d"), (3, 3, "c")]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": None})], "x map<string,string>, y map<string,string>")
    assert m.select(versions.changed_columns("x", "y")).collect()[0][0] == ["b"]


def test_provenance(spark):
    r = P.annotate(spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "a int, b int"), F.array(F.array(F.concat(F.lit("t"), F.col("b").cast("string")))))
    why = {x["a"]: x["_k"] for x in P.project(r, ["a"], P.WHY).collect()}
    assert why == {1: [["t10"], ["t20"]], 2: [["t5"]]}
    p = P.exact_probability(P.project(r, ["a"], P.WHY), "_k", {"t10": 0.5, "t20": 0.5, "t5": 0.2})
    assert {x["a"]: round(x["p"], 9) for x in p.collect()} == {1: 0.75, 2: 0.2}


def test_sequences(spark):
    steps = [sequences.Step("a", 2, 10_000_000), sequences.Step("b", 1, 10_000_000)]
    rows = [("u", T(0), "a"), ("u", T(1), "x"), ("u", T(5), "a"), ("u", T(9), "b"), ("u", T(50), "a"), ("u", T(55), "a"), ("u", T(120), "b"), ("v", T(0), "a"), (None, T(0), "a"), ("u", None, "b")]
    df = spark.createDataFrame([(*r, 1.0, i) for i, r in enumerate(rows)], "u string, ts timestamp_ntz, kind string, v double, i int")
    got = [tuple(r) for r in sequences.matches(df, "u", "ts", "kind", "v", "i", steps, 60).collect()]
    us = lambda s: int((T(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == [("u", us(0), us(9))]


def test_ledger_rejects_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 0.6), ("a", 2, 0.6), ("a", 3, 0.4), ("b", 1, 2.0)], "acc string, i int, e double")
    got = sorted((r["acc"], r["i"], r["accepted"], r["spent"]) for r in sketches.budget_ledger(df, "acc", ["i"], "e", 1.0).collect())
    assert got == [("a", 1, True, 0.6), ("a", 2, False, 0.6), ("a", 3, True, 1.0), ("b", 1, False, 0.0)]


def test_hilbert_is_a_walk(spark):
    df = spark.range(16).crossJoin(spark.range(16).withColumnRenamed("id", "y"))
    pts = [(r["id"], r["y"]) for r in layout.hilbert_ordered(df, F.col("id"), F.col("y"), 4).orderBy("curve").collect()]
    assert len(set(pts)) == 256 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(pts, pts[1:]))


def test_ring_moves_few_keys(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    own = lambda n: {r["k"]: r["owner"] for r in layout.ring_owner(df, "k", n).collect()}
    a, b = own(["x", "y", "z"]), own(["x", "y", "z", "w"])
    assert set(a.values()) == {"x", "y", "z"} and all(b[k] in (a[k], "w") for k in a)


def test_cascade_has_no_last_wave(spark):
    ex = spark.createDataFrame([(i, i + 1, 2.0) for i in range(4)], "src bigint, dst bigint, amount double")
    buf = spark.createDataFrame([(i, 1.0) for i in range(6)], "v bigint, buffer double")
    seed = spark.createDataFrame([(0,)], "v bigint")
    assert graph.cascade(ex, buf, seed).count() == 5
    with pytest.raises(RuntimeError):
        graph.cascade(ex, buf, seed, 2)
