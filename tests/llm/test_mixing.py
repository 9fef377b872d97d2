import random

from pyspark.sql import functions as F

from quern.llm import mixing as M

SIZES = "doc_id bigint, source string, n_tokens bigint, weight string"
TARGETS = "source string, target_weight double, max_repeats int"


def sizes(spark, data):
    return spark.createDataFrame([(*d, "clash") for d in data], SIZES)


def test_shares_repeats_and_budget(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["big", "Big ", "BIG"]), rnd.randint(1, 20)) for i in range(2000)] + [(5000 + i, "small-one", rnd.randint(1, 20)) for i in range(100)] + [(9000 + i, "other", 50) for i in range(50)]
    t = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.5, 3), ("none", 0.0, 1), ("absent", 0.2, 2)], TARGETS)
    d = M.mix(sizes(spark, data), t, 5000).toPandas()
    assert 4900 <= d.n_tokens.sum() <= 5000 and set(d.source) == {"big", "small_one"}
    share = d.groupby("source").n_tokens.sum() / d.n_tokens.sum()
    assert abs(share["big"] - 0.5) < 0.02
    assert d.groupby(["source", "doc_id"]).size().max() <= 3 and d[d.source == "big"].groupby("doc_id").size().max() == 1
    # a second time only after all others came once
    s = d[d.source == "small_one"]
    assert s[s.repeat_no == 2].empty or (s.repeat_no == 1).sum() == 100
    # exhausted: the rest goes on
    d = M.mix(sizes(spark, data), t, 15000).toPandas()
    assert d[d.source == "small_one"].groupby("doc_id").size().eq(3).all() and d.n_tokens.sum() > 14900


def test_order_does_not_matter_and_ties(spark):
    data = [(i, "a", 10) for i in range(50)]
    t = spark.createDataFrame([("a", 1.0, None)], TARGETS)
    one = lambda df: sorted(r["doc_id"] for r in M.mix(df, t, 200).collect())
    assert one(sizes(spark, data)) == one(sizes(spark, data[::-1]).repartition(3)) and len(one(sizes(spark, data))) == 20


def test_nulls_empty_and_shares(spark):
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), (None, 0.1, 1), ("c", None, 1)], TARGETS)
    data = [(1, None, 5), (None, "a", 5), (2, "a", None), (3, "a", 0), (4, "b", 8)]
    assert [tuple(r)[:4] for r in M.mix(sizes(spark, data), t).collect()] == [(4, "b", 1, 8)]
    assert M.mix(sizes(spark, []), t).count() == 0
    s = {r["source"]: (r["supply_tokens"], r["chosen_tokens"], r["share"]) for r in M.shares(sizes(spark, data), t).collect()}
    assert s["b"] == (8, 8, 1.0) and s["a"][1:] == (0, 0.0)


def brute(data, targets, budget):
    """One queue per source, served document by document in the order of virtual finish."""
    done = []
    for source, weight, repeats in targets:
        docs, cum = [(d, n) for d, s, n in data if s == source], 0
        for k in range(1, repeats + 1):
            for h, d, n in sorted((F_HASH[k, d], d, n) for d, n in docs):
                cum += n
                done.append((cum / weight, source, k, d, n))
    out, total = [], 0
    for v, source, k, d, n in sorted(done):
        total += n
        if total > budget:
            break
        out.append((d, source, k))
    return sorted(out)


F_HASH = {}


def test_same_documents_as_a_queue_served_one_by_one(spark):
    """At budgets from nothing to more than there is, where the copies that are made differ."""
    rnd = random.Random(8)
    data = [(i, rnd.choice(["a", "a", "a", "b", "c"]), rnd.randint(1, 30)) for i in range(60)]
    targets = [("a", 0.2, 2), ("b", 0.5, 4), ("c", 0.3, 3)]
    h = spark.range(60).select("id", *[F.xxhash64(F.lit(1), F.lit(k), "id").alias(f"h{k}") for k in range(1, 5)]).collect()
    F_HASH.update({(k, r["id"]): r[f"h{k}"] for r in h for k in range(1, 5)})
    t = spark.createDataFrame(targets, TARGETS)
    for budget in (0, 40, 500, 900, 1500, 10_000):
        got = sorted((r["doc_id"], r["source"], r["repeat_no"]) for r in M.mix(sizes(spark, data), t, budget).collect())
        assert got == brute(data, targets, budget)
