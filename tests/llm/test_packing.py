import random

from quern.llm import packing as P

SCHEMA = "doc_id bigint, n_tokens bigint, container string, size bigint"


def best_fit(sizes, cap):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(cap - s)
    return sorted(gaps)


def test_matching_is_the_successor_of_each_item(spark):
    """Against a stack over all slots and items, in one range and in many."""
    rnd = random.Random(5)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    for n_slots, n_items in ((40, 60), (60, 40), (0, 5), (7, 0)):
        slots = [("p", k, rnd.randint(1, 30), rnd.randint(30, 40)) for k in range(n_slots)] + [("q", 500 + k, 9, 9) for k in range(3)]
        items = [("p", k, k, rnd.randint(1, 30)) for k in range(n_items)] + [("q", 900 + k, k, 9) for k in range(5)]
        got = P.matched(spark.createDataFrame(items, "pack_name string, item bigint, doc_id bigint, size bigint"), spark.createDataFrame(slots, "pack_name string, cont bigint, size bigint, gap bigint")).collect()
        stack, want = [], {}
        rows = sorted([(p, -s, 0, -g, c, 0, 0) for p, c, s, g in slots] + [(p, -s, 1, 1, -1, d, i) for p, i, d, s in items])
        for k, (p, s, kind, _, c, _, i) in enumerate(rows):
            if k and p != rows[k - 1][0]:
                stack = []
            if kind == 0:
                stack.append(c)
            else:
                want[i] = stack.pop() if stack else None
        assert {r["item"]: r["cont"] for r in got} == want
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_fill_is_close_to_best_fit_item_by_item(spark):
    rnd = random.Random(6)
    for cap, high in ((64, 64), (300, 90), (20, 20)):
        data = [(i, min(high, 1 + int(rnd.expovariate(4 / high)))) for i in range(600)]
        d = run(spark, data, [("s", cap, "x")])
        assert d.container.nunique() <= 1.02 * len(best_fit([n for _, n in data], cap)) + 1


def run(spark, data, packs):
    df = spark.createDataFrame([(*d, "clash", 1) for d in data], SCHEMA)
    return P.pack(df, spark.createDataFrame(packs, "pack_name string, capacity_tokens int, extra string")).toPandas()


def test_every_token_is_packed_once_and_nothing_overflows(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice([0, None, 3, 7, 50, 99, 100, 101, 250, 1000])) for i in range(120)] + [(None, 5), (7, 30)]
    packs = [("s", 100, "x"), ("l", 333, "x"), ("bad", None, "x"), (None, 5, "x")]
    d = run(spark, data, packs)
    want = sum(n or 0 for i, n in data if i is not None)
    for name, cap in (("s", 100), ("l", 333)):
        x = d[d.pack_name == name]
        assert x.tokens.sum() == want and set(x.doc_id) == set(range(120))
        t = x.groupby("container").agg(t=("tokens", "sum"), f=("fill_tokens", "max"), g=("fill_tokens", "min"))
        assert (t.t <= cap).all() and (t.t == t.f).all() and (t.f == t.g).all()
        per = x[x.doc_id == 3].tokens.sum()
        assert per == (data[3][1] or 0)
        small = {i for i, n in data if i is not None and 0 < (n or 0) <= cap and i != 7}
        assert (x[x.doc_id.isin(small)].groupby("doc_id").size() == 1).all()  # never split without need
    assert set(d.pack_name) == {"s", "l"}


def test_empty(spark):
    assert len(run(spark, [], [("s", 10, "x")])) == 0 and len(run(spark, [(1, 5)], [])) == 0
    z = run(spark, [(1, 0), (2, None)], [("s", 10, "x")])
    assert set(z.container) == {"0"} and z.tokens.sum() == 0
