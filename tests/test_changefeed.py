import random

from pyspark.sql import functions as F

from quern.operators import changefeed as C

SCHEMA = "id bigint, op string, pos bigint, a string, b int, last_pos string"


def fold(data, base=None):
    state = dict(base or {})
    for i, op, p, a, b in sorted((r for r in data if r[0] is not None and r[2] is not None), key=lambda r: r[2]):
        o = (op or "u").lower()
        if o == "d":
            state.pop(i, None)
        elif o in "cr":
            state[i] = (a, b, p)
        else:
            old = state.get(i, (None, None, None))
            state[i] = (old[0] if a is None else a, old[1] if b is None else b, p)
    return sorted((k, *v) for k, v in state.items())


def feed(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


def test_random_feeds_with_repeats_and_any_order(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice(["c", "U", "u", "r", "D", None]), p if rnd.random() > 0.1 else None, rnd.choice([None, "x", "y"]), rnd.choice([None, 1, 2])) for p in range(200)]
    data += rnd.sample(data, 60)
    rnd.shuffle(data)
    for chunks in (1, 7, 64):
        got = sorted(map(tuple, C.apply_changes(None, feed(spark, data), ["id"], "op", "pos", ["a", "b"], chunks).collect()))
        assert got == fold(data)
        assert sorted(map(tuple, C.rebuilt(feed(spark, data), ["id"], "op", "pos", ["a", "b"], chunks).collect())) == fold(data)


def test_chunks_part_the_log_evenly(spark):
    f = spark.range(6400).select((F.col("id") * F.col("id")).alias("pos"))
    n = [r["n"] for r in f.groupBy(C.chunk_of(F.col("pos"), C.chunk_bounds(f, "pos")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 64 and max(n) < 150


def test_base_and_empty_feed(spark):
    base = {1: ("x", 1, None), 2: ("y", 2, None), 3: ("z", 3, None)}
    b = spark.createDataFrame([(k, v[0], v[1]) for k, v in base.items()], "id bigint, a string, b int")
    data = [(1, "u", 5, None, 9), (2, "d", 6, None, None), (4, "c", 7, "n", None), (3, "d", 8, None, None), (3, "c", 9, "w", None)]
    got = sorted(map(tuple, C.apply_changes(b, feed(spark, data), ["id"], "op", "pos", ["a", "b"]).collect()))
    assert got == fold(data, base)
    assert C.apply_changes(b, feed(spark, []), ["id"], "op", "pos", ["a", "b"]).count() == 3
    assert C.rebuilt(feed(spark, []), ["id"], "op", "pos", ["a"]).count() == 0
    kept = C.apply_changes(b.withColumn("last_pos", F.lit(3)), feed(spark, data), ["id"], "op", "pos", ["a", "b"]).collect()
    assert {r["id"]: r["last_pos"] for r in kept} == {1: 5, 3: 9, 4: 7}


def test_delete_wins_a_shared_position(spark):
    assert C.rebuilt(feed(spark, [(1, "u", 5, "x", 1), (1, "d", 5, None, None)]), ["id"], "op", "pos", []).count() == 0
