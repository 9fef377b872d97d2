"""Graph and iterative operators over edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import discard, materialize

#: Sum of changes of all ranks between two looks below which page ranks have settled.
RANK_TOLERANCE = 1e-8


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once as (a, b) with a < b; loops go."""
    e = edges.where("src <> dst and src is not null and dst is not null")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges pointed from the end of lower degree to that of higher, ties by id.

    Every vertex then has at most sqrt(2 * edges) successors, which bounds what the joins for
    triangles and cliques produce, as a worst-case optimal join does.
    """
    e = undirected(edges)
    d = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    j = e.join(d.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(d.withColumnsRenamed({"v": "b", "d": "db"}), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return j.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, its corners in order."""
    o = materialize(oriented(edges), "oriented")
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    closing = o.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    t = wedge.join(closing, ["x", "y"])
    s = F.array_sort(F.array("u", "x", "y"))
    return t.select(F.get(s, F.lit(0)).alias("a"), F.get(s, F.lit(1)).alias("b"), F.get(s, F.lit(2)).alias("c"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """The number of cycles of four, each counted at its corner of highest rank (degree, then id).

    Paths of two steps are formed only towards corners of lower rank than their start, which bounds them as for triangles.
    """
    e = undirected(edges)
    d = materialize(e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d")), "degrees")
    f = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(d.withColumnsRenamed({"v": "b", "d": "db"}), "b").join(d.withColumnsRenamed({"v": "a", "d": "da"}), "a")
    f = materialize(f.select("a", "b", F.struct("da", "a").alias("ra"), F.struct("db", "b").alias("rb")), "ranked")
    rank = [F.struct(F.col(f"{x}.{y}").alias("d"), F.col(f"{x}.{z}").alias("v")) for x, y, z in (("ra", "da", "a"), ("rb", "db", "b"))]
    f = f.select("a", "b", rank[0].alias("ra"), rank[1].alias("rb"))
    top = f.where(F.col("ra") < F.col("rb")).select(F.col("a").alias("m"), F.col("b").alias("v"), F.col("rb").alias("rv"))
    low = f.select(F.col("a").alias("m"), F.col("b").alias("w"), F.col("rb").alias("rw"))
    n = top.join(low, "m").where(F.col("rw") < F.col("rv")).groupBy("v", "w").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.expr("cast(sum(n * (n - 1) div 2) as bigint)"), F.lit(0).cast("bigint")).alias("n_cycles"))


def is_cyclic(relations: list[set[str]]) -> bool:
    """Whether a join of relations over these attributes is cyclic (ear removal leaves something)."""
    rels = [set(r) for r in relations]
    moved = True
    while moved and len(rels) > 1:
        moved = False
        for i, r in enumerate(rels):
            others = rels[:i] + rels[i + 1 :]
            shared = {a for a in r if any(a in o for o in others)}
            if not shared or any(shared <= o for o in others):
                rels.pop(i)
                moved = True
                break
    return len(rels) > 1


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], most: int) -> DataFrame:
    """Apply ``step`` until ``changed`` is empty, and raise after ``most`` rounds; lineage is cut each round."""
    for _ in range(most):
        nxt = materialize(step(state), "iterate")
        if changed(state, nxt).isEmpty():
            return nxt
        discard(state)
        state = nxt
    raise RuntimeError(f"iterate: still changing after {most} rounds")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, component): the smallest id reachable, by alternating large-star and small-star.

    Each round is two aggregates over the edges; rounds grow with the logarithm of the
    diameter, and no vertex's neighbours are ever gathered.
    """
    e = undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    vertices = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()

    def star(d: DataFrame, large: bool) -> DataFrame:
        both = d.unionByName(d.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else d.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        m = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        j = both.join(m, "src")
        moved = j.where("dst > src" if large else "true").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        if not large:
            moved = moved.unionByName(m.select("src", F.col("m").alias("dst")))
        return moved.where("src <> dst").distinct()

    state = materialize(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    for _ in range(most):
        nxt = materialize(star(star(state, True), False), "edges")
        discard(state)
        state = nxt
        # settled where all edges make stars: one edge for each src, and no dst is a src
        if state.groupBy("src").count().where("count > 1").isEmpty() and state.join(state.select(F.col("src").alias("dst")), "dst", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components: still changing after {most} rounds")
    root = state.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "v")
    return vertices.join(root, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def pagerank(edges: DataFrame, rounds: int | None = None, d: float = 0.85, look_every: int = 10) -> DataFrame:
    """(v, rank): (1 - d) / n + d * (incoming + dangling / n); parallel edges count once, weights are not used.

    Without ``rounds`` it iterates until the ranks settle, looked at each ``look_every`` rounds; each round shrinks
    their change by ``d`` at least, so it ends.
    """
    e = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    v = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().join(e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("out")), "v", "left")
    v = materialize(v, "vertices")
    n = v.count()
    r = materialize(v.withColumn("rank", F.lit(1.0 / max(n, 1))), "ranks")
    i, seen = 0, None
    stored = r
    # the rank that dangling vertices give to all is one number a round, which needs the round's table; without any, rounds are chained
    some = not v.where("out is null").isEmpty()
    while n and (rounds is None or i < rounds):
        dangling = (r.where("out is null").agg(F.sum("rank")).first()[0] or 0.0) if some else 0.0
        sent = e.join(r.where("out is not null").select(F.col("v").alias("src"), (F.col("rank") / F.col("out")).alias("s")), "src").select(F.col("dst").alias("v"), F.lit(None).cast("bigint").alias("out"), "s")
        total = sent.unionByName(v.select("v", "out", F.lit(0.0).alias("s"))).groupBy("v").agg(F.max("out").alias("out"), F.sum("s").alias("s"))
        r = total.select("v", "out", ((1 - d) / n + d * (F.col("s") + dangling / n)).alias("rank"))
        i += 1
        if some or i % look_every == 0:
            r = materialize(r, "ranks")
            if seen is None:  # the ranks of the look before are needed once more
                discard(stored)
            stored = r
        if rounds is None and i % look_every == 0:
            if seen is not None:
                moved = r.join(seen, "v").agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0]
                if moved <= RANK_TOLERANCE:
                    break
            seen = r.select("v", F.col("rank").alias("_before"))
    return r.select("v", "rank")


def simple_cycles(edges: DataFrame, most: int) -> DataFrame:
    """Directed cycles of at most ``most`` different vertices, each once as its path from its smallest vertex.

    A path only goes on to vertices above its start, so a cycle is found from one of its corners alone.
    """
    e = materialize(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges")
    walk, found = e.where("dst > src").select(F.array("src", "dst").alias("path")), None
    for k in range(2, most + 1):
        end, start = F.element_at("path", -1), F.element_at("path", 1)
        closed = walk.withColumn("_e", end).withColumn("_s", start).join(e, (F.col("_e") == F.col("src")) & (F.col("_s") == F.col("dst")), "left_semi").select("path")
        found = closed if found is None else found.unionByName(closed)
        if k < most:
            on = walk.withColumn("_e", end).join(e, F.col("_e") == F.col("src")).where((F.col("dst") > start) & ~F.array_contains("path", F.col("dst")))
            walk = materialize(on.select(F.concat("path", F.array("dst")).alias("path")), "paths")
    return found


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(v, hops): vertices within so many steps of any seed, with the fewest steps."""
    e = edges.select("src", "dst").distinct()
    seen = materialize(seeds.select("v").distinct().withColumn("hops", F.lit(0)), "seen")
    for k in range(1, hops + 1):
        front = seen.where(F.col("hops") == k - 1)
        new = e.join(front, F.col("src") == F.col("v")).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti").withColumn("hops", F.lit(k))
        seen = materialize(seen.unionByName(new), "seen")
    return seen


def cascade(exposures: DataFrame, buffers: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(v, wave): vertices whose losses from failed debtors exceed their buffer, wave by wave.

    ``exposures`` has src (debtor), dst (creditor), amount; ``buffers`` v, buffer. It goes on until a wave is empty, and
    raises if there are more than ``most``.
    """
    failed = materialize(seeds.select("v").distinct().withColumn("wave", F.lit(0)), "failed")
    k, size = 0, failed.count()
    while True:
        k += 1
        loss = exposures.join(failed, F.col("src") == F.col("v"), "left_semi").groupBy(F.col("dst").alias("v")).agg(F.sum("amount").alias("loss"))
        new = loss.join(buffers, "v").where("loss > buffer").join(failed, "v", "left_anti").select("v", F.lit(k).alias("wave"))
        nxt = materialize(failed.unionByName(new), "failed")
        grown = nxt.count()
        if grown == size:
            return nxt
        if most is not None and k > most:
            raise RuntimeError(f"cascade: still spreading after {most} waves")
        discard(failed)
        failed, size = nxt, grown


def timed_cycles(edges: DataFrame, length: int, span_seconds: int, closed: bool = True) -> DataFrame:
    """Closed walks of ``length`` different vertices with rising times within a span: path and times of its ends; or open walks of so many steps.

    ``edges`` has src, dst, ts. A step joins on the vertex and on a bucket of time, so walks meet only edges in reach.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = span_seconds * 1_000_000
    e = edges.where("src <> dst").select("src", "dst", us.alias("t"), F.floor(us / w).alias("_b"))
    walk = e.select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"), F.col("t").alias("t0"), F.col("t").alias("t1"))
    for k in range(length - 1):
        nxt = walk.withColumn("_b", F.explode(F.array(F.floor(F.col("t1") / w), F.floor(F.col("t1") / w) + 1)))
        j = nxt.join(e, (nxt["end"] == e["src"]) & (nxt["_b"] == e["_b"]) & (e["t"] > nxt["t1"]) & (e["t"] - nxt["t0"] <= w))
        closes = F.col("dst") == F.get("path", F.lit(0))
        j = j.where(~F.array_contains(F.slice("path", F.lit(2), F.size("path")), F.col("dst")))
        walk = j.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"), "t0", F.col("t").alias("t1")).where(closes if closed and k == length - 2 else ~closes)
    return walk.select("path", "t0", "t1")
