"""Feature transforms, calendars, protected columns, metrics, migrations and merged replicas."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordering import range_sorted, with_running


def fitted(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean, deviation, minimum and maximum per column, to be applied to any table later."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))])


def transformed(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``_z`` (standard score), ``_unit`` (scaled to 0..1) and ``_log`` per column; a constant column scores 0."""
    j = df.join(F.broadcast(stats), F.lit(True))  # one row
    out = {}
    for c in columns:
        v, span = F.col(c), F.col(f"{c}_hi") - F.col(f"{c}_lo")
        out[f"{c}_z"] = F.when(F.col(f"{c}_sd") > 0, (v - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(0.0)
        out[f"{c}_unit"] = F.when(span > 0, (v - F.col(f"{c}_lo")) / span).otherwise(0.0)
        out[f"{c}_log"] = F.log1p(v)
    return j.withColumns(out).drop(*stats.columns)


def business_days_between(start: Column, end: Column, holidays: list[str]) -> Column:
    """Working days in [start, end): no Saturday, Sunday or holiday. Weeks by arithmetic, holidays from a bounded list."""
    days = F.datediff(end, start)
    week = F.floor(days / 7) * 5
    dow = (F.dayofweek(start) + 5) % 7  # Monday 0
    rest = days % 7
    tail = F.greatest(F.lit(0), F.least(dow + rest, F.lit(5)) - F.least(dow, F.lit(5))) + F.greatest(F.lit(0), dow + rest - 7)
    off = F.size(F.filter(F.array(*[F.lit(h).cast("date") for h in holidays]), lambda h: (h >= start) & (h < end) & (F.dayofweek(h).between(2, 6)))) if holidays else F.lit(0)
    return (week + tail - off).cast("bigint")


def pseudonym(c: Column, secret: str) -> Column:
    """The same token for the same value under one secret."""
    return F.when(c.isNotNull(), F.sha2(F.concat(F.lit(secret), F.lit("|"), c.cast("string")), 256))


def sealed(df: DataFrame, column: str, owner: str, keys: DataFrame) -> DataFrame:
    """Encrypts a column under its owner's 16-byte key (owner, key); rows without key get null, so deleting a key shreds them."""
    k = keys.select(F.col("owner").alias(owner), F.col("key").alias("_key"))
    return df.join(k, owner, "left").withColumn(column, F.base64(F.aes_encrypt(F.col(column).cast("string"), F.col("_key")))).drop("_key")


def unsealed(df: DataFrame, column: str, owner: str, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("owner").alias(owner), F.col("key").alias("_key"))
    return df.join(k, owner, "left").withColumn(column, F.try_aes_decrypt(F.unbase64(column), F.col("_key")).cast("string")).drop("_key")


def merkle_root(df: DataFrame, order: list[str], content: str) -> DataFrame:
    """One row: the root over sha256 leaves in order; an odd node is paired with itself. A level halves the rows."""
    from ..plans.ordering import range_sorted, with_running
    from ..plans.runtime import materialize

    level = with_running(range_sorted(df.select(*order, F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256).alias("h"), F.lit(1).alias("one")), [F.col(c) for c in order]), {"i": "one"}).select((F.col("i") - 1).alias("i"), "h")
    n = level.count()
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        level = pair.select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))
        n = (n + 1) // 2
        level = materialize(level, "merkle")
    return level.select(F.col("h").alias("root"))


@dataclass(frozen=True)
class Metric:
    """A named measure: an aggregate, or a ratio of two other metrics."""

    name: str
    aggregate: Column | None = None
    over: tuple[str, str] | None = None


def metrics(df: DataFrame, by: list[str], wanted: list[Metric]) -> DataFrame:
    """Simple metrics in one aggregate, then the ratios of them."""
    out = df.groupBy(*by).agg(*[m.aggregate.alias(m.name) for m in wanted if m.aggregate is not None])
    return out.withColumns({m.name: F.try_divide(F.col(m.over[0]), F.col(m.over[1])) for m in wanted if m.over})


def cumulative(df: DataFrame, by: list[str], time: str, measure: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{measure}_to_date", F.sum(measure).over(w))


def migrated(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Schema steps: ('rename', old, new), ('cast', c, type), ('default', c, value), ('drop', c), ('split', c, sep, [new...]), ('add', c, value)."""
    for op, c, *rest in steps:
        if op == "rename":
            df = df.withColumnRenamed(c, rest[0])
        elif op == "cast":
            df = df.withColumn(c, F.col(c).try_cast(rest[0]))
        elif op == "default":
            df = df.withColumn(c, F.coalesce(c, F.lit(rest[0])))
        elif op == "drop":
            df = df.drop(c)
        elif op == "split":
            parts = F.split(F.col(c), rest[0])
            df = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(rest[1])}).drop(c)
        elif op == "add":
            df = df.withColumn(c, F.lit(rest[0]))
        else:
            raise ValueError(op)
    return df


def merged_counters(replicas: DataFrame, key: str, node: str, value: str) -> DataFrame:
    """Grow-only counters: the greatest count per node, then their sum. Merging is order-free and repeatable."""
    return replicas.groupBy(key, node).agg(F.max(value).alias("_m")).groupBy(key).agg(F.sum("_m").alias("total"))


def merged_registers(replicas: DataFrame, key: str, at: str, node: str, value: str) -> DataFrame:
    """Last writer wins, ties by node."""
    return replicas.groupBy(key).agg(F.max_by(value, F.struct(at, node)).alias("value"))


def beta_below(x: float, a: float, b: float) -> float:
    """Part of a beta distribution at or below x, by its continued fraction, from the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_below(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # convergents p / q of 1 / (1 + d1 / (1 + d2 / ...)), kept near one
    p0, q0, p1, q1, last = 0.0, 1.0, 1.0, 1.0, 0.0
    for n in range(1, 100_000):
        m = n // 2
        d = m * (b - m) * x / ((a + n - 1) * (a + n)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + n - 1) * (a + n))
        p0, q0, p1, q1 = p1, q1, p1 + d * p0, q1 + d * q0
        if q1:
            p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
            if abs(p1 - last) <= 1e-13 * abs(p1):
                break
            last = p1
    return front * p1


def beta_scores(df: DataFrame, key: str, good: Column, alpha: float = 1.0, beta: float = 1.0, healthy: float = 0.9) -> DataFrame:
    """Posterior of a pass rate: mean, and the probability that it is at least ``healthy``.

    Counts come from one aggregate; the incomplete beta function runs on a row per key.
    """
    n = df.groupBy(key).agg(F.count_if(good).alias("ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))

    def tail(a: float, b: float) -> float:
        return 1 - beta_below(healthy, a, b)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_healthy=[tail(alpha + g, beta + x) for g, x in zip(b["ok"], b["bad"])])

    n = n.withColumn("mean", (F.col("ok") + alpha) / (F.col("ok") + F.col("bad") + alpha + beta))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in n.schema)
    return n.mapInPandas(score, f"{names}, p_healthy double")


def closest_word(df: DataFrame, column: str, vocabulary: list[str], most: int = 2) -> DataFrame:
    """Adds ``closest``: the word of a bounded vocabulary within so many edits, the nearest and then first one."""
    c = F.lower(F.trim(column))
    near = F.array_sort(F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.struct(F.levenshtein(c, v).alias("d"), v.alias("v"))))
    best = F.get(near, F.lit(0))
    return df.withColumn("closest", F.when(c.isNotNull() & (best["d"] <= most), best["v"]))


def lexicon_score(df: DataFrame, column: str, polarity: dict[str, float], negators: list[str]) -> DataFrame:
    """Adds ``score``: polarities of the words, turned around after a negator."""
    table = F.create_map(*[F.lit(x) for kv in polarity.items() for x in kv])
    words = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    step = lambda acc, w: F.struct((acc["sum"] + F.coalesce(F.try_element_at(table, w), F.lit(0.0)) * F.when(acc["neg"], -1.0).otherwise(1.0)).alias("sum"), w.isin(*negators).alias("neg"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("neg"))
    return df.withColumn("score", F.when(F.col(column).isNotNull(), F.aggregate(words, start, step, lambda a: a["sum"])))


def run_lengths(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding of a column in order: key, value, first order value, length."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    r = df.withColumn("_r", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*key, "_r").agg(F.first(value).alias(value), F.min(order[0]).alias("first_at"), F.count(F.lit(1)).alias("n")).drop("_r")


def reconciled(sides: dict[str, DataFrame], key: str, amount: str, tolerance: float) -> DataFrame:
    """Keys over several sources with a status: missing (and where), mismatch or matched; one union and one aggregate."""
    all_rows = None
    for name, df in sides.items():
        d = df.select(key, F.lit(name).alias("_s"), F.col(amount).cast("double").alias("_a"))
        all_rows = d if all_rows is None else all_rows.unionByName(d)
    g = all_rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("_s").alias("seen"), F.min("_a").alias("lo"), F.max("_a").alias("hi"))
    absent = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in sides]), F.col("seen")))
    status = F.when(F.size(absent) > 0, "missing").when(F.col("hi") - F.col("lo") > tolerance, "mismatch").otherwise("matched")
    return g.select(key, status.alias("status"), F.array_join(absent, ",").alias("absent"), F.round(F.col("hi") - F.col("lo"), 6).alias("spread"))


def clipped(column: str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi))


def ordinal(column: str, order: list[str]) -> Column:
    """Place of a value in a bounded order, from 0; null for others."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(at > 0, at - 1).cast("bigint")


def lagged(df: DataFrame, key: list[str], order: list[str], column: str, steps: list[int]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in steps})


def merged_signed_counters(replicas: DataFrame, key: str, node: str, ups: str, downs: str) -> DataFrame:
    """Counters that go both ways: per node the greatest number of ups and of downs, then their difference."""
    n = replicas.groupBy(key, node).agg(F.max(ups).alias("_u"), F.max(downs).alias("_d"))
    return n.groupBy(key).agg((F.sum("_u") - F.sum("_d")).alias("total"))


def merged_sets(adds: DataFrame, removals: DataFrame, key: str, element: str, tag: str) -> DataFrame:
    """Observed-remove sets: an element is in the set while one of its add tags isn't removed; an add wins over what the removal didn't see."""
    return adds.select(key, element, tag).distinct().join(removals.select(key, element, tag), [key, element, tag], "left_anti").select(key, element).distinct()


def dictionary_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 by falling frequency, ties by value. The numbers come from a range sort, not from one window."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    return with_running(range_sorted(n, [F.desc("_n"), F.col("value")]), {"_at": "_one"}).select("value", (F.col("_at") - 1).cast("bigint").alias("code"))


def deltas(df: DataFrame, key: list[str], order: list[str], column: str) -> DataFrame:
    """Delta encoding per key in order: the first value, then differences; a running sum decodes it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def undeltas(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("decoded", F.sum("delta").over(w))


def longest_prefix(df: DataFrame, column: str, directory: DataFrame, prefix: str, values: list[str]) -> DataFrame:
    """Adds ``values`` of the longest entry of a directory that a text starts with, nulls where there is none.

    A text meets only its own beginnings of the lengths that the directory has (a few numbers), by an equality join.
    """
    lengths = [r[0] for r in directory.where(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect()]
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    ways = F.filter(F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in sorted(lengths)]), lambda p: p.isNotNull())
    d = directory.groupBy(F.col(prefix).alias("_p")).agg(*[F.first(v).alias(v) for v in values])
    met = keyed.select("_row", F.explode(ways).alias("_p")).join(d, "_p").groupBy("_row").agg(F.max_by(F.struct(*values), F.length("_p")).alias("_v"))
    return keyed.join(met, "_row", "left").select(*df.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
