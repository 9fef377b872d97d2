"""Joins and windows over time: as-of, attribution, sessions, islands, bars and indicators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sequences import folded


def carried_forward(df: DataFrame, key: list[str], time: str, tie: list[str], values: dict[str, Column], bucket_seconds: int) -> DataFrame:
    """Adds for each name the last non-null value of its expression at or before the row, per key in order of time.

    A key is cut into buckets of time: a window carries values within a bucket, and the last values of a bucket
    (one row per key and bucket, combined before the shuffle) are carried to the later ones. So the largest window is a
    key's rows of one bucket plus its number of buckets, and a key with a third of all rows is spread over time.
    """
    b = df.withColumn("_bucket", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (bucket_seconds * 1_000_000)))
    for n, v in values.items():
        b = b.withColumn(f"_v_{n}", v)
    at = F.struct(time, *tie)
    ends = b.groupBy(*key, "_bucket").agg(*[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values])
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    into = ends.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_bucket").alias("_kb"), *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    within = Window.partitionBy(*key, "_bucket").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, 0)
    own = b.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(within).alias(f"_o_{n}") for n in values])
    on = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = own.join(into, on, "left")
    return j.select(*df.columns, *[F.coalesce(f"_o_{n}", f"_c_{n}").alias(n) for n in values])


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], lookback: Column | None = None, arrival: str | None = None, prefix: str = "r_", bucket_seconds: int = 86_400) -> DataFrame:
    """Each left row with the latest right row at or before its time, within ``lookback``.

    Both sides are united and sorted per key and bucket of time; the last right row is carried forward.
    No range join. On equal right times the one that arrived last counts
    (``arrival``), and right rows come before left rows of the same time. If the latest is older than
    ``lookback`` (an interval), the left row stays without a match. Null keys or times match nothing.
    """
    pay = F.struct(F.col(right_time).alias("_t"), *[F.col(v).alias(v) for v in values])
    r = right.where(" and ".join(f"`{c}` is not null" for c in [*on, right_time])).select(*on, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), (F.col(arrival) if arrival else F.lit(0)).cast("bigint").alias("_arr"), pay.alias("_r"))
    lt = left.select(*on, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_arr"), F.struct(*left.columns).alias("_l"))
    both = lt.unionByName(r, allowMissingColumns=True)
    m = carried_forward(both, on, "_at", ["_side", "_arr"], {"_m": F.col("_r")}, bucket_seconds).where("_side = 1")
    ok = F.col("_m").isNotNull() & F.col("_at").isNotNull()
    for c in on:
        ok = ok & F.col(c).isNotNull()
    if lookback is not None:
        ok = ok & (F.col("_m._t") >= F.col("_at") - lookback)
    return m.select("_l.*", F.when(ok, F.col("_m._t")).alias(prefix + right_time), *[F.when(ok, F.col(f"_m.{v}")).alias(prefix + v) for v in values])


def asof_corrections(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, arrived: str, seen_until: Column) -> DataFrame:
    """Rows to retract and to emit when right rows that arrive after ``seen_until`` are taken in.

    Two as-of joins over one window each; only left rows whose match changes give a pair of rows with
    ``_diff`` -1 and +1.
    """
    early = right.where(F.col(arrived) <= seen_until)
    a = asof_join(left, early, on, left_time, right_time, [value], arrival=arrived, prefix="old_")
    both = asof_join(a, right, on, left_time, right_time, [value], arrival=arrived, prefix="new_")
    moved = both.where(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")) | ~F.col(f"old_{right_time}").eqNullSafe(F.col(f"new_{right_time}")))
    rows = F.array(F.struct(F.lit(-1).alias("_diff"), F.col(f"old_{value}").alias("match")), F.struct(F.lit(1).alias("_diff"), F.col(f"new_{value}").alias("match")))
    return moved.withColumn("_p", F.explode(rows)).select(*left.columns, "_p._diff", "_p.match")


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, tie: str, closes: Column | None = None) -> DataFrame:
    """Adds ``session_no``: a new one after an idle time above the gap, and after a closing event.

    An idle time equal to the gap stays. Rows without time keep a null session. A key is cut into days: starts are
    marked against the last row before, which is looked up over days where it isn't of the same one, and numbered by
    a running sum within the day on top of the sum of the days before. So a window holds a key's rows of a day at most.
    """
    own = df.withColumn("_day", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 86_400_000_000)).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    own = own.withColumn("_shut", F.coalesce(closes, F.lit(False)) if closes is not None else F.lit(False))
    within = Window.partitionBy(key, "_day").orderBy(time, tie)
    past = Window.partitionBy(key).orderBy("_day")
    ends = own.where("_day is not null").groupBy(key, "_day").agg(F.max(F.struct("_us", tie, "_shut")).alias("_e"))
    ends = ends.select(F.col(key).alias("_k"), F.col("_day").alias("_d"), F.lag("_e._us").over(past).alias("_in_us"), F.lag("_e._shut").over(past).alias("_in_shut"))
    j = own.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_day") == F.col("_d")), "left")
    before, shut = F.coalesce(F.lag("_us").over(within), F.col("_in_us")), F.coalesce(F.lag("_shut").over(within), F.col("_in_shut"))
    start = before.isNull() | (F.col("_us") - before > gap_seconds * 1_000_000) | F.coalesce(shut, F.lit(False))
    marked = j.withColumn("_s", F.when(F.col("_us").isNull(), 0).otherwise(start.cast("int")))
    sums = marked.where("_day is not null").groupBy(key, "_day").agg(F.sum("_s").alias("_n"))
    base = sums.select(F.col(key).alias("_k2"), F.col("_day").alias("_d2"), F.coalesce(F.sum("_n").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = marked.join(base, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("_day") == F.col("_d2")), "left")
    number = F.when(F.col("_us").isNotNull(), F.col("_base") + F.sum("_s").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*df.columns, number.alias("session_no"))


def islands(df: DataFrame, key: list[str], order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """Runs of at least ``least`` rows with ``flag``: key, first and last order value, length."""
    w = Window.partitionBy(*key).orderBy(*order)
    on = F.coalesce(flag, F.lit(False))
    d = df.withColumn("_on", on).withColumn("_i", F.row_number().over(w) - F.sum(on.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.where("_on").groupBy(*key, "_i").agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("n_rows") >= least).drop("_i")


def attribution(conversions: DataFrame, touches: DataFrame, key: str, at: str, touch_at: str, kind: str, touch_id: str, windows: dict[str, int]) -> DataFrame:
    """Last touch per conversion: kinds in order of rank, each within its window in seconds (inclusive).

    The united rows carry the last touch of each kind forward per key and bucket of time; the
    greatest id wins ties. No pair of conversion and touch is ever formed.
    """
    c = conversions.select("*", F.lit(1).alias("_side"))
    t = touches.select(F.col(key), F.col(touch_at).alias(at), F.lit(0).alias("_side"), F.col(kind).alias("_kind"), F.col(touch_id).alias("_tid"))
    both = c.unionByName(t, allowMissingColumns=True)
    last = {f"_last_{k}": F.when((F.col("_side") == 0) & (F.col("_kind") == k), F.struct(F.col(at).alias("t"), F.col("_tid").alias("id"))) for k in windows}
    both = carried_forward(both, [key], at, ["_side", "_tid"], last, 86_400)
    out = both.where("_side = 1")
    sec = F.unix_micros(F.col(at).cast("timestamp"))
    name, ref = None, None
    for k, s in windows.items():
        near = F.col(f"_last_{k}").isNotNull() & (sec - F.unix_micros(F.col(f"_last_{k}.t").cast("timestamp")) <= s * 1_000_000)
        name = F.when(near, k) if name is None else name.when(near, k)
        ref = F.when(near, F.col(f"_last_{k}.id")) if ref is None else ref.when(near, F.col(f"_last_{k}.id"))
    return out.select(*conversions.columns, name.otherwise("organic").alias("channel"), ref.alias("touch_id"))


def period_start(time: str, seconds: int) -> Column:
    """floor(time / width) * width, counted from 1970."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def bars(ticks: DataFrame, key: list[str], time: str, price: str, volume: Column, seconds: int, tie: str) -> DataFrame:
    """Open, high, low, close and volume per key and period; open and close in time order, ties by ``tie``."""
    k = F.struct(time, tie)
    return ticks.where(F.col(time).isNotNull() & F.col(price).isNotNull()).groupBy(*key, period_start(time, seconds).alias("bar_start")).agg(
        F.min_by(price, k).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, k).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n_trades")
    )


def sliding_counts(df: DataFrame, time: str, width: int, stride: int) -> DataFrame:
    """Rows per window [k * stride, k * stride + width); none begins before 1970."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w, s = width * 1_000_000, stride * 1_000_000
    last = F.floor(us / s)
    first = F.greatest(F.lit(0), F.floor((us - w) / s) + 1)
    k = F.explode(F.when(us.isNotNull() & (first <= last), F.sequence(first, last)))
    return df.withColumn("_k", k).groupBy(F.timestamp_micros(F.col("_k") * s).cast("timestamp_ntz").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def exponential_mean(df: DataFrame, key: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """Exponential mean seeded with the simple mean of the first ``period`` values; earlier rows have none. Null values are skipped."""

    def start() -> Callable[[float], tuple | None]:
        m = _Mean(period, 2.0 / (period + 1))
        return lambda v: None if (e := m.add(v)) is None else (e,)

    return folded(df.withColumn("_v", F.col(value).cast("double")).where("_v is not null"), key, order, ["_v"], start, "ema double")


class _Mean:
    """Mean of the first values, then smoothed by a factor."""

    def __init__(self, period: int, factor: float):
        self.period, self.factor, self.n, self.value = period, factor, 0, 0.0

    def add(self, v: float) -> float | None:
        self.n += 1
        if self.n <= self.period:
            self.value += (v - self.value) / self.n
            return self.value if self.n == self.period else None
        self.value += self.factor * (v - self.value)
        return self.value


def macd(df: DataFrame, key: list[str], order: list[str], value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``macd`` (fast less slow exponential mean), its own exponential mean ``signal``, and ``histogram``; from the row on that has all three."""

    def start() -> Callable[[float], tuple | None]:
        f, s, g = (_Mean(p, 2.0 / (p + 1)) for p in (fast, slow, signal))

        def step(v: float) -> tuple | None:
            a, b = f.add(v), s.add(v)
            if a is None or b is None:
                return None
            e = g.add(a - b)
            return None if e is None else (a - b, e, a - b - e)

        return step

    return folded(df.withColumn("_v", F.col(value).cast("double")).where("_v is not null"), key, order, ["_v"], start, "macd double, signal double, histogram double")


def relative_strength(df: DataFrame, key: list[str], order: list[str], value: str, period: int = 14) -> DataFrame:
    """Wilder's ``rsi``: 100 - 100 / (1 + mean gain / mean loss), both smoothed by 1 / period; 100 without losses."""

    def start() -> Callable[[float], tuple | None]:
        gain, loss, last = _Mean(period, 1.0 / period), _Mean(period, 1.0 / period), None

        def step(v: float) -> tuple | None:
            nonlocal last
            last, d = v, 0.0 if last is None else v - last
            if gain.n == 0 and loss.n == 0 and step.first:
                step.first = False
                return None
            g, x = gain.add(max(d, 0.0)), loss.add(max(-d, 0.0))
            return None if g is None else (100.0 if x == 0 else 100 - 100 / (1 + g / x),)

        step.first = True
        return step

    return folded(df.withColumn("_v", F.col(value).cast("double")).where("_v is not null"), key, order, ["_v"], start, "rsi double")


def dynamic_watermarks(df: DataFrame, source: list[str], batch: str, time: str, arrival: str, percentile: float, least_seconds: int) -> DataFrame:
    """Adds ``allowed_seconds``, the lag within which a percentile of the source's rows of earlier batches arrived, and ``late``.

    Percentiles are exact over whole seconds of lag (the first of at least that part of the rows). A source's state is a
    histogram of its lags, fed by counts per batch and lag, so no row passes through Python; the first batch has the least lag.
    Rows without batch or times are left out.
    """
    sec = F.greatest(F.lit(0), F.floor((F.unix_micros(F.col(arrival).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1_000_000))
    rows = df.where(F.col(time).isNotNull() & F.col(arrival).isNotNull() & F.col(batch).isNotNull()).withColumn("_lag", sec)
    seen = rows.groupBy(*source, batch, "_lag").agg(F.count(F.lit(1)).alias("_n"))

    def start() -> Callable[[int, int, int], tuple | None]:
        past: dict[int, int] = {}
        now: list = [None]
        waiting: list[tuple[int, int]] = []

        def step(b: int, lag: int, n: int) -> tuple | None:
            out = None
            if b != now[0]:
                for k, c in waiting:
                    past[k] = past.get(k, 0) + c
                waiting.clear()
                now[0], need, upto, at = b, math.ceil(percentile * sum(past.values())), 0, 0
                for k in sorted(past):
                    upto += past[k]
                    if upto >= need:
                        at = k
                        break
                out = (max(at, least_seconds),)
            waiting.append((lag, n))
            return out

        return step

    allowed = folded(seen.withColumn("_b", F.col(batch)), source, [batch, "_lag"], ["_b", "_lag", "_n"], start, "allowed_seconds bigint").drop("_lag")
    return rows.join(allowed, [*source, batch]).withColumn("late", F.col("_lag") > F.col("allowed_seconds")).select(*df.columns, "allowed_seconds", "late")


def reordered(df: DataFrame, source: list[str], arrival: list[str], time: str, hold_seconds: int, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """A reorder buffer's output: rows in event order with ``position`` per source, and the dead letters with a ``reason``.

    A row is held until the latest event time seen is ``hold_seconds`` past its own; one that comes after that is dead
    (too_late), as is a repeat of ``identity`` (repeated) and one without event time (no_time).
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    seen = Window.partitionBy(*source).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*source, *identity).orderBy(*arrival)
    r = df.withColumn("_high", F.max(us).over(seen)).withColumn("_again", F.row_number().over(same) > 1)
    reason = F.when(us.isNull(), "no_time").when(F.col("_again"), "repeated").when(us < F.col("_high") - hold_seconds * 1_000_000, "too_late")
    r = r.withColumn("reason", reason).drop("_high", "_again")
    out = Window.partitionBy(*source).orderBy(time, *arrival)
    return r.where("reason is null").drop("reason").withColumn("position", F.row_number().over(out)), r.where("reason is not null")
