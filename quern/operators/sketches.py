"""Mergeable summaries and samples, as built-in aggregates or bounded state."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sequences import folded


def distinct_sketch(df: DataFrame, keys: list[str], column: str, lg_k: int = 12) -> DataFrame:
    """HyperLogLog state per group; states merge with ``merge_distinct``."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch"))


def merge_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


#: Modulus of the counters and draws of whole numbers, the eighth Mersenne prime.
PRIME = (1 << 31) - 1


def slots(x: Column, depth: int, width: int) -> Column:
    """Counter numbers of a whole number, an entry for each row: (a * x + b) mod prime mod width, with a fixed a and b."""
    return F.array(*[F.struct(F.lit(i).alias("row"), ((F.pmod(x, F.lit(PRIME)) * (2 * i * 7919 + 104729) + (i * 1299709 + 15485863)) % PRIME % width).alias("slot")) for i in range(depth)])


def whole_draw(x: Column, seed: int) -> Column:
    """A number in (0, 1) drawn from a whole number by arithmetic that any engine can repeat."""
    a = (F.pmod(x, F.lit(PRIME)) * 48271 + seed) % PRIME
    return ((((a * a + 12345) % PRIME) * 69621) % PRIME + 0.5) / float(PRIME)


def _drawn(seed: int, row_id: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _counters(column: str, depth: int, width: int, whole: bool) -> Column:
    if whole:
        return slots(F.col(column).cast("bigint"), depth, width)
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(i, F.col(column)), F.lit(width)).alias("slot")))


def count_min(df: DataFrame, column: str, depth: int = 5, width: int = 2048, whole: bool = False) -> DataFrame:
    """Counter table (row, slot, n) with at most depth * width rows: counts merge by addition. ``whole`` numbers are placed by arithmetic, else values by hash."""
    rows = _counters(column, depth, width, whole)
    return df.where(F.col(column).isNotNull()).select(F.explode(rows).alias("_c")).groupBy("_c.row", "_c.slot").agg(F.count(F.lit(1)).alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, column: str, depth: int = 5, width: int = 2048, whole: bool = False) -> DataFrame:
    """Estimated count per value: the least of its counters, never below the true count."""
    e = values.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_c", F.explode(_counters(column, depth, width, whole))).select(column, "_c.row", "_c.slot")
    return e.join(F.broadcast(sketch), ["row", "slot"]).groupBy(column).agg(F.min("n").alias("estimate"))  # depth * width rows


def heavy_hitters(df: DataFrame, column: str, share: float) -> DataFrame:
    """Values with at least a share of all rows, exactly; partial counts combine before the shuffle."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_t"))), F.lit(True)).where(F.col("n") >= share * F.col("_t")).drop("_t")


def quantile_sketch(df: DataFrame, keys: list[str], column: str, probes: list[float]) -> DataFrame:
    """KLL quantiles per group."""
    s = df.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double({column})").alias("_s"))
    return s.select(*keys, *[F.expr(f"kll_sketch_get_quantile_double(_s, {p}d)").alias(f"q{round(p * 100)}") for p in probes])


def centroid_digest(df: DataFrame, column: str, delta: int = 100) -> DataFrame:
    """t-digest style centroids (mean, weight): fine at both ends, at most about ``delta`` in number.

    Ranks come from a global range sort; a row's cluster is the arcsine scale of its rank.
    """
    from ..plans.ordering import range_sorted, with_running

    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = with_running(range_sorted(v, [F.col("v")]), {"upto": "c"})
    t = v.agg(F.sum("c").alias("t"))
    q = (F.col("upto") - F.col("c") / 2) / F.col("t")
    k = F.floor(F.lit(delta / 2) * (F.asin(2 * q - 1) / F.lit(3.141592653589793) + 0.5))
    return r.join(F.broadcast(t), F.lit(True)).groupBy(k.alias("k")).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("weight")).drop("k")


def bloom_bits(df: DataFrame, column: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Set bits of a Bloom filter as 64-bit words (word, mask): at most bits / 64 rows, merged by OR."""
    at = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.col(column)), F.lit(bits)))
    b = df.where(F.col(column).isNotNull()).select(F.explode(at).alias("_b"))
    return b.groupBy(F.floor(F.col("_b") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b % 64 as int))")).alias("mask"))


def bloom_maybe(df: DataFrame, column: str, bloom: DataFrame, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Adds ``maybe``: false means surely not in the filter."""
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.col(column)), F.lit(bits))))
    e = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn("_b", F.explode(at)).withColumn("word", F.floor(F.col("_b") / 64))
    hit = e.join(F.broadcast(bloom), "word", "left").withColumn("_h", F.coalesce(F.expr("(mask & shiftleft(1L, cast(_b % 64 as int))) <> 0"), F.lit(False)))  # bits / 64 rows
    return hit.groupBy(column).agg(F.bool_and("_h").alias("maybe"))


def reservoir(df: DataFrame, k: int, seed: int, row_id: str, weight: Column | None = None, draw: Column | None = None) -> DataFrame:
    """A sample of k rows without replacement, uniform or weighted, that is the same for the same seed.

    Each row draws its own number from its id, so samples of parts merge by taking the k best again.
    """
    u = _drawn(seed, row_id) if draw is None else draw
    key = F.log(u) / weight if weight is not None else u
    return df.withColumn("_u", key).orderBy(F.desc("_u"), row_id).limit(k).drop("_u")


def sampled_total(df: DataFrame, value: str, fraction: float, row_id: str, seed: int, z: float = 1.96, draw: Column | None = None) -> DataFrame:
    """Estimated count and sum from a hash sample, with the sum's interval (estimate, lo, hi)."""
    u = _drawn(seed, row_id) if draw is None else draw
    s = df.where(u < fraction).select((F.col(value) / fraction).alias("wx"))
    a = s.agg((F.count(F.lit(1)) / fraction).alias("n_estimate"), F.sum("wx").alias("estimate"), F.sqrt(F.sum(F.col("wx") * F.col("wx") * (1 - fraction))).alias("se"))
    return a.select("n_estimate", "estimate", (F.col("estimate") - z * F.col("se")).alias("lo"), (F.col("estimate") + z * F.col("se")).alias("hi"))


def sensitivity_coreset(df: DataFrame, value: str, m: int, seed: int, row_id: str, draw: Column | None = None) -> DataFrame:
    """About m rows drawn with probability in proportion to the value, with weight 1 / p: sum(w * x) estimates the sum."""
    t = df.agg(F.sum(F.abs(F.col(value))).alias("_t"))
    p = F.least(F.lit(1.0), m * F.abs(F.col(value)) / F.col("_t"))
    u = _drawn(seed, row_id) if draw is None else draw
    j = df.join(F.broadcast(t), F.lit(True)).withColumn("_p", p)
    return j.where((F.col("_p") > 0) & (u < F.col("_p"))).withColumn("w", 1 / F.col("_p")).drop("_t", "_p")


def noisy_counts(df: DataFrame, keys: list[str], epsilon: float, seed: int, domain: DataFrame | None = None, draw: Column | None = None) -> DataFrame:
    """Counts with Laplace noise of scale 1 / epsilon; noise is drawn from the key, so a run can be repeated."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        n = domain.join(n, keys, "left").na.fill(0, ["n"])
    u = ((F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52) if draw is None else draw) - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    return n.withColumn("noisy", F.col("n") + noise)


def randomised_response(df: DataFrame, truth: Column, epsilon: float, draw: Column) -> DataFrame:
    """(n, estimate): how many hold, from answers of which each is true with probability e^epsilon / (e^epsilon + 1) only."""
    e = math.exp(epsilon)
    t = truth.cast("int")
    a = df.select(F.when(draw < e / (e + 1), t).otherwise(1 - t).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"))
    return a.select("n", ((F.col("s") - F.col("n") / (e + 1)) / ((e - 1) / (e + 1))).alias("estimate"))


def budget_ledger(spends: DataFrame, account: str, order: list[str], epsilon: str, budget: float) -> DataFrame:
    """Running spend per account and whether each request still fits; a rejected request spends nothing.

    Requests of an account are taken in order, because a rejection changes what follows.
    """

    def start() -> Callable[[float], tuple]:
        spent = 0.0

        def step(e: float) -> tuple:
            nonlocal spent
            ok = spent + e <= budget + 1e-12
            spent += e if ok else 0.0
            return e, ok, round(spent, 9)

        return step

    return folded(spends.withColumn("_e", F.col(epsilon).cast("double")).where("_e is not null"), [account], order, ["_e"], start, "epsilon double, accepted boolean, spent double")


def gaussian_loss(sensitivity: float, sigma: float, orders: list[float]) -> list[float]:
    """Renyi loss of the Gaussian mechanism at each order: order * sensitivity^2 / (2 sigma^2)."""
    return [a * sensitivity**2 / (2 * sigma**2) for a in orders]


def renyi_epsilon(losses: DataFrame, account: str, delta: float) -> DataFrame:
    """(account, epsilon): the least epsilon over orders, of losses (account, alpha, loss) that add up per order."""
    total = losses.groupBy(account, "alpha").agg(F.sum("loss").alias("l"))
    return total.groupBy(account).agg(F.min(F.col("l") + F.log(F.lit(1 / delta)) / (F.col("alpha") - 1)).alias("epsilon"))


def merge_digests(digests: DataFrame, delta: int = 100) -> DataFrame:
    """Centroids (mean, weight) of several digests as one: they are ranked by mean and clustered again.

    Digests are bounded by their delta, so all centroids are a few thousand rows at most.
    """
    w = Window.orderBy("mean", "weight")
    c = digests.withColumn("_u", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("weight").over(Window.partitionBy()))
    q = (F.col("_u") - F.col("weight") / 2) / F.col("_t")
    k = F.floor(F.lit(delta / 2) * (F.asin(2 * q - 1) / F.lit(math.pi) + 0.5))
    return c.groupBy(k.alias("_k")).agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight")).drop("_k")


def digest_cdf(digest: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """Adds ``cdf`` to each probe: the part of the weight below it, a centroid's weight lying half on either side of its mean.

    A digest has at most a few hundred rows.
    """
    d = digest.agg(F.sum("weight").alias("_t"), F.array_sort(F.collect_list(F.struct("mean", "weight"))).alias("_c"))
    below = F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + F.when(c["mean"] < F.col(value), c["weight"]).when(c["mean"] == F.col(value), c["weight"] / 2).otherwise(0.0))
    return probes.join(F.broadcast(d), F.lit(True)).withColumn("cdf", below / F.col("_t")).drop("_t", "_c")


def counting_bloom(df: DataFrame, column: str, width: int = 1 << 14, hashes: int = 4) -> DataFrame:
    """(slot, n): counters of distinct whole numbers, at most ``width`` rows; filters add and subtract by counters."""
    at = df.where(F.col(column).isNotNull()).select(column).distinct().select(F.explode(F.array_distinct(F.transform(slots(F.col(column).cast("bigint"), hashes, width), lambda s: s["slot"]))).alias("slot"))
    return at.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def counting_bloom_maybe(values: DataFrame, column: str, bloom: DataFrame, width: int = 1 << 14, hashes: int = 4) -> DataFrame:
    """(column, maybe): whether all counters of a value are above zero. The filter has at most ``width`` rows."""
    at = F.explode(F.array_distinct(F.transform(slots(F.col(column).cast("bigint"), hashes, width), lambda s: s["slot"])))
    e = values.where(F.col(column).isNotNull()).select(column).distinct().withColumn("slot", at)
    return e.join(F.broadcast(bloom), "slot", "left").groupBy(column).agg(F.bool_and(F.coalesce("n", F.lit(0)) > 0).alias("maybe"))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; Spark limits each group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
