"""Data quality: checks, quarantine, profiles, histograms and drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordering import range_sorted, with_running


@dataclass(frozen=True)
class Check:
    """A named condition that good rows meet. Null values pass all but ``not_null``."""

    name: str
    good: Column
    severity: str = "error"


def not_null(c: str, severity: str = "error") -> Check:
    """Neither null nor, for text, empty."""
    return Check(f"not_null:{c}", F.col(c).isNotNull() & (F.col(c).cast("string") != ""), severity)


def in_set(c: str, values: list, severity: str = "error") -> Check:
    return Check(f"in_set:{c}", F.col(c).isNull() | F.col(c).isin(*values), severity)


def in_range(c: str, lo, hi, severity: str = "error") -> Check:
    return Check(f"range:{c}", F.col(c).isNull() | F.col(c).between(lo, hi), severity)


def matches(c: str, pattern: str, severity: str = "error") -> Check:
    return Check(f"regex:{c}", F.col(c).isNull() | F.col(c).rlike(pattern), severity)


def parses(c: str, kind: str, severity: str = "error") -> Check:
    return Check(f"type:{c}", F.col(c).isNull() | F.col(c).try_cast(kind).isNotNull(), severity)


def summary(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One pass over the table, then a row per check: n_rows, n_bad."""
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(c.good, F.lit(False))).alias(f"_{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.col(f"_{i}").alias("n_bad")) for i, c in enumerate(checks)])
    return a.select("n_rows", F.explode(rows).alias("_r")).select("_r.check_name", "_r.severity", "n_rows", "_r.n_bad")


def failures(df: DataFrame, checks: list[Check], severity: str = "error") -> DataFrame:
    """Adds ``failed``: names of the checks of a severity that a row fails."""
    names = F.array(*[F.when(~F.coalesce(c.good, F.lit(False)), c.name) for c in checks if c.severity == severity])
    return df.withColumn("failed", F.filter(names, lambda x: x.isNotNull()))


def quarantine(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows that fail an error check with the names of what failed."""
    f = failures(df, checks)
    return f.where(F.size("failed") == 0).drop("failed"), f.where(F.size("failed") > 0)


def repeats(df: DataFrame, column: str, order: str) -> DataFrame:
    """Every occurrence of a value after its first; null and empty values are skipped. Hot values are never ranked in one task."""
    from .dedup import duplicates

    return duplicates(df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")), [column], order)


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: per numeric column count, nulls, distinct, mean, deviation, min, max."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"_{c}")]
    return df.agg(*aggs).select(F.explode(F.array(*[f"_{c}" for c in columns])).alias("_p")).select("_p.*")


def equi_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin = min(floor((v - lo) / width), bins - 1); a single value gives one bin. The bounds are one row."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    j = v.join(F.broadcast(b), F.lit(True))
    return j.groupBy(F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def equi_depth(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Bins of max(1, n div bins) rows in value order, the last takes the rest.

    Positions come from counts of distinct values in a global range sort, so equal values are split by
    arithmetic and no row is sorted twice.
    """
    from ..plans.ordering import range_sorted, with_running

    d = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = with_running(range_sorted(d, [F.col("v")]), {"hi_pos": "c"})
    total = d.agg(F.sum("c").alias("total"))
    j = r.join(F.broadcast(total), F.lit(True)).withColumn("size", F.greatest(F.lit(1), F.expr(f"total div {bins}")))
    first, last = F.floor((F.col("hi_pos") - F.col("c")) / F.col("size")), F.floor((F.col("hi_pos") - 1) / F.col("size"))
    top = F.lit(bins - 1)
    e = j.withColumn("bin", F.explode(F.sequence(F.least(first, top), F.least(last, top))))
    lo = F.greatest(F.col("hi_pos") - F.col("c"), F.col("bin") * F.col("size"))
    hi = F.when(F.col("bin") == top, F.col("hi_pos")).otherwise(F.least(F.col("hi_pos"), (F.col("bin") + 1) * F.col("size")))
    return e.withColumn("k", hi - lo).groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def max_diff(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Cuts at the bins - 1 largest gaps between distinct values, ties to the later gap."""
    from ..plans.ordering import range_sorted, with_running

    d = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = with_running(range_sorted(d.withColumn("one", F.lit(1)), [F.col("v")]), {"i": "one"})
    gap = r.select(F.col("v").alias("to_v"), (F.col("i") - 1).alias("i")).join(r.select("v", "i"), "i").select("to_v", (F.col("to_v") - F.col("v")).alias("gap"))
    cuts = gap.orderBy(F.desc("gap"), F.desc("to_v")).limit(bins - 1)
    # at most bins - 1 cuts
    starts = cuts.select(F.col("to_v").alias("v"), F.lit(1).alias("cut"))
    j = r.join(F.broadcast(starts), "v", "left").na.fill(0, ["cut"])
    return with_running(range_sorted(j.drop("i"), [F.col("v")]), {"bin": "cut"}).groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def drift(base: DataFrame, now: DataFrame, bin_col: str) -> DataFrame:
    """Population stability index and Kolmogorov-Smirnov distance of two columns of bins (a bounded domain)."""
    a = base.groupBy(F.col(bin_col).alias("_b")).agg(F.count(F.lit(1)).alias("_na"))
    b = now.groupBy(F.col(bin_col).alias("_b")).agg(F.count(F.lit(1)).alias("_nb"))
    j = a.join(b, "_b", "full_outer").na.fill(0, ["_na", "_nb"])
    t = j.agg(F.sum("_na").alias("_ta"), F.sum("_nb").alias("_tb"))
    s = j.join(F.broadcast(t), F.lit(True)).select("_b", (F.col("_na") / F.col("_ta")).alias("p"), (F.col("_nb") / F.col("_tb")).alias("q"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    fp, fq = F.greatest("p", F.lit(1e-4)), F.greatest("q", F.lit(1e-4))
    return s.withColumn("d", F.abs(F.sum("p").over(w) - F.sum("q").over(w))).agg(F.sum((fq - fp) * F.log(fq / fp)).alias("psi"), F.max("d").alias("ks"))


def illegal_transitions(df: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose state may not follow the one before; a first state is always legal."""
    prev = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed])
    return df.withColumn("previous", prev).where(F.col("previous").isNotNull() & ~F.array_contains(pairs, F.struct(F.col("previous").alias("a"), F.col(state).alias("b"))))


@dataclass(frozen=True)
class Contract:
    """What a table promises: columns with their types, a time column that is at most so many hours old, and checks with the least part of rows that pass."""

    columns: dict[str, str]
    fresh: tuple[str, float] | None = None
    checks: tuple[tuple[Check, float], ...] = ()


def kept_contract(df: DataFrame, contract: Contract, now: Column) -> DataFrame:
    """(rule, kept): a row per promise; one aggregate for all checks. An empty table breaks a promise of freshness only."""
    have = dict(df.dtypes)
    rows = [(f"column:{c}", have.get(c) == t) for c, t in contract.columns.items()]
    known = [(c, least) for c, least in contract.checks if c.name.split(":")[-1] in have]
    rows += [(c.name, False) for c, _ in contract.checks if c.name.split(":")[-1] not in have]
    aggs = [(F.count_if(F.coalesce(c.good, F.lit(False))) >= least * F.count(F.lit(1))).alias(f"_{i}") for i, (c, least) in enumerate(known)]
    names = [c.name for c, _ in known]
    if contract.fresh and contract.fresh[0] in have:
        col, hours = contract.fresh
        aggs.append(F.coalesce(F.max(col).cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600)), F.lit(False)).alias(f"_{len(names)}"))
        names.append(f"fresh:{col}")
    fixed = df.sparkSession.createDataFrame(rows, "rule string, kept boolean")
    if not aggs:
        return fixed
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("kept")) for i, n in enumerate(names)])
    return fixed.unionByName(df.agg(*aggs).select(F.inline(cells)))


def exact_percentiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], discrete: tuple[str, ...] = ()) -> DataFrame:
    """keys and exact percentiles by name: between the two nearest values, or for the ``discrete`` ones the first value of rank p * n.

    Values are counted (combined before the shuffle), range-sorted, and running counts find the ranks, so no
    group is ever in one task or in one hash map, however few groups there are. Null values don't count; a group of nulls has no row.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    lined = with_running(range_sorted(counts, [*[F.col(k) for k in keys], F.col("_v")]), {"_upto": "_c"}, keys)
    n = lined.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    j = lined.join(n, keys) if keys else lined.join(F.broadcast(n), F.lit(True))
    aggs, out = [], []
    for name, p in wanted.items():
        if name in discrete:
            aggs.append(F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(p * F.col("_n"))), F.col("_v"))).alias(name))
            out.append(F.col(name))
            continue
        at = p * (F.col("_n") - 1)
        aggs += [F.min(F.when(F.col("_upto") >= F.floor(at) + 1, F.col("_v"))).alias(f"_l_{name}"), F.min(F.when(F.col("_upto") >= F.ceil(at) + 1, F.col("_v"))).alias(f"_h_{name}"), F.max(at - F.floor(at)).alias(f"_f_{name}")]
        out.append((F.col(f"_l_{name}") + F.col(f"_f_{name}") * (F.col(f"_h_{name}") - F.col(f"_l_{name}"))).alias(name))
    return j.groupBy(*keys).agg(*aggs).select(*keys, *out)
