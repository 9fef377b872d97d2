"""Incremental view maintenance: relations as rows with a signed multiplicity ``_diff``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def consolidate(d: DataFrame) -> DataFrame:
    """Equal rows to one row with the sum of their signs; rows that cancel go."""
    cols = [c for c in d.columns if c != "_diff"]
    return d.groupBy(*cols).agg(F.sum("_diff").alias("_diff")).where("_diff <> 0")


def joined(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """The change of ``left join right``: dL x R + L x dR + dL x dR, signs multiplied."""

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        j = a.withColumnRenamed("_diff", "_da").join(b.withColumnRenamed("_diff", "_db"), on)
        return j.withColumn("_diff", F.col("_da") * F.col("_db")).drop("_da", "_db")

    return consolidate(product(d_left, right).unionByName(product(left, d_right)).unionByName(product(d_left, d_right)))


def aggregated(base: DataFrame, d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The change of (count, sum) per key: the old group row retracted, the new one added, for touched keys only."""
    touched = d.groupBy(*keys).agg(F.sum("_diff").alias("_dn"), F.sum(F.col("_diff") * F.col(value)).alias("_ds"))
    old = base.join(touched.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("_diff").alias("_n"), F.sum(F.col("_diff") * F.col(value)).alias("_s"))
    j = touched.join(old, keys, "left").na.fill(0, ["_n", "_s"])
    rows = F.array(F.struct(F.lit(-1).alias("_diff"), F.col("_n").alias("n"), F.col("_s").alias("total")), F.struct(F.lit(1).alias("_diff"), (F.col("_n") + F.col("_dn")).alias("n"), (F.col("_s") + F.col("_ds")).alias("total")))
    return j.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.n", "_r.total", "_r._diff").where("n <> 0")


def extremes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum and maximum under retraction: over values whose multiplicities stay positive."""
    net = rows.groupBy(*keys, value).agg(F.sum("_diff").alias("_n")).where("_n > 0")
    return net.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n_distinct"))


def signed(df: DataFrame, sign: int | Column = 1) -> DataFrame:
    return df.withColumn("_diff", F.lit(sign) if isinstance(sign, int) else sign)


def _only(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def _left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left outer join of signed relations, whose rows count by their net multiplicities."""
    a, b = consolidate(left).withColumnRenamed("_diff", "_da"), consolidate(right).withColumnRenamed("_diff", "_db")
    return a.join(b, on, "left").withColumn("_diff", F.col("_da") * F.coalesce("_db", F.lit(1))).drop("_da", "_db")


def left_joined(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """The change of a left outer join, with the transitions of rows between a match and nulls.

    Only keys that either change touches are joined, before and after; what is equal in both cancels.
    """
    keys = d_left.select(*on).unionByName(d_right.select(*on)).distinct()
    a, b = _only(left, keys, on), _only(right, keys, on)
    old = _left(a, b, on)
    new = _left(a.unionByName(d_left), b.unionByName(d_right), on)
    return consolidate(new.unionByName(old.withColumn("_diff", -F.col("_diff"))))


def averaged(base: DataFrame, d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The change of the mean per key: from count and sum, which retract exactly."""
    return aggregated(base, d, keys, value).select(*keys, (F.col("total") / F.col("n")).alias("mean"), "_diff")


def ranked(base: DataFrame, d: DataFrame, keys: list[str], order: list[Column], most: int | None = None) -> DataFrame:
    """The change of row numbers per key (``rank``), for touched keys only; with ``most``, of the first so many."""
    touched = d.select(*keys).distinct()

    def numbered(rows: DataFrame) -> DataFrame:
        n = consolidate(rows).where("_diff > 0")
        n = n.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_diff").cast("int")))).drop("_diff", "_copy")
        r = n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return signed(r if most is None else r.where(F.col("rank") <= most))

    old = _only(base, touched, keys)
    return consolidate(numbered(old.unionByName(d)).unionByName(numbered(old).withColumn("_diff", F.lit(-1))))
