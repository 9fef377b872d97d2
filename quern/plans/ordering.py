"""Positions and running sums over a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .runtime import materialize


def range_sorted(df: DataFrame, by: list[Column], partitions: int | None = None) -> DataFrame:
    """Range-partition and sort ``df``, written out so that the order of its parts is final.

    Adds ``_pid`` (range number) and ``_seq`` (place within the range).
    """
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    m = F.monotonically_increasing_id()
    out = s.withColumn("_pid", F.shiftright(m, 33).cast("int")).withColumn("_seq", m.bitwiseAND((1 << 33) - 1))
    return materialize(out, "sorted")


def with_running(sorted_df: DataFrame, amounts: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """Running totals over the global order of a ``range_sorted`` table.

    ``amounts`` maps a new column to the column that is summed, up to and with the row.
    With ``within`` the totals restart for each value of those columns, which must be
    the first sort columns. Totals of the ranges (one row per range and group, so their
    number is bounded by ranges plus groups) give each range its start; within a range
    rows are summed by a window over that range alone. No task ever holds more than a range.
    """
    keys = within or []
    sums = sorted_df.groupBy(*keys, "_pid").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in amounts.items()])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_pid", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in amounts])
    own = Window.partitionBy("_pid", *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = sorted_df.select("*", *[F.sum(c).over(own).alias(f"_o_{n}") for n, c in amounts.items()])
    joined = rows.join(starts, [*keys, "_pid"])
    return joined.select(*sorted_df.columns, *[(F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(n) for n in amounts])
