"""History of changing attributes: validity periods from snapshots, by gaps and islands.

All observations of an entity are put in date order. A lag comparison of the attribute
hash marks the changes, the running sum of marks numbers the islands, the minimum date of
an island is its start and the start of the next one bounds it. Observations of the same
entity and date are first reduced to one by a map-side combined aggregate, so an
entity's window holds at most a row per calendar date of the sources, however many rows
it has.

Defined cases: rows without entity or date are no observations; of several rows of a
date the one with the latest load time counts (a null load time is the earliest; the
rest of a tie is decided by the greatest attributes, so the result doesn't depend on
order); a null attribute means unchanged; a null before the first known value is a value of
its own; absence from a snapshot means nothing; empty input gives no versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def versions(observations: DataFrame, entity: str, on: str, attributes: dict[str, Column], loaded: str | None = None) -> DataFrame:
    """One row per version: entity, attributes, effective_date, end_date, is_current.

    ``attributes`` maps each tracked column to the expression by which its values are
    compared (for instance without accents). ``end_date`` is the day before the next start,
    null for the last version.
    """
    names = list(attributes)
    rows = observations.where(F.col(entity).isNotNull() & F.col(on).isNotNull())
    rank = F.struct(F.col(loaded) if loaded else F.lit(0), *names)
    daily = rows.groupBy(entity, on).agg(F.max(F.struct(rank.alias("_k"), *names)).alias("_o")).select(entity, F.col(on).alias("_on"), *[F.col(f"_o.{n}").alias(n) for n in names])
    past = Window.partitionBy(entity).orderBy("_on").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(entity).orderBy("_on")
    filled = daily.select(entity, "_on", *[F.last(n, ignorenulls=True).over(past).alias(n) for n in names])
    hashed = filled.withColumn("_h", F.xxhash64(*[attributes[n] for n in names]))
    prev = F.lag("_h").over(order)
    marked = hashed.withColumn("_mark", F.when(prev.isNull() | (prev != F.col("_h")), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_mark").over(past))
    v = islands.groupBy(entity, "_island").agg(F.min("_on").alias("effective_date"), F.min_by(F.struct(*names), "_on").alias("_a"))
    nxt = F.lead("effective_date").over(Window.partitionBy(entity).orderBy("effective_date"))
    return v.select(entity, *[F.col(f"_a.{n}").alias(n) for n in names], "effective_date", F.date_sub(nxt, 1).alias("end_date"), nxt.isNull().alias("is_current"))
