"""Messages delivered more than once: exactly one copy of each identifier.

Identifiers are split by frequency. One map-side combined aggregate counts each
identifier and finds its first row; identifiers that occur once pass directly, and only
the rows of repeated ones are ranked. Identifiers that hold a large part of those rows are
at most ``HOT_SHARES`` in number, whatever the data, so those (and only those) are
broadcast: their rows are never gathered in one task.

Defined cases: a row with a null in any identifier column equals nothing and is kept;
rows that tie in the order column are told apart by all their other columns, and full
repeats keep one copy; an empty table gives an empty result; other columns pass
untouched, own columns begin with ``_dd_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialize

#: An identifier is hot if it has at least 1/HOT_SHARES of the rows of repeated ones; so there are at most so many.
HOT_SHARES = 200
#: Below this many rows no identifier counts as hot.
HOT_LEAST = 50_000


def uuid_key(c: Column) -> Column:
    """One spelling for a UUID however written; any other text stays as it is, after a mark."""
    hexed = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*urn:uuid:", ""), r"[{}()\-\s]", "")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), hexed).when(c.isNotNull(), F.concat(F.lit("="), c))


def frequencies(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per identifier: ``_dd_n`` rows and ``_dd_first``, the smallest ``order``."""
    whole = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_dd_n"), F.min(order).alias("_dd_first"))


def repeated_keys(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Identifiers that occur more than once, stored: they are needed for more than one join."""
    return materialize(frequencies(df, keys, order).where("_dd_n > 1"), "repeated")


def repeated_rows(df: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """The rows of ``repeated`` identifiers, with ``_dd_first``; hot ones by broadcast, so none is gathered."""
    total = repeated.agg(F.sum("_dd_n")).first()[0] or 0
    hot_from = max(HOT_LEAST, total // HOT_SHARES)
    cool = df.join(repeated.where(F.col("_dd_n") < hot_from).drop("_dd_n"), keys)
    if total < hot_from:
        return cool
    hot = repeated.where(F.col("_dd_n") >= hot_from).drop("_dd_n")
    return cool.unionByName(df.join(F.broadcast(hot), keys))


def duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows but the first of each identifier. ``order`` must be unique within it; a null in it comes last."""
    r = repeated_rows(df, keys, repeated_keys(df, keys, order))
    return r.where(F.coalesce(F.col(order) > F.col("_dd_first"), F.col("_dd_first").isNotNull())).select(*df.columns)


def deduplicate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exactly one row per identifier, the first by ``order``; rows without one are all kept."""
    repeated = repeated_keys(df, keys, order)
    passed = df.join(repeated.select(*keys), keys, "left_anti")  # singletons, and rows with a null in the identifier
    first = repeated_rows(df, keys, repeated).where((F.col(order) == F.col("_dd_first")) | (F.col(order).isNull() & F.col("_dd_first").isNull()))
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.hash(*rest), *rest) if rest else Window.partitionBy(*keys).orderBy(*keys)
    winners = first.withColumn("_dd_r", F.row_number().over(w)).where("_dd_r = 1")
    return passed.select(*df.columns).unionByName(winners.select(*df.columns))
