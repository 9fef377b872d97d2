"""Applying a feed of inserts, updates and deletes, in log order.

An operation is a patch. The patch of a key is: the last position that left it alive,
the last position that deleted it, the last position that replaced the whole row
(create, read or delete), and for each column the last value set with its position. Two
patches compose by taking the greater of each part. That is associative, commutative and
idempotent, so repeated and out-of-order deliveries do no harm and the composition may be
reduced as a tree: within a task, then by (key, chunk of the log), then by key. The chunks are ranges of
positions that hold about as many operations each, so a key
that holds a third of the feed is spread over a third of all chunks at least, and the last step sees one row per chunk.

Defined cases: rows without key or position are not applied; operation letters count in
either case, other or null operations are taken as updates; if a delete and another
operation share a position, the delete wins; an update of a row that doesn't exist creates it;
a null column of an update means "not set", a create or read sets its whole row;
an empty feed leaves the base as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import materialize

#: Ranges of the log that are composed by themselves before keys are brought together.
CHUNKS = 64


def chunk_bounds(feed: DataFrame, pos: str, chunks: int = CHUNKS) -> list[int]:
    """Positions that part the log into ranges of about as many operations each. Where they lie can't change a result."""
    if chunks < 2:
        return []
    q = feed.agg(F.percentile_approx(F.col(pos).cast("bigint"), F.array(*[F.lit(k / chunks) for k in range(1, chunks)]), 1000)).first()[0]
    return sorted(set(q or []))


def chunk_of(p: Column, bounds: list[int], first: int = 0) -> Column:
    """Number of the range a position lies in, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(p < bounds[m], chunk_of(p, bounds[:m], first)).otherwise(chunk_of(p, bounds[m + 1 :], first + m + 1))


def _op(op: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(op), F.lit("u"))))


def composed(feed: DataFrame, key: list[str], op: str, pos: str, columns: list[str], bounds: list[int]) -> DataFrame:
    """One patch per key: ``_live``, ``_dead``, ``_reset`` and a ``_v_`` struct (position, value) per column."""
    f = feed.where(" and ".join(f"`{c}` is not null" for c in [*key, pos]))
    o, p = _op(op), F.col(pos).cast("bigint")
    dead, whole = o == "d", o.isin("c", "r", "d")

    def part(c: str) -> Column:
        # on equal positions the greater value counts, so repeated rows can't change the outcome
        return F.max(F.when(~dead & F.col(c).isNotNull(), F.struct(p.alias("p"), F.col(c).alias("v")))).alias(f"_v_{c}")

    own = [F.max(F.when(~dead, p)).alias("_live"), F.max(F.when(dead, p)).alias("_dead"), F.max(F.when(whole, p)).alias("_reset"), *[part(c) for c in columns]]
    by_chunk = f.groupBy(*key, chunk_of(p, bounds).alias("_chunk")).agg(*own)
    return by_chunk.groupBy(*key).agg(*[F.max(c).alias(c) for c in ["_live", "_dead", "_reset", *[f"_v_{c}" for c in columns]]])


def apply_changes(base: DataFrame | None, feed: DataFrame, key: list[str], op: str, pos: str, columns: list[str], chunks: int = CHUNKS, bounds: list[int] | None = None) -> DataFrame:
    """The present state: key, ``columns`` and ``last_pos``; ``base`` is the state before the feed.

    Rows that the feed doesn't touch keep the ``last_pos`` of the base, if it has one.
    """
    patch = composed(feed, key, op, pos, columns, chunk_bounds(feed, pos, chunks) if bounds is None else bounds)
    typed = {x.name: x.dataType for x in feed.schema}

    def fresh(c: str) -> Column:
        return F.when(F.col("_reset").isNull() | (F.col(f"_v_{c}.p") >= F.col("_reset")), F.col(f"_v_{c}.v"))

    lives = F.col("_live").isNotNull() & (F.col("_dead").isNull() | (F.col("_live") > F.col("_dead")))
    if base is None:
        return patch.where(lives).select(*key, *[fresh(c).cast(typed[c]).alias(c) for c in columns], F.col("_live").alias("last_pos"))
    last = F.col("last_pos") if "last_pos" in base.columns else F.lit(None)
    b = base.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], last.cast("bigint").alias("_b_last"), F.lit(True).alias("_had"))
    j = b.join(patch, key, "full_outer")
    stays = lives | (F.col("_live").isNull() & F.col("_dead").isNull() & F.col("_had"))

    def value(c: str) -> Column:
        return F.when(F.col("_reset").isNull(), F.coalesce(fresh(c), F.col(f"_b_{c}"))).otherwise(fresh(c)).cast(typed[c]).alias(c)

    return j.where(F.coalesce(stays, F.lit(False))).select(*key, *[value(c) for c in columns], F.coalesce("_live", "_b_last").alias("last_pos"))


def rebuilt(feed: DataFrame, key: list[str], op: str, pos: str, columns: list[str], chunks: int = CHUNKS) -> DataFrame:
    """The present state from nothing but the feed: the first half of the log gives the base, to which the second is applied."""
    bounds = chunk_bounds(feed, pos, chunks)
    if not bounds:
        return apply_changes(None, feed, key, op, pos, columns, bounds=[])
    cut = bounds[len(bounds) // 2]
    p = F.col(pos).cast("bigint")
    base = materialize(apply_changes(None, feed.where(p < cut), key, op, pos, columns, bounds=[x for x in bounds if x < cut]), "base")
    return apply_changes(base, feed.where(p >= cut), key, op, pos, columns, bounds=[x for x in bounds if x > cut])
