"""Processing only new or changed records.

A source is cut into partitions (for a table of changes, the day of the change). Each
partition has a fingerprint: its row count and the sum of its row hashes. Both are
additive, so they are computed by one map-side combined aggregate, don't depend on row
order, and their shuffle has a row per partition and task. Only partitions whose
fingerprint differs from the stored one are read again, recomputed, and replaced
by dynamic partition overwrite. A touched partition always gets a row of nulls beside its own, so one that
is gone, or for which nothing is left, is emptied by the same overwrite; readers don't see that row. Fingerprints are published after the data: a
run that dies in between leaves the old fingerprints, so the next run does the same
partitions again, with the same result.

Defined cases: null key or hash columns are hashed as nulls and count; a null partition
value is a partition of its own (an empty text counts as null there, as in any folder of partitions); repeated rows count as often as they occur; an empty
source has no partitions, so every stored one is emptied; clashing column names are
impossible because all own columns begin with ``_fp_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.runtime import broadcast_if_small, materialize, scratch


def _sums(columns: list[str], where: Column | None, prefix: str) -> list[Column]:
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(20,0)")
    on = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return [F.count_if(on).alias(f"{prefix}n"), F.coalesce(F.sum(F.when(on, h)), F.lit(0)).cast("decimal(38,0)").alias(f"{prefix}h")]


def fingerprints(df: DataFrame, parts: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per partition: ``_fp_n`` rows and ``_fp_h``, the sum of their 64-bit hashes.

    The sum is a decimal of 38 digits: exact up to 10**19 rows, so the order of addition can't change it.
    """
    return df.groupBy(*parts).agg(*_sums(columns or [c for c in df.columns if c not in parts], None, "_fp_"))


def changed_partitions(current: DataFrame, stored: DataFrame, parts: list[str]) -> DataFrame:
    """Partitions that are new, changed or gone: columns ``parts`` and ``_fp_state``."""
    a, b = current.alias("a"), stored.alias("b")
    on = [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in parts]
    j = a.join(b, on, "full_outer")
    state = F.when(F.col("b._fp_n").isNull(), "new").when(F.col("a._fp_n").isNull(), "gone").when((F.col("a._fp_n") != F.col("b._fp_n")) | (F.col("a._fp_h") != F.col("b._fp_h")), "changed")
    return j.select(*[F.coalesce(f"a.{p}", f"b.{p}").alias(p) for p in parts], state.alias("_fp_state")).where("_fp_state is not null")


class IncrementalTable:
    """A table derived from a source by partition, refreshed where the source changed.

    ``root/data`` holds the derived rows, partitioned by ``parts``; ``root/state/v=N`` the
    fingerprints as of refresh N. A state counts once its ``_SUCCESS`` file is there, so
    the highest such N is what the last finished run saw.
    """

    def __init__(self, spark: SparkSession, root: str, parts: list[str]):
        self.spark, self.root, self.parts, self.schema = spark, root.rstrip("/"), parts, None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the last finished refresh, 0 before the first."""
        fs, path = self._fs()
        base = path(f"{self.root}/state")
        if not fs.exists(base):
            return 0
        return max([0, *(int(s.getPath().getName()[2:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v=") and fs.exists(path(s.getPath(), "_SUCCESS")))])

    def stored(self, like: DataFrame) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/state/v={v}") if v else like.limit(0)

    def publish(self, state: DataFrame) -> None:
        """Store fingerprints as what has been processed."""
        state.write.mode("overwrite").parquet(f"{self.root}/state/v={self.version() + 1}")

    def read(self) -> DataFrame:
        r = self.spark.read
        return (r.schema(self.schema) if self.schema else r).parquet(f"{self.root}/data").where("_fp_live").drop("_fp_live")

    def refresh(self, source: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str] | None = None, fail_before_commit: bool = False, now: DataFrame | None = None) -> DataFrame:
        """Recompute what changed; returns the partitions touched with their state.

        ``compute`` gets all source rows of the touched partitions and must give rows that
        have the partition columns. ``now`` has the fingerprints of the source if they are known already. ``fail_before_commit`` stops between data and state, as
        a crash there would (for tests).
        """
        now = materialize(fingerprints(source, self.parts, columns), "fingerprints") if now is None else now
        touched = materialize(changed_partitions(now, self.stored(now), self.parts), "touched")
        live = touched.where("_fp_state <> 'gone'").select(*[F.col(p).alias(f"_fp_{p}") for p in self.parts])
        on = [source[p].eqNullSafe(live[f"_fp_{p}"]) for p in self.parts]
        out = compute(source.join(broadcast_if_small(live, base=touched), on, "left_semi")).withColumn("_fp_live", F.lit(True))
        out = out.unionByName(touched.select(*self.parts, F.lit(False).alias("_fp_live")), allowMissingColumns=True)
        out = out.select(*[c for c in out.columns if c not in self.parts], *self.parts)
        self.schema = out.schema
        out.hint("rebalance", *self.parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(f"{self.root}/data")
        if fail_before_commit:
            raise RuntimeError("stopped before the state was published")
        self.publish(now)
        return touched


def run_windows(runs: DataFrame) -> DataFrame:
    """What each successful run took: (source, _lo, _hi, _by); ``_lo`` is null for a source's first.

    Rows with updated_at in (_lo, _hi] and _ingested_at at most _by. Runs that fell back
    take nothing themselves but lower the bound of the next. A success without
    last_updated takes nothing and leaves the bound as it was.
    """
    ok = runs.where("run_status = 'success' and started_at is not null and source is not null")
    before = Window.partitionBy("source").orderBy("started_at", "run_id", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    w = ok.select("source", F.last("last_updated", ignorenulls=True).over(before).alias("_lo"), F.col("last_updated").alias("_hi"), F.col("started_at").alias("_by"))
    return w.where("_hi is not null and (_lo is null or _lo < _hi)")


def mark_taken(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (source, record_id, updated_at, ingested_at) with their day ``_fp_day`` and ``_fp_taken``.

    The windows are spread over the days they touch, so a row meets only the windows of
    its own day by an equality join; no row is multiplied.
    """
    w = run_windows(runs)
    first = w.where("_lo is null").groupBy("source").agg(F.collect_list(F.struct("_hi", "_by")).alias("_first"))
    later = (
        w.where("_lo is not null")
        .withColumn("_fp_day", F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"))))
        .groupBy("source", "_fp_day")
        .agg(F.collect_list(F.struct("_lo", "_hi", "_by")).alias("_later"))
    )
    r = rows.withColumn("_fp_day", F.to_date("updated_at"))
    r = r.join(first, "source", "left").join(later, ["source", "_fp_day"], "left")
    t, i = F.col("updated_at"), F.col("ingested_at")
    by_first = F.exists("_first", lambda x: (t <= x["_hi"]) & (i <= x["_by"]))
    by_later = F.exists("_later", lambda x: (t > x["_lo"]) & (t <= x["_hi"]) & (i <= x["_by"]))
    return r.withColumn("_fp_taken", F.coalesce(by_first, F.lit(False)) | F.coalesce(by_later, F.lit(False))).drop("_first", "_later")


def pending_changes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes (source, record_id, updated_at) that no successful run has taken.

    What the runs left behind is a table of open changes by source and day, with the fingerprints of the rows they
    took. It is refreshed with all rows: days whose fingerprint is still the stored one have nothing open; the other
    days are read again, compared change by change, and replaced. A change is taken if any of its rows was. Rows
    without updated_at are no changes; a row without ingested_at can't have been taken.
    """
    marked = mark_taken(rows.where("updated_at is not null"), runs)
    parts, cols = ["source", "_fp_day"], ["record_id", "updated_at", "ingested_at"]
    both = materialize(marked.groupBy(*parts).agg(*_sums(cols, None, "_fp_"), *_sums(cols, F.col("_fp_taken"), "_tk_")), "fingerprints")
    t = IncrementalTable(rows.sparkSession, scratch(rows.sparkSession, "open-changes"), parts)
    t.publish(both.where("_tk_n > 0").select(*parts, F.col("_tk_n").alias("_fp_n"), F.col("_tk_h").alias("_fp_h")))

    def still_open(r: DataFrame) -> DataFrame:
        return r.groupBy(*parts, "record_id", "updated_at").agg(F.max("_fp_taken").alias("_t")).where("not _t").drop("_t")

    t.refresh(marked, still_open, cols, now=both.select(*parts, "_fp_n", "_fp_h"))
    return t.read().select("source", "record_id", "updated_at")


def next_watermarks(runs: DataFrame, pending: DataFrame, sources: list[str]) -> DataFrame:
    """Per source: last_updated of the last success, open changes, and the new last_updated.

    The new one is the latest change known, so it never falls; without open changes it
    stays as it was.
    """
    ok = runs.where("run_status = 'success' and last_updated is not null")
    last = ok.groupBy("source").agg(F.max_by("last_updated", F.struct("started_at", "run_id", "attempt")).alias("old"), F.max("last_updated").alias("top"))
    todo = pending.groupBy("source").agg(F.count(F.lit(1)).alias("open_changes"), F.max("updated_at").alias("newest"))
    names = runs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    j = names.join(last, "source", "left").join(todo, "source", "left")
    return j.select("source", F.col("old").alias("last_updated"), F.coalesce("open_changes", F.lit(0)).cast("bigint").alias("open_changes"), F.greatest("top", "newest").alias("new_last_updated"))
