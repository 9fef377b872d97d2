"""Snapshots, dimensions and table versions: diff, merge, slowly changing dimensions, time travel, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FOREVER = "9999-12-31 00:00:00"


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and op (INSERT, UPDATE, DELETE) between two snapshots, null-safe; one full outer join."""
    a, b = old.select(*key, F.struct(*columns).alias("_a")), new.select(*key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer")
    op = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "DELETE").when(~F.col("_a").eqNullSafe(F.col("_b")), "UPDATE")
    return j.select(*key, op.alias("op"), "_a", "_b").where("op is not null")


def merge_upsert(base: DataFrame, changes: DataFrame, key: list[str], deleted: Column | None = None) -> DataFrame:
    """Copy-on-write merge: changed rows replace base rows, deleted ones go, new ones come."""
    alive = changes.where(~deleted) if deleted is not None else changes
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(alive.select(*base.columns))


def merge_on_read(base: DataFrame, log: DataFrame, key: list[str], version: str, deleted: str) -> DataFrame:
    """Base and delta log merged at read: the highest version of a key counts, tombstones drop it.

    max_by per key is partial before the shuffle, so a hot key costs a row per task.
    """
    cols = [c for c in base.columns if c not in key]
    rows = base.select(*key, F.lit(-1).cast("bigint").alias("_v"), F.lit(False).alias("_d"), F.struct(*cols).alias("_r"))
    logs = log.select(*key, F.col(version).cast("bigint").alias("_v"), F.coalesce(F.col(deleted), F.lit(False)).alias("_d"), F.struct(*cols).alias("_r"))
    last = rows.unionByName(logs).groupBy(*key).agg(F.max(F.struct("_v", "_d", "_r")).alias("_x"))
    return last.where("not _x._d").select(*key, *[F.col(f"_x._r.{c}").alias(c) for c in cols])


def scd1(changes: DataFrame, key: list[str], order: list[str], op: str) -> DataFrame:
    """The last row per key, without keys whose last operation is DELETE."""
    cols = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_r"))
    return last.where(F.col(f"_r.{op}") != "DELETE").select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def scd2(changes: DataFrame, key: list[str], at: str, tie: list[str], op: str, columns: list[str]) -> DataFrame:
    """Half-open validity [valid_from, valid_to); a DELETE closes its predecessor and leaves no row of its own."""
    w = Window.partitionBy(*key).orderBy(at, *tie)
    v = changes.withColumn("valid_to", F.coalesce(F.lead(at).over(w), F.lit(FOREVER).cast("timestamp_ntz")))
    v = v.where(F.col(op) != "DELETE").withColumn("is_current", F.col("valid_to") == F.lit(FOREVER).cast("timestamp_ntz"))
    return v.select(*key, *columns, F.col(at).alias("valid_from"), "valid_to", "is_current")


def scd3(changes: DataFrame, key: list[str], order: list[str], column: str) -> DataFrame:
    """Current and previous value of one column."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    v = changes.withColumn("previous", F.lag(column).over(w)).withColumn("_r", F.row_number().over(last))
    return v.where("_r = 1").select(*key, F.col(column).alias("current"), "previous")


def scd6(changes: DataFrame, key: list[str], at: str, tie: list[str], op: str, column: str) -> DataFrame:
    """SCD2 rows that also carry the key's current value."""
    v = scd2(changes, key, at, tie, op, [column])
    w = Window.partitionBy(*key).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return v.withColumn("current_value", F.last(column).over(w))


def compact_log(log: DataFrame, key: list[str], position: list[str], op: str) -> DataFrame:
    """The last change per key by position; a delete of a key that was never seen alive is dropped."""
    cols = [c for c in log.columns if c not in key]
    g = log.groupBy(*key).agg(F.max(F.struct(*position, *[c for c in cols if c not in position])).alias("_r"), F.max(F.col(op) != "d").alias("_seen"))
    return g.where(F.col("_seen") | (F.col(f"_r.{op}") != "d")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def changed_columns(old: str, new: str) -> Column:
    """Sorted names of entries that differ between two string maps; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    z = F.map_zip_with(F.coalesce(F.col(old), empty), F.coalesce(F.col(new), empty), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(z, lambda k, v: v)))


def retained(df: DataFrame, key: list[str], at: str, tie: str, now: Column, ttl_days: int | None = None, most: int | None = None, most_bytes: int | None = None, size: str | None = None, tagged: Column | None = None) -> DataFrame:
    """Rows kept by age, by count per key, or by running size per key; a row goes if any rule drops it, unless it is ``tagged``."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    if tagged is not None:
        rest = retained(df.where(~F.coalesce(tagged, F.lit(False))), key, at, tie, now, ttl_days, most, most_bytes, size)
        return rest.unionByName(df.where(F.coalesce(tagged, F.lit(False))))
    out = df
    if ttl_days is not None:
        out = out.where(F.col(at) >= now - F.expr(f"interval {ttl_days} days"))
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    if most_bytes is not None and size is not None:
        out = out.withColumn("_b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_b") <= most_bytes).drop("_b")
    return out


class VersionedTable:
    """Parquet data files under a log of versions: append, delete, overwrite, time travel, rollback, vacuum.

    Each commit is a JSON file ``_log/N.json`` with the full list of live directories. It is written under another name and
    renamed when it is whole, so a writer that dies leaves no version half made; the second of two writers of a version fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        log = path(f"{self.root}/_log")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(log)) if fs.exists(log) else []

    def _entry(self, version: int) -> dict:
        import json

        return json.loads("".join(self.spark.sparkContext._jvm.scala.io.Source.fromInputStream(self._fs()[0].open(self._fs()[1](f"{self.root}/_log/{version:08d}.json")), "UTF-8").mkString()))

    def _commit(self, entry: dict) -> int:
        import json

        import uuid

        fs, path = self._fs()
        part = path(f"{self.root}/_new-{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(entry), "utf-8"))
        stream.close()
        n = (self.versions() or [0])[-1] + 1
        fs.mkdirs(path(f"{self.root}/_log"))
        target = path(f"{self.root}/_log/{n:08d}.json")
        # the whole entry appears at once; a rename onto an existing name fails, so another writer's version is never lost
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise RuntimeError(f"version {n} was made by another writer; read again and retry")
        return n

    def _write(self, df: DataFrame) -> str:
        import uuid

        d = f"data-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/{d}")
        return d

    def live(self, version: int | None = None) -> list[str]:
        vs = self.versions()
        if not vs:
            return []
        return self._entry(vs[-1] if version is None else version)["dirs"]

    def append(self, df: DataFrame) -> int:
        return self._commit({"op": "append", "dirs": [*self.live(), self._write(df)]})

    def overwrite(self, df: DataFrame) -> int:
        return self._commit({"op": "overwrite", "dirs": [self._write(df)]})

    def delete(self, condition: str) -> int:
        """Rewrites only the directories that hold a row to be deleted; the others stay as they are."""
        schema, dirs = self.read().schema, []
        for d in self.live():
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{d}")
            dirs.append(d if part.where(condition).isEmpty() else self._write(part.where(f"not coalesce({condition}, false)")))
        return self._commit({"op": "delete", "dirs": dirs})

    def rollback(self, version: int) -> int:
        return self._commit({"op": "rollback", "dirs": self._entry(version)["dirs"]})

    def read(self, version: int | None = None) -> DataFrame:
        """All columns any live file has; files without one give null."""
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{d}" for d in self.live(version)])

    def changes(self, old: int, new: int) -> DataFrame:
        """Rows added and removed between two versions, with ``_change``."""
        a, b = self.read(old), self.read(new)
        return b.exceptAll(a).withColumn("_change", F.lit("insert")).unionByName(a.exceptAll(b).withColumn("_change", F.lit("delete")))

    def vacuum(self, keep_versions: int) -> list[str]:
        """Delete directories that none of the last versions names."""
        fs, path = self._fs()
        keep = {d for v in self.versions()[-keep_versions:] for d in self._entry(v)["dirs"]}
        gone = [s.getPath().getName() for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in keep]
        for d in gone:
            fs.delete(path(f"{self.root}/{d}"), True)
        return gone


def scd4(changes: DataFrame, key: list[str], at: str, tie: list[str], op: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The current rows, and a history table of all earlier ones with the time each was replaced."""
    v = scd2(changes, key, at, tie, op, columns)
    return v.where("is_current").select(*key, *columns, "valid_from"), v.where("not is_current").select(*key, *columns, "valid_from", F.col("valid_to").alias("replaced_at"))


def merge_closing(dim: DataFrame, snapshot: DataFrame, key: list[str], columns: list[str], at: Column) -> DataFrame:
    """A merge that keeps history: changed keys have their current row closed at ``at`` and get a new one, new keys get one, the rest stays.

    ``dim`` has key, columns, valid_from, valid_to (null while current); absence from the snapshot means nothing.
    """
    now = snapshot.select(*key, F.struct(*columns).alias("_new"), F.lit(True).alias("_in"))
    j = dim.where("valid_to is null").join(now, key, "full_outer")
    differs = F.coalesce("_in", F.lit(False)) & ~F.coalesce(F.struct(*columns).eqNullSafe(F.col("_new")) & F.col("valid_from").isNotNull(), F.lit(False))
    kept = j.where("valid_from is not null").select(*key, *columns, "valid_from", F.when(differs, at).alias("valid_to"))
    fresh = j.where(differs).select(*key, *[F.col(f"_new.{c}").alias(c) for c in columns], at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    past = dim.where("valid_to is not null").select(*key, *columns, "valid_from", "valid_to")
    return past.unionByName(kept).unionByName(fresh)
