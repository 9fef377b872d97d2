"""Structured Streaming twins: the same builders as in batch, run to completion over what has landed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.runtime import scratch
from ..sources.tables import load


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files. Event times must be cast to timestamp before a watermark."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    r = spark.readStream.schema(load(spark, sf_dir, name).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(path).isDirectory():
        return r.parquet(f"{sf_dir}/{name}.parquet")
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_in_parts(spark: SparkSession, sf_dir: str, name: str, order: str, parts: int = 3) -> DataFrame:
    """A table as a stream of ``parts`` micro-batches in the order of ``order``, whatever its files.

    Its rows are landed as one file per range first, then read a file a batch, oldest first. A file read as one batch is
    the size of a landing; at scale use ``stream`` on the files as they land.
    """
    df = load(spark, sf_dir, name)
    land = scratch(spark, f"landing-{name}")
    df.repartitionByRange(parts, F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(f"{land}/all")
    landed = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _part int").parquet(f"{land}/all")
    for k in range(parts):  # file times give the order of reading
        landed.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{land}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{land}/in")


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Append everything to a Parquet sink, exactly once by its checkpoint, and read it back."""
    spark = df.sparkSession
    out = scratch(spark, label)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, label: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every micro-batch to ``apply(batch, number)``; a number may come again after a crash."""
    q = df.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", scratch(df.sparkSession, f"{label}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete(df: DataFrame, label: str) -> DataFrame:
    """The final result table of an aggregation, replaced by each batch."""
    spark = df.sparkSession
    out = scratch(spark, label)
    run_batches(df, label, lambda b, _: b.write.mode("overwrite").parquet(out), "complete")
    return spark.read.schema(df.schema).parquet(out)


class OnceSink:
    """A folder that takes each batch once: a batch's folder is replaced, never added to, if it comes again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/batch={number}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.root)


def closed_sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions that the watermark has closed: append mode, rows in the order they close."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    s = e.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    """Stream-stream join: right rows after the left row, within so many seconds. Columns l_id, l_ts and r_id, r_ts."""
    a = left.withWatermark("l_ts", delay).withColumnRenamed(key, "_lk")
    b = right.withWatermark("r_ts", delay)
    cond = (F.col("_lk") == F.col(key)) & (F.col("r_ts") > F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, cond).select("l_id", "r_id")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key and batch: count and sum so far, from state that is kept between batches."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["_v"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.select(key, F.col(value).cast("double").alias("_v")).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def last_rows(events: DataFrame, key: str, time: str, row_id: str, most: int) -> DataFrame:
    """List state: after each batch the ids of a key's last ``most`` rows by time and id, in order."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held += list(zip(f["_us"].tolist(), f["_id"].tolist()))
        held = sorted(held)[-most:]
        state.update(([u for u, _ in held], [i for _, i in held]))
        yield pd.DataFrame({key: [k[0]], "ids": [[i for _, i in held]]})

    kind = dict(events.dtypes)[key]
    src = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.col(row_id).cast("bigint").alias("_id"))
    return src.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ids array<bigint>", "us array<bigint>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


def kind_counts(events: DataFrame, key: str, kind: str) -> DataFrame:
    """Map state: after each batch a key's rows of every kind, as (kind, n) of the kinds the batch has."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts = state.get if state.exists else ([], [])
        held, met = dict(zip(names, counts)), set()
        for f in frames:
            for x, n in f["_kind"].value_counts().items():
                held[x] = held.get(x, 0) + int(n)
                met.add(x)
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({key: [k[0]] * len(met), "kind": sorted(met), "n": [held[x] for x in sorted(met)]})

    t = dict(events.dtypes)[key]
    return events.where(F.col(kind).isNotNull()).select(key, F.col(kind).alias("_kind")).groupBy(key).applyInPandasWithState(update, f"{key} {t}, kind string, n bigint", "kinds array<string>, counts array<bigint>", "update", GroupStateTimeout.NoTimeout)


def counts_since_idle(events: DataFrame, key: str, time: str, ttl_seconds: int) -> DataFrame:
    """Value state with a time to live: rows of a key since it was idle for longer than ``ttl_seconds`` of event time.

    State that is older than that when the next row comes is dropped and begins anew; events must come in order of time.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        for t in sorted(x for f in frames for x in f["_us"].tolist()):
            n = 1 if last is None or t - last > ttl_seconds * 1_000_000 else n + 1
            last = t
        state.update((last, n))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = dict(events.dtypes)[key]
    src = events.where(F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"))
    return src.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint", "last bigint, n bigint", "update", GroupStateTimeout.NoTimeout)


class QualityGate:
    """Takes in the batches whose part of good rows reaches ``least``; others go to quarantine whole. Each batch once."""

    def __init__(self, spark: SparkSession, root: str, good: Column, least: float):
        self.spark, self.root, self.good, self.least = spark, root, good, least

    def __call__(self, batch: DataFrame, number: int) -> None:
        ok = F.coalesce(self.good, F.lit(False))
        held = batch.persist()
        rate = held.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0))).first()[0]
        side = "passed" if rate >= self.least else "quarantine"
        held.withColumn("_ok", ok).write.mode("overwrite").parquet(f"{self.root}/side={side}/batch={number}")
        held.unpersist()

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(f"{self.root}/side=*")


def late_by_running_maximum(events: DataFrame, source: list[str], arrival: list[str], time: str, bound_seconds: int) -> DataFrame:
    """Batch twin of a per-event watermark: ``late`` if the event is older than the latest seen before it less a bound.

    The watermark is kept per source (for instance a log partition), as a source's reader keeps it.
    """
    from pyspark.sql import Window

    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*source).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(us < F.max(us).over(w) - bound_seconds * 1_000_000, F.lit(False)))
