"""Late and out-of-order events: aggregates by period of event time, restated until a cut-off.

A row belongs to the period its event time falls into. It is on time if it arrives
before the period ends, a correction up to ``cut-off`` after the end, and too late after
that. The first delivery of each event is retained, partitioned by the day of its period. A batch
touches the partitions its rows fall into; those are recomputed entirely from what is retained
there and replaced by dynamic partition overwrite, the retained rows with their verdicts as well as the
aggregates, which too late rows don't touch. A batch is held against the identifiers of the retained rows only, and
reads no other partition in full. One that is applied twice, or again after a crash, gives the same table, and so
do the same rows in other batches.

Defined cases: rows without event time or arrival time have no period and no verdict; a topic without
limits has none either, and of several limits of a topic the longest counts; of several deliveries of a (topic, partition, offset) the one
with the smallest row id counts, also if it comes in a later batch; a null in any of the three makes a row a delivery of its own;
null payload measures are left out of sums; empty input gives empty output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.runtime import broadcast_if_small, materialize

#: Limits are a settings table; beyond this many rows the join isn't broadcast.
LIMITS_BROADCAST = 10_000


def _us(c: str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (the session runs in UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


#: What makes two rows deliveries of one event.
DELIVERY = ["table_name", "topic", "partition_id", "kafka_offset", "_own"]


def first_deliveries(rows: DataFrame, value: str | None = None) -> DataFrame:
    """One row per (table_name, topic, partition_id, kafka_offset), the one with the smallest row_id.

    One aggregate with map-side combine; a hot offset is one row per task after it.
    """
    cols = ["row_id", "event_time", "arrival", *([value] if value else [])]
    own = F.when(F.col("topic").isNull() | F.col("partition_id").isNull() | F.col("kafka_offset").isNull(), F.col("row_id"))
    g = rows.groupBy(*DELIVERY[:-1], own.alias("_own")).agg(F.min(F.struct(*cols)).alias("_r"))
    return g.select(*DELIVERY, *[F.col(f"_r.{c}").alias(c) for c in cols])


def with_periods(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``period_start`` (microseconds) and ``verdict``: on_time, correction, too_late, or null without times."""
    small = limits.limit(LIMITS_BROADCAST + 1).count() <= LIMITS_BROADCAST
    longest = limits.where("period_minutes > 0").groupBy("table_name", "topic").agg(F.max(F.struct("period_minutes", "cutoff_minutes")).alias("_l"))
    lim = longest.select("table_name", "topic", *[(F.col(f"_l.{c}").cast("bigint") * 60_000_000).alias(n) for c, n in (("period_minutes", "_p"), ("cutoff_minutes", "_c"))])
    j = rows.join(F.broadcast(lim) if small else lim, ["table_name", "topic"])
    e, a = _us("event_time"), _us("arrival")
    start = F.when(a.isNotNull(), e - F.pmod(e, F.col("_p")))
    end = start + F.col("_p")
    verdict = F.when(a < end, "on_time").when(a <= end + F.col("_c"), "correction").when(end.isNotNull(), "too_late")
    return j.withColumn("period_start", start).withColumn("verdict", verdict).drop("_p", "_c")


class RestatedPeriods:
    """Retained events with their verdicts, and counts and sums per (table_name, topic, period), kept right batch by batch."""

    PARTS = ["table_name", "period_day"]
    #: Touched days are pushed down to the scan of the retained rows up to this many.
    DAYS_PUSHED = 2000

    def __init__(self, spark: SparkSession, root: str, limits: DataFrame, total_type: str = "bigint"):
        self.spark, self.root, self.limits, self.total_type = spark, root.rstrip("/"), limits, total_type
        parts = ", ".join(f"{c} string" for c in self.PARTS)
        self.schemas = {
            "events": f"topic string, partition_id int, kafka_offset bigint, _own bigint, row_id bigint, event_time timestamp_ntz, arrival timestamp_ntz, amount {total_type}, period_start bigint, verdict string, {parts}",
            "periods": f"topic string, period_start bigint, n_rows bigint, n_first bigint, n_corrections bigint, total {total_type}, {parts}",
        }

    def _stored(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}") if fs.exists(path) else None

    def _live(self, name: str, mark: str) -> DataFrame:
        df = self._stored(name)
        return self.spark.createDataFrame([], self.schemas[name]) if df is None else df.where(F.col(mark).isNotNull())

    def read(self) -> DataFrame:
        """The aggregates."""
        return self._live("periods", "period_start")

    def retained(self) -> DataFrame:
        """The first delivery of each event with its verdict."""
        return self._live("events", "row_id")

    def _placed(self, rows: DataFrame, value: str) -> DataFrame:
        day = F.coalesce(F.date_format(F.timestamp_micros("period_start"), "yyyy-MM-dd"), F.lit("none"))
        placed = with_periods(first_deliveries(rows, value), self.limits).withColumn("period_day", day).withColumn("amount", F.col(value).cast(self.total_type))
        return placed.select(*[c.split()[0] for c in self.schemas["events"].split(", ")])

    def _replace(self, name: str, rows: DataFrame, touched: DataFrame) -> None:
        """Overwrite the touched partitions; each gets a row of nulls as well, so that one without rows is emptied in the same commit."""
        out = rows.unionByName(touched, allowMissingColumns=True).select(*[c.split()[0] for c in self.schemas[name].split(", ")])
        out.hint("rebalance", *self.PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.PARTS).parquet(f"{self.root}/{name}")

    def apply(self, batch: DataFrame, value: str) -> None:
        """Take in a batch and restate the partitions it touches."""
        new = materialize(self._placed(batch, value), "batch")
        old = self._stored("events")
        if old is None:
            rows, touched = new, new.select(*self.PARTS).distinct()
            summed = touched
        else:
            old = old.where("row_id is not null")
            known = old.select(*[F.col(c).alias(f"_k_{c}") for c in [*DELIVERY, "row_id", "period_day"]])
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in DELIVERY])
            met = materialize(broadcast_if_small(new, base=new).join(known, same, "left"), "met")
            fresh = met.where("_k_row_id is null or row_id < _k_row_id").select(*new.columns)
            # an earlier row that comes in later takes the place of the one retained
            stale = met.where("row_id < _k_row_id").select("table_name", "topic", F.col("_k_period_day").alias("period_day"), F.col("_k_row_id").alias("row_id"))
            at = met.where("_k_row_id is null or row_id <= _k_row_id")
            touched = at.select(*self.PARTS).unionByName(stale.select(*self.PARTS)).distinct()
            summed = at.where("verdict in ('on_time', 'correction')").select(*self.PARTS).unionByName(stale.select(*self.PARTS)).distinct()
            touched, summed = materialize(touched, "touched"), materialize(summed, "summed")
            days = [r[0] for r in touched.select("period_day").distinct().limit(self.DAYS_PUSHED + 1).collect()]
            kept = old.where(F.col("period_day").isin(days)) if len(days) <= self.DAYS_PUSHED else old
            kept = kept.join(broadcast_if_small(touched, base=touched), self.PARTS, "left_semi").join(stale.select("table_name", "row_id"), ["table_name", "row_id"], "left_anti")
            rows = materialize(kept.unionByName(fresh), "restated")
        counted = rows.where("verdict in ('on_time', 'correction')").join(summed, self.PARTS, "left_semi") if old is not None else rows.where("verdict in ('on_time', 'correction')")
        sums = counted.groupBy(*self.PARTS, "topic", "period_start").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("verdict") == "on_time").alias("n_first"),
            F.count_if(F.col("verdict") == "correction").alias("n_corrections"),
            F.sum("amount").cast(self.total_type).alias("total"),
        )
        self._replace("periods", sums, summed)
        self._replace("events", rows, touched)
