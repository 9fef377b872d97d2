"""Queries on sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import late
from ..plans.runtime import scratch
from ..registry import query
from ..sources import files, lines
from ..sources.tables import load
from ..streaming import streams as T

# ---------------------------------------------------------------- sources and sinks


@query("source_formats_agree", " union all ".join(f"select '{f}' as fmt, count(*) as n, sum(o_orderkey)::bigint as keys, round(sum(o_totalprice), 2) as total from orders" for f in ("parquet", "orc", "json", "csv")))
def source_formats_agree(spark: SparkSession, sf: str) -> DataFrame:
    """The same table through four formats."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = None
    for fmt in ("parquet", "orc", "json", "csv"):
        p = scratch(spark, fmt)
        files.write(o, p, fmt, **({"header": "true", "sep": ";"} if fmt == "csv" else {}))
        r = files.read_csv(spark, p) if fmt == "csv" else files.read(spark, p, fmt, o.schema)
        a = r.agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("bigint").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        out = a if out is None else out.unionByName(a)
    return out


@query("sink_partition_overwrite", "select o_orderstatus, count(*) filter (o_orderstatus <> 'P' or o_totalprice > 200000) as n from orders group by 1")
def sink_partition_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """A second write replaces one partition and leaves the others."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    p = scratch(spark, "partitioned")
    files.write(o, p, partition_by=["o_orderstatus"])
    files.write(o.where("o_orderstatus = 'P' and o_totalprice > 200000"), p, partition_by=["o_orderstatus"], overwrite_partitions=True)
    return files.read(spark, p).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("source_pushed_filters", "select n_nationkey, n_name from nation where n_regionkey = 2 and n_nationkey > 5")
def source_pushed_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A custom source answers the filters itself; its files are one JSON line per row."""
    p = scratch(spark, "lines")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.json(p)
    lines.register(spark)
    # the source reads files as Python does, so the shared folder must be mounted on every node
    return spark.read.format("json_lines").schema(n.schema).load(p.removeprefix("file:").replace("//", "/")).where("n_regionkey = 2 and n_nationkey > 5").select("n_nationkey", "n_name")


@query("source_unseen_files", "select distinct subject, file_no from schema_events where file_no > 2")
def source_unseen_files(spark: SparkSession, sf: str) -> DataFrame:
    landed = load(spark, sf, "schema_events").select("subject", "file_no")
    return files.unseen(landed, landed.where("file_no <= 2").distinct(), ["subject", "file_no"])


@query(
    "sink_dead_letters",
    "select reason, count(*) as n from (select case when not coalesce(customer_id is not null, false) then 'no_customer' when not coalesce(amount_cents > 0, false) then 'no_amount' when not coalesce(trim(status) <> '', false) then 'no_status' end reason from raw_orders) where reason is not null group by 1",
)
def sink_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"no_customer": F.col("customer_id").isNotNull(), "no_amount": F.col("amount_cents") > 0, "no_status": F.trim("status") != ""}
    return files.split_valid(load(spark, sf, "raw_orders"), checks)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("dead_letter_retries", "select id, case when retry_count < 3 then 'retry' else 'give_up' end as verdict, case when retry_count < 3 then created_at + to_seconds(cast(60 * pow(2, retry_count) as bigint)) end as retry_at from outbox where last_error is not null")
def dead_letter_retries(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "outbox").where("last_error is not null")
    return files.with_retry(o, "retry_count", 3, 60, "created_at").select("id", "verdict", "retry_at")


@query("log_replay_window", "select landing_id from sample_events where kafka_offset >= 50 and event_timestamp >= timestamp '2025-06-05' and event_timestamp < timestamp '2025-06-12'")
def log_replay_window(spark: SparkSession, sf: str) -> DataFrame:
    return files.replay(load(spark, sf, "sample_events"), "kafka_offset", "event_timestamp", 50, "2025-06-05", "2025-06-12").select("landing_id")


# ---------------------------------------------------------------- streams


@query("stream_tumbling_counts", "select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = T.stream_in_parts(spark, sf, "events", "ts").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    c = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return T.run_complete(c.select(F.col("w.start").alias("window_start"), "event_type", "n"), "tumbling").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_deduplicated", "select topic, count(distinct (partition_id, kafka_offset)) as n from sample_events group by 1")
def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    s = T.stream_in_parts(spark, sf, "sample_events", "landing_id").select("topic", "partition_id", "kafka_offset").dropDuplicates(["topic", "partition_id", "kafka_offset"])
    return T.run_append(s, "deduplicated").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_rescued_fields",
    """with p as (select topic, case when json_valid(payload) and json_type(payload) = 'OBJECT' then json_keys(payload) end k from sample_events where payload is not null)
select topic, count(*) filter (k is null) as n_corrupt, cast(coalesce(sum(len(list_filter(k, lambda x: x not in ('amount')))), 0) as bigint) as n_rescued from p group by 1""",
)
def stream_rescued_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads parsed as they stream in, with what the schema doesn't have kept beside it."""
    s = T.stream_in_parts(spark, sf, "sample_events", "landing_id").where("payload is not null").select("topic", "payload")
    r = T.run_append(files.with_rescued(s, "payload", "amount string").select("topic", "_rescued"), "rescued")
    bad = F.map_contains_key("_rescued", "_corrupt")
    return r.groupBy("topic").agg(F.count_if(bad).alias("n_corrupt"), F.coalesce(F.sum(F.when(~bad, F.size("_rescued"))), F.lit(0)).cast("bigint").alias("n_rescued"))


@query(
    "stream_closed_sessions",
    """with m as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute then 1 else 0 end s from events window w as (partition by user_id order by ts, event_id)), n as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) k from m),
t as (select user_id, min(ts) first_ts, max(ts) last_ts, count(*) n from n group by user_id, k) select user_id, first_ts, n from t where last_ts + interval 30 minute <= (select max(ts) from events) - interval 10 minute""",
)
def stream_closed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = T.closed_sessions(T.stream_in_parts(spark, sf, "events", "ts"), "user_id", "ts", "30 minutes", "10 minutes")
    return T.run_append(s, "sessions").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


@query("stream_joined_within", "select e.event_id as l_id, c.event_id as r_id from events e join events c on e.user_id = c.user_id and e.event_type = 'error' and c.event_type = 'click' and c.ts > e.ts and c.ts <= e.ts + interval 10 minute")
def stream_joined_within(spark: SparkSession, sf: str) -> DataFrame:
    def side(kind: str, p: str) -> DataFrame:
        return T.stream_in_parts(spark, sf, "events", "ts").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("ts").cast("timestamp").alias(f"{p}_ts"))

    return T.run_append(T.joined_within(side("error", "l"), side("click", "r"), "user_id", 600, "10 minutes"), "joined")


@query("stream_running_totals", "select user_id, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed state over batches; the last batch's row of a key is its total."""
    out = T.OnceSink(spark, scratch(spark, "totals"))
    T.run_batches(T.running_totals(T.stream_in_parts(spark, sf, "events", "ts"), "user_id", "value"), "totals", out, "update")
    r = out.read().groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return r.select("user_id", "x.n", F.round("x.total", 2).alias("total"))


@query("stream_restated_periods", "select topic, sum(n_rows)::bigint as n_rows from (select topic, count(*) n_rows from (select * from sample_events qualify row_number() over (partition by topic, partition_id, kafka_offset order by landing_id) = 1) join lateness_limits l using (topic) where l.table_name = 'sample_events' and event_timestamp is not null and epoch_us(received_at) <= (epoch_us(event_timestamp) // (period_minutes::bigint * 60000000) + 1) * (period_minutes::bigint * 60000000) + cutoff_minutes::bigint * 60000000 group by 1) group by 1")
def stream_restated_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Every micro-batch restates the periods it touches from the events retained so far."""
    t = late.RestatedPeriods(spark, scratch(spark, "restated"), load(spark, sf, "lateness_limits"))
    cols = [F.lit("sample_events").alias("table_name"), "topic", "partition_id", "kafka_offset", F.col("landing_id").alias("row_id"), F.col("event_timestamp").alias("event_time"), F.col("received_at").alias("arrival"), F.lit(1).cast("bigint").alias("amount")]
    T.run_batches(T.stream_in_parts(spark, sf, "sample_events", "landing_id").select(*cols), "restated", lambda batch, _: t.apply(batch, "amount"))
    return t.read().groupBy("topic").agg(F.sum("n_rows").alias("n_rows"))


@query(
    "late_by_running_maximum",
    "select landing_id from (select *, max(epoch_us(event_timestamp)) over (partition by topic, partition_id order by landing_id rows between unbounded preceding and 1 preceding) m from sample_events) where epoch_us(event_timestamp) < m - 3600000000",
)
def late_by_running_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return T.late_by_running_maximum(load(spark, sf, "sample_events"), ["topic", "partition_id"], ["landing_id"], "event_timestamp", 3600).where("late").select("landing_id")


@query("lambda_equals_replay", "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def lambda_equals_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A batch view of what is old, a speed view of what is new, merged by addition."""
    e = load(spark, sf, "events")
    view = lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    both = view(e.where("event_id % 3 <> 0")).unionByName(view(e.where("event_id % 3 = 0")))
    return both.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
