"""Queries on indicators, incremental views, dimensions, contracts, codecs, keyed state and further sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions import checksums
from ..operators import delta, features as X, history, layout, provenance as P, quality as Q, temporal, versions as V
from ..plans.runtime import scratch
from ..registry import query
from ..sources import files
from ..sources.tables import load
from ..streaming import streams as T

# ---------------------------------------------------------------- indicators

_HOURLY = "select event_type, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as bar_start, arg_max(value, row(ts, event_id)) as close from events where value is not null group by 1, 2"
_NUMBERED = f"b as (select *, row_number() over (partition by event_type order by bar_start) r from ({_HOURLY}))"


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.bars(load(spark, sf, "events"), ["event_type"], "ts", "value", F.lit(1), 3600, "event_id").select("event_type", "bar_start", "close")


@query(
    "moving_convergence",
    f"""with recursive {_NUMBERED},
m as (select event_type, r, close::double f, close::double s, null::double g from b where r = 1 union all
select event_type, r, f, s, case when r < 26 then null when r = 26 then f - s else g + ((f - s) - g) * (case when r - 25 <= 9 then 1.0 / (r - 25) else 0.2 end)::double end
from (select m.event_type, b.r, m.g, f + (close - f) * (case when b.r <= 12 then 1.0 / b.r else 2.0 / 13 end)::double f, s + (close - s) * (case when b.r <= 26 then 1.0 / b.r else 2.0 / 27 end)::double s from m join b on b.event_type = m.event_type and b.r = m.r + 1))
select event_type, bar_start, round(f - s, 5) as macd, round(g, 5) as signal, round(f - s - g, 5) as histogram from m join b using (event_type, r) where r >= 34""",
)
def moving_convergence(spark: SparkSession, sf: str) -> DataFrame:
    m = temporal.macd(_hourly(spark, sf), ["event_type"], ["bar_start"], "close")
    return m.select("event_type", "bar_start", *[F.round(c, 5).alias(c) for c in ("macd", "signal", "histogram")])


@query(
    "relative_strength",
    f"""with recursive {_NUMBERED}, d as (select *, close - lag(close) over (partition by event_type order by bar_start) x from b),
m as (select event_type, 2 as r, greatest(x, 0)::double g, greatest(-x, 0)::double l from d where r = 2 union all
select d.event_type, d.r, g + (greatest(x, 0) - g) * (case when d.r - 1 <= 14 then 1.0 / (d.r - 1) else 1.0 / 14 end)::double, l + (greatest(-x, 0) - l) * (case when d.r - 1 <= 14 then 1.0 / (d.r - 1) else 1.0 / 14 end)::double from m join d on d.event_type = m.event_type and d.r = m.r + 1)
select event_type, bar_start, round(case when l = 0 then 100 else 100 - 100 / (1 + g / l) end, 5) as rsi from m join b using (event_type, r) where r >= 15""",
)
def relative_strength(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.relative_strength(_hourly(spark, sf), ["event_type"], ["bar_start"], "close").withColumn("rsi", F.round("rsi", 5))


@query(
    "price_gaps",
    f"select event_type, bar_start, round(close / prev - 1, 6) as gap from (select *, lag(close) over (partition by event_type order by bar_start) prev from ({_HOURLY})) where prev > 0 and abs(close / prev - 1) >= 0.5",
)
def price_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that close at least half above or below the one before."""
    prev = F.lag("close").over(Window.partitionBy("event_type").orderBy("bar_start"))
    g = _hourly(spark, sf).withColumn("prev", prev).where("prev > 0").withColumn("gap", F.col("close") / F.col("prev") - 1)
    return g.where(F.abs("gap") >= 0.5).select("event_type", "bar_start", F.round("gap", 6).alias("gap"))


@query(
    "rfm_scores",
    """with m as (select max(o_orderdate) now from orders), o as (select c_custkey, count(o_orderkey) f, round(coalesce(sum(o_totalprice), 0), 2) v, coalesce(date_diff('day', max(o_orderdate)::date, any_value(now)::date), 100000) age from customer left join orders on o_custkey = c_custkey, m group by 1),
s as (select *, cume_dist() over (order by f) pf, cume_dist() over (order by v) pv, cume_dist() over (order by age desc) pr from o)
select c_custkey, """
    + ", ".join(f"case when f = 0 then 1 when {p} > .8 then 5 when {p} > .6 then 4 when {p} > .4 then 3 when {p} > .2 then 2 else 1 end as {n}" for p, n in (("pr", "r_score"), ("pf", "f_score"), ("pv", "m_score")))
    + " from s",
)
def rfm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Recency, frequency and value of each customer as fifths of all customers."""
    o = load(spark, sf, "orders")
    now = F.broadcast(o.agg(F.to_date(F.max("o_orderdate")).alias("now")))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("f"), F.round(F.sum("o_totalprice"), 2).alias("v"), F.to_date(F.max("o_orderdate")).alias("last"))
    c = load(spark, sf, "customer").select("c_custkey").join(g, F.col("c_custkey") == F.col("o_custkey"), "left").join(now, F.lit(True))
    c = c.select("c_custkey", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("v", F.lit(0.0)).alias("v"), (-F.coalesce(F.datediff("now", "last"), F.lit(100000))).alias("r"))
    s = layout.quantile_scores(c, {"r": "r_score", "f": "f_score", "v": "m_score"}, 5)
    return s.select("c_custkey", *[F.when(F.col("f") == 0, 1).otherwise(F.col(n)).alias(n) for n in ("r_score", "f_score", "m_score")])


# ---------------------------------------------------------------- watermarks and reordering

_LAGS = "select landing_id, topic, batch_id, greatest(0, floor((epoch_us(received_at) - epoch_us(event_timestamp)) / 1000000.0))::bigint lag from sample_events where topic is not null and batch_id is not null and event_timestamp is not null and received_at is not null"


@query(
    "late_by_percentile",
    f"""with s as ({_LAGS}), h as (select topic, batch_id, lag, count(*) n from s group by 1, 2, 3), b as (select distinct topic, batch_id from s),
c as (select b.topic, b.batch_id, lag, sum(n) n from b join h on h.topic = b.topic and h.batch_id < b.batch_id group by 1, 2, 3), d as (select *, sum(n) over (partition by topic, batch_id order by lag) u, sum(n) over (partition by topic, batch_id) t from c),
a as (select topic, batch_id, min(lag) a from d where u >= ceil(0.9 * t) group by 1, 2)
select landing_id, greatest(coalesce(a, 0), 60)::bigint as allowed_seconds from s left join a using (topic, batch_id) where lag > greatest(coalesce(a, 0), 60)""",
)
def late_by_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows later than nine tenths of their topic's rows of earlier batches were."""
    e = load(spark, sf, "sample_events").where("topic is not null").select("landing_id", "topic", "batch_id", "event_timestamp", "received_at")
    return temporal.dynamic_watermarks(e, ["topic"], "batch_id", "event_timestamp", "received_at", 0.9, 60).where("late").select("landing_id", "allowed_seconds")


_HELD = """select *, case when event_timestamp is null then 'no_time' when row_number() over (partition by topic, partition_id, kafka_offset order by landing_id) > 1 then 'repeated'
when epoch_us(event_timestamp) < max(epoch_us(event_timestamp)) over (partition by topic, partition_id order by landing_id rows between unbounded preceding and 1 preceding) - 7200000000 then 'too_late' end reason from sample_events"""


@query("reorder_positions", f"select landing_id, row_number() over (partition by topic, partition_id order by event_timestamp, landing_id) as position from ({_HELD}) where reason is null")
def reorder_positions(spark: SparkSession, sf: str) -> DataFrame:
    """What a buffer that holds rows for two hours gives out, in order of event time."""
    e = load(spark, sf, "sample_events").select("landing_id", "topic", "partition_id", "kafka_offset", "event_timestamp")
    return temporal.reordered(e, ["topic", "partition_id"], ["landing_id"], "event_timestamp", 7200, ["kafka_offset"])[0].select("landing_id", F.col("position").cast("bigint").alias("position"))


@query("reorder_dead_letters", f"select reason, count(*) as n from ({_HELD}) where reason is not null group by 1")
def reorder_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "sample_events").select("landing_id", "topic", "partition_id", "kafka_offset", "event_timestamp")
    return temporal.reordered(e, ["topic", "partition_id"], ["landing_id"], "event_timestamp", 7200, ["kafka_offset"])[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- incremental views

_VIEW = "select o_orderkey, c_mktsegment, n from (select o_orderkey, o_custkey c from orders where {0}) left join (select c_custkey c, c_mktsegment from customer where {1}) using (c) cross join (values ({2})) t(n)"


@query(
    "delta_left_join",
    "select o_orderkey, c_mktsegment, cast(sum(n) as bigint) as _diff from ("
    + _VIEW.format("o_orderkey % 10 <> 0 or o_orderkey % 20 = 10", "c_custkey % 3 <> 1", 1)
    + " union all "
    + _VIEW.format("o_orderkey % 10 <> 0 or o_orderkey % 20 = 0", "c_custkey % 3 <> 0", -1)
    + ") group by 1, 2 having sum(n) <> 0",
)
def delta_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders come and go while customers do, so rows gain and lose their segment."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("c"), "c_mktsegment")
    base, d = delta.signed(o.where("o_orderkey % 10 <> 0 or o_orderkey % 20 = 0")), delta.signed(o.where("o_orderkey % 10 = 0"), F.when(F.col("o_orderkey") % 20 == 0, -1).otherwise(1))
    right, dr = delta.signed(c.where("c % 3 <> 0")), delta.signed(c.where("c % 3 <> 2"), F.when(F.col("c") % 3 == 1, -1).otherwise(1))
    return delta.left_joined(base, d, right, dr, ["c"]).groupBy("o_orderkey", "c_mktsegment").agg(F.sum("_diff").alias("_diff")).where("_diff <> 0")


@query(
    "delta_average",
    """with t as (select distinct o_custkey from orders where o_orderkey % 7 = 0)
select o_custkey, round(avg(o_totalprice), 4) as mean, -1 as _diff from orders where o_orderkey % 7 <> 0 and o_custkey in (select * from t) group by 1 union all select o_custkey, round(avg(o_totalprice), 4), 1 from orders where o_custkey in (select * from t) group by 1""",
)
def delta_average(spark: SparkSession, sf: str) -> DataFrame:
    o = delta.signed(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    return delta.averaged(o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 7 = 0"), ["o_custkey"], "o_totalprice").withColumn("mean", F.round("mean", 4))


@query(
    "delta_rank",
    """with t as (select distinct o_custkey from orders where o_orderkey % 9 = 0), a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders where o_custkey in (select * from t)),
b as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders where o_orderkey % 9 <> 0 and o_custkey in (select * from t))
select o_custkey, o_orderkey, rank::int as rank, cast(sum(n) as bigint) as _diff from (select *, 1 n from a where rank <= 3 union all select *, -1 from b where rank <= 3) group by 1, 2, 3 having sum(n) <> 0""",
)
def delta_rank(spark: SparkSession, sf: str) -> DataFrame:
    """How the three largest orders of customers change as a ninth of all orders comes in."""
    o = delta.signed(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    r = delta.ranked(o.where("o_orderkey % 9 <> 0"), o.where("o_orderkey % 9 = 0"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return r.groupBy("o_custkey", "o_orderkey", "rank").agg(F.sum("_diff").alias("_diff")).where("_diff <> 0")


# ---------------------------------------------------------------- dimensions, versions, logs

_V = "select user_id, value, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) nxt, event_type from events"


@query("scd4_tables", f"select 'current' as part, user_id, value, valid_from, null::timestamp as replaced_at from ({_V}) where nxt is null and event_type <> 'error' union all select 'history', user_id, value, valid_from, nxt from ({_V}) where nxt is not null and event_type <> 'error'")
def scd4_tables(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", op.alias("op"), "value")
    now, past = V.scd4(e, ["user_id"], "ts", ["event_id"], "op", ["value"])
    return now.select(F.lit("current").alias("part"), "user_id", "value", "valid_from", F.lit(None).cast("timestamp_ntz").alias("replaced_at")).unionByName(past.select(F.lit("history").alias("part"), "user_id", "value", "valid_from", "replaced_at"))


_SNAP = "(select customer_id, arg_max(city, row(loaded_at, city)) city, arg_max(segment, row(loaded_at, segment)) segment from customer_snapshots where snapshot_date = (select {0}(snapshot_date) from customer_snapshots) and customer_id is not null group by 1)"


@query(
    "merge_closing_history",
    f"""with a as {_SNAP.format('min')}, b as {_SNAP.format('max')}, j as (select coalesce(a.customer_id, b.customer_id) customer_id, a.customer_id is not null had, b.customer_id is not null has, a.city ac, a.segment sg, b.city bc, b.segment bs from a full join b using (customer_id))
select customer_id, ac as city, sg as segment, timestamp '2025-05-01' as valid_from, case when has and (ac is distinct from bc or sg is distinct from bs) then timestamp '2025-12-01' end as valid_to from j where had
union all select customer_id, bc, bs, timestamp '2025-12-01', null from j where has and (not had or ac is distinct from bc or sg is distinct from bs)""",
)
def merge_closing_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last snapshot merged into a dimension made of the first."""
    s = load(spark, sf, "customer_snapshots").where("customer_id is not null")
    ends = s.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))

    def of(end: str) -> DataFrame:
        x = s.join(F.broadcast(ends.select(F.col(end).alias("snapshot_date"))), "snapshot_date")
        return x.groupBy("customer_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("loaded_at", c))).alias(c) for c in ("city", "segment")])

    dim = of("lo").withColumn("valid_from", F.lit("2025-05-01").cast("timestamp_ntz")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return V.merge_closing(dim, of("hi"), ["customer_id"], ["city", "segment"], F.lit("2025-12-01").cast("timestamp_ntz"))


@query(
    "log_changed_columns",
    """with f as (select id, _cdc_lsn, status, total_amount, currency, row_number() over (partition by id, _cdc_lsn order by _dw_loaded_at nulls last, status nulls last) k from fact_orders where id is not null and _cdc_lsn is not null and lower(_cdc_op) <> 'd'),
g as (select *, lag(_cdc_lsn) over w pl, lag(status) over w ps, lag(total_amount) over w pt, lag(currency) over w pc from f where k = 1 window w as (partition by id order by _cdc_lsn))
select changed, count(*) as n from (select concat_ws(',', case when pc is distinct from currency then 'currency' end, case when ps is distinct from status then 'status' end, case when pt is distinct from total_amount then 'total_amount' end) changed from g where pl is not null) group by 1""",
)
def log_changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns successive images of an order differ in; none is an update without effect."""
    f = load(spark, sf, "fact_orders").where("id is not null and _cdc_lsn is not null and lower(_cdc_op) <> 'd'")
    image = F.create_map(*[x for c in ("status", "total_amount", "currency") for x in (F.lit(c), F.col(c).cast("string"))])
    one = Window.partitionBy("id", "_cdc_lsn").orderBy(F.asc_nulls_last("_dw_loaded_at"), F.asc_nulls_last("status"))
    f = f.withColumn("_k", F.row_number().over(one)).where("_k = 1").withColumn("image", image)
    f = f.withColumn("before", F.lag("image").over(Window.partitionBy("id").orderBy("_cdc_lsn"))).where("before is not null")
    return f.groupBy(F.array_join(V.changed_columns("before", "image"), ",").alias("changed")).agg(F.count(F.lit(1)).alias("n"))


@query("table_change_feed", "select o_orderkey, 'insert' as _change from orders where o_orderstatus = 'O' union all select o_orderkey, 'delete' from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0")
def table_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between two versions of a table: an append and a delete."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    t = V.VersionedTable(spark, scratch(spark, "feed"))
    t.append(o.where("o_orderstatus = 'F'"))
    t.append(o.where("o_orderstatus = 'O'"))
    t.delete("o_orderstatus = 'F' and o_orderkey % 2 = 0")
    return t.changes(1, 3).select("o_orderkey", "_change")


@query(
    "retention_by_size_and_tag",
    "select doc_id from (select *, sum(n_chars) over (partition by project order by updated_at desc, doc_id desc rows unbounded preceding) b from documents where coalesce(lower(lang) <> 'vi', true)) where b <= 20000 union all select doc_id from documents where lower(lang) = 'vi'",
)
def retention_by_size_and_tag(spark: SparkSession, sf: str) -> DataFrame:
    """The newest texts of a project up to 20,000 characters, and all that are tagged to be kept."""
    d = load(spark, sf, "documents").select("doc_id", "project", "updated_at", "n_chars", "lang")
    return V.retained(d, ["project"], "updated_at", "doc_id", F.lit(None), most_bytes=20000, size="n_chars", tagged=F.lower("lang") == "vi").select("doc_id")


# ---------------------------------------------------------------- contracts, features, codecs


@query(
    "contract_report",
    """select * from (values ('column:id', true), ('column:amount_cents', true), ('column:channel', false)) t("rule", kept) union all select 'not_null:customer_id', count(*) filter (customer_id is not null) >= 0.9 * count(*) from raw_orders
union all select 'range:quantity', count(*) filter (quantity is null or quantity between 1 and 3) >= 0.999 * count(*) from raw_orders union all select 'fresh:updated_at', max(updated_at) >= timestamp '2025-08-01' - interval 96 hour from raw_orders""",
)
def contract_report(spark: SparkSession, sf: str) -> DataFrame:
    c = Q.Contract({"id": "bigint", "amount_cents": "bigint", "channel": "string"}, ("updated_at", 96), ((Q.not_null("customer_id"), 0.9), (Q.in_range("quantity", 1, 3), 0.999)))
    return Q.kept_contract(load(spark, sf, "raw_orders"), c, F.lit("2025-08-01").cast("timestamp_ntz"))


@query(
    "feature_lags",
    "select o_orderkey, round(least(greatest(o_totalprice, 50000), 300000), 2) as clipped, list_position(['O', 'P', 'F'], o_orderstatus) - 1 as place, lag(o_totalprice, 1) over w as o_totalprice_lag1, lag(o_totalprice, 3) over w as o_totalprice_lag3 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
)
def feature_lags(spark: SparkSession, sf: str) -> DataFrame:
    o = X.lagged(load(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", [1, 3])
    return o.select("o_orderkey", F.round(X.clipped("o_totalprice", 50000, 300000), 2).alias("clipped"), X.ordinal("o_orderstatus", ["O", "P", "F"]).alias("place"), "o_totalprice_lag1", "o_totalprice_lag3")


@query("replica_signed_counters", "select l_suppkey, cast(sum(u) - sum(d) as bigint) as total from (select l_suppkey, l_linenumber, max(l_orderkey) u, max(l_partkey) d from lineitem group by 1, 2) group by 1")
def replica_signed_counters(spark: SparkSession, sf: str) -> DataFrame:
    return X.merged_signed_counters(load(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_orderkey", "l_partkey")


@query("replica_sets", "select distinct user_id, event_type from events e where event_type <> 'error' and not exists (select 1 from events r where r.event_type = 'error' and r.user_id = e.user_id and r.event_id = e.event_id + 1)")
def replica_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Each event adds its kind under its id; an error removes the add with the id before its own, if it was the same user's."""
    e = load(spark, sf, "events")
    adds = e.where("event_type <> 'error'").select("user_id", "event_type", "event_id")
    seen = adds.select(F.col("user_id").alias("u"), "event_type", F.col("event_id").alias("a"))
    gone = e.where("event_type = 'error'").select("user_id", (F.col("event_id") - 1).alias("event_id")).join(seen, (F.col("u") == F.col("user_id")) & (F.col("a") == F.col("event_id"))).select("user_id", "event_type", "event_id")
    return X.merged_sets(adds, gone, "user_id", "event_type", "event_id")


@query("dictionary_codes", "select p_type as value, row_number() over (order by count(*) desc, p_type) - 1 as code from part where p_type is not null group by 1")
def dictionary_codes(spark: SparkSession, sf: str) -> DataFrame:
    return X.dictionary_codes(load(spark, sf, "part"), "p_type")


@query("delta_encoding", "select event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) as delta, epoch_us(ts) as decoded from events")
def delta_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Times of a user as differences, and decoded again."""
    e = load(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return X.undeltas(X.deltas(e, ["user_id"], ["ts", "event_id"], "us"), ["user_id"], ["ts", "event_id"]).select("event_id", "delta", "decoded")


@query("checksum_mod_11", "select c_custkey, (list_sum(list_transform([1,2,3,4,5,6,7,8,9], lambda i: (c_custkey // power(10, 9 - i)::bigint) % 10 * [31,29,23,19,17,13,7,5,3][i])) % 11)::int as rest from customer")
def checksum_mod_11(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sum of the nine digits of a number, modulo 11, from which check digits are made."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return load(spark, sf, "customer").select("c_custkey", checksums.weighted_rest(digits, [31, 29, 23, 19, 17, 13, 7, 5, 3], 11).alias("rest"))


@query(
    "checksum_crc16",
    """select c_custkey, list_reduce(list_prepend(65535::bigint, list_transform(range(1, len(c_name) + 1), lambda i: ascii(c_name[i])::bigint)),
lambda c, b: list_reduce(list_prepend(xor(c, b << 8), range(8)), lambda v, i: case when (v & 32768) > 0 then xor(v << 1, 4129) & 65535 else (v << 1) & 65535 end))::int as crc from customer""",
)
def checksum_crc16(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", checksums.crc16(F.col("c_name")).alias("crc"))


# ---------------------------------------------------------------- functions of one's own


@F.pandas_udf(DoubleType())
def _log_size(x: pd.Series) -> pd.Series:
    import numpy as np

    return np.log10(x.clip(lower=1.0))


@F.pandas_udf(DoubleType())
def _geometric_mean(x: pd.Series) -> float:
    import numpy as np

    return float(np.exp(np.log(x.clip(lower=1.0)).mean()))


@query("udf_scalar", "select o_orderkey, round(log10(greatest(o_totalprice, 1)), 6) as size from orders")
def udf_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """A function of one's own, in Arrow batches."""
    return load(spark, sf, "orders").select("o_orderkey", F.round(_log_size("o_totalprice"), 6).alias("size"))


@query("udf_aggregate", "select o_custkey, round(exp(avg(ln(greatest(o_totalprice, 1)))), 2) as mean from orders group by 1")
def udf_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of one's own: a group's values are in one task, so it suits keys of bounded size, such as a customer's orders."""
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.round(_geometric_mean("o_totalprice"), 2).alias("mean"))


@query("provenance_exact_probability", "select r_name, round((1 - r_regionkey / 20.0) * (1 - p), 8) as p from region join (select n_regionkey, product(1 - (n_nationkey % 7 + 1) / 10.0) p from nation group by 1) on n_regionkey = r_regionkey")
def provenance_exact_probability(spark: SparkSession, sf: str) -> DataFrame:
    """That a region has any nation, if regions and nations are there with a probability of their own: alternatives share the region."""
    r, n = load(spark, sf, "region"), load(spark, sf, "nation")
    a = P.annotate(r.select("r_name", F.col("r_regionkey").alias("k")), F.array(F.array(F.concat(F.lit("r"), F.col("k").cast("string")))))
    b = P.annotate(n.select(F.col("n_regionkey").alias("k"), "n_nationkey"), F.array(F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))))
    w = P.project(P.join(a, b, ["k"], P.WHY), ["r_name"], P.WHY)
    prob = {f"r{x['r_regionkey']}": 1 - x["r_regionkey"] / 20 for x in r.collect()} | {f"n{x['n_nationkey']}": (x["n_nationkey"] % 7 + 1) / 10 for x in n.collect()}  # 30 fixed rows
    return P.exact_probability(w, "_k", prob).select("r_name", F.round("p", 8).alias("p"))


# ---------------------------------------------------------------- sources


@query("source_bar_separated", "select c_custkey, c_name, c_acctbal from customer")
def source_bar_separated(spark: SparkSession, sf: str) -> DataFrame:
    p = scratch(spark, "bars")
    files.write_bar_separated(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), p)
    return files.read_bar_separated(spark, p, "c_custkey bigint, c_name string, c_acctbal double")


@query(
    "source_rescued_fields",
    """with p as (select subject, payload, case when json_valid(payload) and json_type(payload) = 'OBJECT' then json_keys(payload) end k from schema_events where payload is not null)
select subject, count(*) filter (k is null) as n_corrupt, cast(coalesce(sum(len(list_filter(k, lambda x: x not in ('id', 'status')))), 0) as bigint) as n_rescued from p group by 1""",
)
def source_rescued_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads read by a schema of two fields: how many other fields are rescued, and how many texts are no objects."""
    r = files.with_rescued(load(spark, sf, "schema_events").where("payload is not null").select("subject", "payload"), "payload", "id string, status string")
    bad = F.map_contains_key("_rescued", "_corrupt")
    return r.groupBy("subject").agg(F.count_if(bad).alias("n_corrupt"), F.coalesce(F.sum(F.when(~bad, F.size("_rescued"))), F.lit(0)).cast("bigint").alias("n_rescued"))


@query(
    "source_generated",
    "select order_no % 10 as k, count(*) as n, cast(sum(quantity) as bigint) as quantity, round(sum(price), 2) as price, max(day) as last_day from (select i, i // 4 as order_no, (i * 7919 + 13) % 50 + 1 as quantity, ((i * 104729 + 7) % 100000) / 100.0 as price, date '2024-01-01' + (i % 366)::int as day from range(100000) t(i)) group by 1",
)
def source_generated(spark: SparkSession, sf: str) -> DataFrame:
    g = files.generated_lines(spark, 100_000)
    return g.groupBy((F.col("order_no") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.round(F.sum("price"), 2).alias("price"), F.max("day").alias("last_day"))


# ---------------------------------------------------------------- keyed state


@query("stream_last_three", "select user_id, list(event_id order by ts, event_id) as ids from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 3 group by 1")
def stream_last_three(spark: SparkSession, sf: str) -> DataFrame:
    out = T.OnceSink(spark, scratch(spark, "last-three"))
    T.run_batches(T.last_rows(T.stream_in_parts(spark, sf, "events", "ts"), "user_id", "ts", "event_id", 3), "last-three", out, "update")
    return out.read().groupBy("user_id").agg(F.max_by("ids", "batch").alias("ids"))


@query("stream_kind_counts", "select user_id, event_type as kind, count(*) as n from events group by 1, 2")
def stream_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = T.OnceSink(spark, scratch(spark, "kinds"))
    T.run_batches(T.kind_counts(T.stream_in_parts(spark, sf, "events", "ts"), "user_id", "event_type"), "kinds", out, "update")
    return out.read().groupBy("user_id", "kind").agg(F.max("n").alias("n"))


@query(
    "stream_counts_since_idle",
    "with s as (select *, case when ts - lag(ts) over w > interval 12 hour then 1 else 0 end b from events window w as (partition by user_id order by ts, event_id)), t as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) k from s) select user_id, count(*) as n from t where (user_id, k) in (select user_id, max(k) from t group by 1) group by 1",
)
def stream_counts_since_idle(spark: SparkSession, sf: str) -> DataFrame:
    out = T.OnceSink(spark, scratch(spark, "idle"))
    T.run_batches(T.counts_since_idle(T.stream_in_parts(spark, sf, "events", "ts"), "user_id", "ts", 12 * 3600), "idle", out, "update")
    return out.read().groupBy("user_id").agg(F.max_by("n", "batch").alias("n"))


@query("stream_quality_gate", "select count(*) as n, count(*) filter (not (amount_cents is null or amount_cents between 1 and 100000)) as n_bad from raw_orders")
def stream_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Every row ends on one side of the gate; a batch passes with 99 % good rows."""
    g = T.QualityGate(spark, scratch(spark, "gate"), Q.in_range("amount_cents", 1, 100000).good, 0.99)
    T.run_batches(T.stream_in_parts(spark, sf, "raw_orders", "_ingested_at"), "gate", g)
    return g.read().agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ok")).alias("n_bad"))


@query("stream_bars", "select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as bar_start, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close from events where value is not null group by 1, 2")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = T.stream_in_parts(spark, sf, "events", "ts").where("ts is not null and value is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    k = F.struct("ts", "event_id")
    b = e.groupBy("event_type", F.window("at", "1 day").alias("w")).agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"))
    return T.run_complete(b.select("event_type", F.col("w.start").alias("bar_start"), "open", "high", "low", "close"), "bars").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- states that last, rates, abandonment


@query(
    "stuck_records",
    "with l as (select id, arg_max(status, row(updated_at, coalesce(status, ''))) status, max(updated_at) u from raw_orders where updated_at is not null and id is not null group by 1) select id, date_diff('day', u::date, (select max(updated_at) from raw_orders)::date)::int as days from l where coalesce(lower(trim(status)), '') not in ('delivered', 'cancelled') and u < (select max(updated_at) from raw_orders) - interval 20 day",
)
def stuck_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that haven't reached an end and weren't touched for twenty days."""
    r = load(spark, sf, "raw_orders").where("updated_at is not null and id is not null")
    now = F.broadcast(r.agg(F.max("updated_at").alias("now")))
    last = r.groupBy("id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("updated_at", "status"))).alias("status"), F.max("updated_at").alias("u"))
    open_ = last.join(now, F.lit(True)).where(~F.coalesce(F.lower(F.trim("status")), F.lit("")).isin("delivered", "cancelled") & (F.col("u") < F.col("now") - F.expr("interval 20 days")))
    return open_.select("id", F.datediff("now", "u").alias("days"))


@query("rates_with_floor", "select customer_id, count(*) as n, round(count(*) filter (lower(trim(status)) = 'cancelled') / count(*), 6) as rate from raw_orders where customer_id is not null group by 1 having count(*) >= 20 and count(*) filter (lower(trim(status)) = 'cancelled') >= 0.1 * count(*)")
def rates_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of keys that have rows enough to judge."""
    g = load(spark, sf, "raw_orders").where("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower(F.trim("status")) == "cancelled").alias("c"))
    return g.where((F.col("n") >= 20) & (F.col("c") >= 0.1 * F.col("n"))).select("customer_id", "n", F.round(F.col("c") / F.col("n"), 6).alias("rate"))


@query(
    "rolling_abandonment",
    """with v as (select e.event_id, e.ts, exists (select 1 from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts > e.ts and p.ts <= e.ts + interval 1 day) bought from events e where event_type = 'view')
select ts::date as day, count(*) as n, round(count(*) filter (not bought) / count(*), 6) as abandoned from v group by 1""",
)
def rolling_abandonment(spark: SparkSession, sf: str) -> DataFrame:
    """Views that no purchase of the user follows within a day; the next purchase comes from one window per user."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    after = Window.partitionBy("user_id").orderBy(us).rangeBetween(1, 86_400_000_000)
    v = load(spark, sf, "events").where("event_type in ('view', 'purchase')").withColumn("bought", F.count(F.when(F.col("event_type") == "purchase", 1)).over(after) > 0).where("event_type = 'view'")
    return v.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(~F.col("bought")) / F.count(F.lit(1)), 6).alias("abandoned"))


@query(
    "chained_index",
    """with m as (select date_trunc('month', o_orderdate)::date mth, sum(o_totalprice) s, count(*) n from orders group by 1), r as (select mth, ln((s / n) / lag(s / n) over (order by mth)) g from m) select mth as month, round(100 * exp(coalesce(sum(g) over (order by mth), 0)), 4) as index_value from r""",
)
def chained_index(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value chained from month to month, 100 at the start; a row per month of the calendar."""
    m = load(spark, sf, "orders").where("o_orderdate is not null").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("a"))
    w = Window.orderBy("month")
    return m.withColumn("g", F.log(F.col("a") / F.lag("a").over(w))).select("month", F.round(100 * F.exp(F.coalesce(F.sum("g").over(w), F.lit(0.0))), 4).alias("index_value"))


@query("row_groups_pruned", "select count(*) as n from lineitem where l_shipdate >= timestamp '1998-10-01'")
def row_groups_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written in the order of their date, then read where minimum and maximum of a file can hold the dates asked for."""
    p = scratch(spark, "by-date")
    load(spark, sf, "lineitem").repartitionByRange(8, "l_shipdate").sortWithinPartitions("l_shipdate").write.parquet(p)
    lo = F.lit("1998-10-01").cast("timestamp_ntz")
    kept = layout.files_in_range(spark, p, "l_shipdate", "1998-10-01", None)
    return (spark.read.parquet(*kept) if kept else spark.read.parquet(p).limit(0)).where(F.col("l_shipdate") >= lo).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- lookups and joins of unlike sources

_DIRECTORY = [("FUR", "furniture"), ("BUI", "building"), ("B", "other b"), ("AUTO", "cars"), ("MACHINERY", "machines")]


@query(
    "lookup_longest_prefix",
    f"select c_custkey, (select arg_max(v, length(p)) from (values {', '.join(str(x) for x in _DIRECTORY)}) t(p, v) where starts_with(c_mktsegment, p)) as trade from customer",
)
def lookup_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame(_DIRECTORY, "prefix string, trade string")
    return X.longest_prefix(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", d, "prefix", ["trade"]).select("c_custkey", "trade")


@query(
    "star_join_current",
    """with d as (select id, updated_at::date d, arg_max(row(upper(trim(country))), row(updated_at, coalesce(upper(trim(country)), ''))) v from raw_customers where id is not null and updated_at is not null group by 1, 2),
c as (select id, arg_max(v[1], d) filter (v[1] is not null) country from d group by 1)
select country, strftime(ordered_at, '%Y-%m') as month, count(*) as n, cast(sum(amount_cents) as bigint) as cents from raw_orders r join c on c.id = r.customer_id where ordered_at is not null group by 1, 2""",
)
def star_join_current(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by month and by the country of the customer's current version."""
    c = load(spark, sf, "raw_customers").select("id", F.to_date("updated_at").alias("on_date"), F.upper(F.trim("country")).alias("country"), "updated_at")
    now = history.versions(c, "id", "on_date", {"country": F.col("country")}, "updated_at").where("is_current").select(F.col("id").alias("customer_id"), "country")
    r = load(spark, sf, "raw_orders").where("ordered_at is not null").select("customer_id", F.date_format("ordered_at", "yyyy-MM").alias("month"), "amount_cents")
    return r.join(now, "customer_id").groupBy("country", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))


@query("join_unlike_sources", "select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def join_unlike_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from CSV, customers from JSON lines and nations from ORC."""
    o, c, n = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), load(spark, sf, "customer").select("c_custkey", "c_nationkey"), load(spark, sf, "nation")
    p = {k: scratch(spark, k) for k in ("csv", "json", "orc")}
    files.write(o, p["csv"], "csv", header="true", sep=";")
    files.write(c, p["json"], "json")
    files.write(n, p["orc"], "orc")
    a = spark.read.schema(o.schema).option("header", "true").option("sep", ";").csv(p["csv"])
    j = a.join(files.read(spark, p["json"], "json", c.schema), F.col("o_custkey") == F.col("c_custkey")).join(files.read(spark, p["orc"], "orc", n.schema), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stream_sliding_counts", "select make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) as window_start, count(*) as n from events, range(4) r(k) where ts is not null group by 1")
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per day, begun every six hours."""
    e = T.stream_in_parts(spark, sf, "events", "ts").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    c = e.groupBy(F.window("at", "24 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return T.run_complete(c.select(F.col("w.start").alias("window_start"), "n"), "sliding").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _order_features(df: DataFrame) -> DataFrame:
    """The same expressions for a table and for a stream of it."""
    return df.select("o_orderkey", F.round(X.clipped("o_totalprice", 50000, 300000), 2).alias("clipped"), X.ordinal("o_orderstatus", ["O", "P", "F"]).alias("place"))


@query("stream_features_as_batch", "select o_orderkey, round(least(greatest(o_totalprice, 50000), 300000), 2) as clipped, list_position(['O', 'P', 'F'], o_orderstatus) - 1 as place, true as same from orders")
def stream_features_as_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a stream, each held against that of the table."""
    s = T.run_append(_order_features(T.stream_in_parts(spark, sf, "orders", "o_orderkey")), "features")
    b = _order_features(load(spark, sf, "orders")).select("o_orderkey", F.struct("clipped", "place").alias("_b"))
    return s.join(b, "o_orderkey", "left").select("o_orderkey", "clipped", "place", F.struct("clipped", "place").eqNullSafe(F.col("_b")).alias("same"))
