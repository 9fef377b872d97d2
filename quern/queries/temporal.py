"""Queries over event time on the events table and friends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import temporal
from ..registry import query
from ..sources.tables import load


def _kind(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return load(spark, sf, "events").where(F.col("event_type").isin(*kinds))


@query(
    "asof_last_view",
    """select p.event_id, v.event_id as view_id, v.value as view_value from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts""",
)
def asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    j = temporal.asof_join(_kind(spark, sf, "purchase"), _kind(spark, sf, "view"), ["user_id"], "ts", "ts", ["event_id", "value"], arrival="event_id")
    return j.select("event_id", F.col("r_event_id").alias("view_id"), F.col("r_value").alias("view_value"))


@query(
    "asof_lookback",
    """select p.event_id, case when v.ts >= p.ts - interval 2 hour then v.event_id end as view_id from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts""",
)
def asof_lookback(spark: SparkSession, sf: str) -> DataFrame:
    j = temporal.asof_join(_kind(spark, sf, "purchase"), _kind(spark, sf, "view"), ["user_id"], "ts", "ts", ["event_id"], lookback=F.expr("interval 2 hours"), arrival="event_id")
    return j.select("event_id", F.col("r_event_id").alias("view_id"))


_ASOF = "(select p.event_id, v.event_id as m from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view'{0}) v on p.user_id = v.user_id and p.ts >= v.ts)"


@query(
    "asof_late_corrections",
    f"""with a as {_ASOF.format(' and event_id % 5 <> 0')}, b as {_ASOF.format('')}, d as (select a.event_id, a.m old, b.m new from a join b using (event_id) where a.m is distinct from b.m)
select event_id, -1 as _diff, old as match from d union all select event_id, 1, new from d""",
)
def asof_late_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Views whose number divides by five stand for late rows; the pairs retract and emit."""
    v = _kind(spark, sf, "view").select("user_id", "ts", F.col("event_id").alias("view_id"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("late"))
    c = temporal.asof_corrections(_kind(spark, sf, "purchase").select("event_id", "user_id", "ts"), v, ["user_id"], "ts", "ts", "view_id", "late", F.lit(0))
    return c.select("event_id", "_diff", "match")


@query(
    "point_in_time_features",
    """select l.event_id, f.value as last_signup_value, (select count(*) from events c where c.user_id = l.user_id and c.event_type = 'click' and c.ts <= l.ts) as clicks_before from (select * from events where event_type = 'purchase') l
asof left join (select * from events where event_type = 'signup') f on l.user_id = f.user_id and l.ts >= f.ts""",
)
def point_in_time_features(spark: SparkSession, sf: str) -> DataFrame:
    e = _kind(spark, sf, "purchase", "click")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    labels = e.withColumn("clicks_before", F.count_if(F.col("event_type") == "click").over(w)).where("event_type = 'purchase'")
    j = temporal.asof_join(labels, _kind(spark, sf, "signup"), ["user_id"], "ts", "ts", ["value"], arrival="event_id")
    return j.select("event_id", F.col("r_value").alias("last_signup_value"), "clicks_before")


@query(
    "attribution_last_touch",
    """with c as (select * from events where event_type = 'purchase'), k as (select c.event_id, max(row(t.ts, t.event_id)) m from c join events t on t.event_type = 'click' and t.user_id = c.user_id and t.ts <= c.ts and t.ts >= c.ts - interval 7 day group by 1),
v as (select c.event_id, max(row(t.ts, t.event_id)) m from c join events t on t.event_type = 'view' and t.user_id = c.user_id and t.ts <= c.ts and t.ts >= c.ts - interval 24 hour group by 1)
select c.event_id, case when k.m is not null then 'click' when v.m is not null then 'view' else 'organic' end as channel, coalesce(k.m[2], v.m[2]) as touch_id from c left join k using (event_id) left join v using (event_id)""",
)
def attribution_last_touch(spark: SparkSession, sf: str) -> DataFrame:
    a = temporal.attribution(_kind(spark, sf, "purchase"), _kind(spark, sf, "click", "view"), "user_id", "ts", "ts", "event_type", "event_id", {"click": 7 * 86400, "view": 86400})
    return a.select("event_id", "channel", "touch_id")


@query(
    "interval_join",
    """select e.event_id as error_id, c.event_id as click_id from events e join events c on e.user_id = c.user_id and e.event_type = 'error' and c.event_type = 'click' and c.ts > e.ts and c.ts <= e.ts + interval 10 minute""",
)
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs within ten minutes, by an equality join on user and ten-minute bucket, not a range join."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    width = 600_000_000
    e = _kind(spark, sf, "error").select(F.col("event_id").alias("error_id"), "user_id", us.alias("e"), F.explode(F.array(F.floor(us / width), F.floor(us / width) + 1)).alias("b"))
    c = _kind(spark, sf, "click").select(F.col("event_id").alias("click_id"), "user_id", us.alias("c"), F.floor(us / width).alias("b"))
    return e.join(c, ["user_id", "b"]).where((F.col("c") > F.col("e")) & (F.col("c") <= F.col("e") + width)).select("error_id", "click_id")


_SESSION = """with m as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute {0} then 1 else 0 end s from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) k from m)
select user_id, cast(k as bigint) as session_no, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from n group by 1, 2"""


def _session_table(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "session_no").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("sessions_by_gap", _SESSION.format(""))
def sessions_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(temporal.sessions(load(spark, sf, "events"), "user_id", "ts", 1800, "event_id"))


@query("sessions_with_closing_event", _SESSION.format("or lag(event_type) over w = 'purchase'"))
def sessions_with_closing_event(spark: SparkSession, sf: str) -> DataFrame:
    return _session_table(temporal.sessions(load(spark, sf, "events"), "user_id", "ts", 1800, "event_id", F.col("event_type") == "purchase"))


@query("sessions_native", _SESSION.format("").replace("select user_id, cast(k as bigint) as session_no,", "select user_id,").replace("group by 1, 2", "group by user_id, k"))
def sessions_native(spark: SparkSession, sf: str) -> DataFrame:
    """The same sessions by the built-in session window: an idle time equal to the gap merges in both."""
    e = load(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


@query("tumbling_counts", "select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 2) as total, round(avg(value), 6) as mean from events group by 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.groupBy(temporal.period_start("ts", 3600).alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "sliding_counts",
    """select make_timestamp((epoch_us(ts) // 900000000 - k) * 900000000) as window_start, count(*) as n from events, range(4) r(k) group by 1""",
)
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.sliding_counts(load(spark, sf, "events"), "ts", 3600, 900)


_BARS = "select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as bar_start, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*) as n_trades from events group by 1, 2"


def _daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.bars(load(spark, sf, "events"), ["event_type"], "ts", "value", F.lit(1), 86400, "event_id")


@query("ohlc_bars", _BARS)
def ohlc_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_bars(spark, sf).drop("volume")


@query(
    "moving_band",
    f"""select event_type, bar_start, case when r >= 5 then round(m, 8) end as sma, case when r >= 5 then round(m + 2 * s, 6) end as upper, case when r >= 5 then round(m - 2 * s, 6) end as lower from (
select *, row_number() over w r, avg(close) over (partition by event_type order by bar_start rows 4 preceding) m, stddev_pop(close) over (partition by event_type order by bar_start rows 4 preceding) s from ({_BARS}) window w as (partition by event_type order by bar_start))""",
)
def moving_band(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("bar_start")
    f = w.rowsBetween(-4, 0)
    b = _daily_bars(spark, sf).select("event_type", "bar_start", F.row_number().over(w).alias("r"), F.avg("close").over(f).alias("m"), F.stddev_pop("close").over(f).alias("s"))
    ok = F.col("r") >= 5
    return b.select("event_type", "bar_start", F.when(ok, F.round("m", 8)).alias("sma"), F.when(ok, F.round(F.col("m") + 2 * F.col("s"), 6)).alias("upper"), F.when(ok, F.round(F.col("m") - 2 * F.col("s"), 6)).alias("lower"))


@query(
    "exponential_mean",
    f"""with recursive b as (select event_type, bar_start, close, row_number() over (partition by event_type order by bar_start) r from ({_BARS})),
e as (select event_type, 10 as r, avg(close) as ema from b where r <= 10 group by 1 having count(*) = 10 union all select b.event_type, b.r, 2.0 / 11 * b.close + (1 - 2.0 / 11) * e.ema from e join b on b.event_type = e.event_type and b.r = e.r + 1)
select event_type, bar_start, round(ema, 6) as ema from e join b using (event_type, r)""",
)
def exponential_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = temporal.exponential_mean(_daily_bars(spark, sf), ["event_type"], ["bar_start"], "close", 10)
    return e.withColumn("ema", F.round("ema", 6))


@query(
    "volume_spikes",
    """with h as (select event_type, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') h, count(*) n from events group by 1, 2)
select event_type, h as bar_start, n from (select *, sum(n) over w s, count(*) over w c from h window w as (partition by event_type order by h rows between 5 preceding and 1 preceding)) where c = 5 and n >= 5 * (s // 5) and s >= 5""",
)
def volume_spikes(spark: SparkSession, sf: str) -> DataFrame:
    h = load(spark, sf, "events").groupBy("event_type", temporal.period_start("ts", 3600).alias("bar_start")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("bar_start").rowsBetween(-5, -1)
    return h.withColumn("s", F.sum("n").over(w)).withColumn("c", F.count(F.lit(1)).over(w)).where("c = 5 and s >= 5 and n >= 5 * (s div 5)").select("event_type", "bar_start", "n")


@query(
    "islands_of_errors",
    """select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n_rows from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type in ('error', 'click') order by ts, event_id) g from events) where event_type in ('error', 'click') group by user_id, g having count(*) >= 3""",
)
def islands_of_errors(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.islands(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "click"), 3)


@query(
    "delta_of_readings",
    "select event_id, case when value >= lag(value) over w then round(value - lag(value) over w, 4) else value end as delta from events window w as (partition by user_id order by ts, event_id)",
)
def delta_of_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Difference to the previous reading; a fall is a reset, whose reading counts from zero."""
    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf, "events").select("event_id", F.when(F.col("value") >= prev, F.round(F.col("value") - prev, 4)).otherwise(F.col("value")).alias("delta"))


@query(
    "rolling_distinct",
    """select event_id, (select count(distinct b.event_type) from events b where b.user_id = a.user_id and b.ts between a.ts and a.ts + interval 6 hour) as kinds from events a""",
)
def rolling_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values in a time frame; event kinds are a small domain, so a frame's set is small."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(0, 6 * 3600 * 1_000_000)
    return load(spark, sf, "events").select("event_id", F.size(F.collect_set("event_type").over(w)).cast("bigint").alias("kinds"))


@query(
    "velocity_24h",
    """select event_id, count(*) over w as n_day, round(sum(value) over w, 2) as v_day from events window w as (partition by user_id order by ts range between interval 24 hour preceding and current row)""",
)
def velocity_24h(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-86_400_000_000, 0)
    return load(spark, sf, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n_day"), F.round(F.sum("value").over(w), 2).alias("v_day"))


@query(
    "cohort_retention",
    """with f as (select user_id, min(ts) t from events group by 1), a as (select f.user_id, date_trunc('month', t)::date c, floor(epoch_us(e.ts - t) / 86400000000.0) d from f join events e using (user_id))
select c as cohort, count(distinct user_id) as users, count(distinct user_id) filter (d = 1) as d1, count(distinct user_id) filter (d = 7) as d7, count(distinct user_id) filter (d = 30) as d30 from a group by 1""",
)
def cohort_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Active in [first + k days, first + k + 1 days); one flag row per user, then counts without distinct."""
    e = load(spark, sf, "events")
    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = e.select("user_id", F.min("ts").over(w).alias("t"), F.floor((us - F.min(us).over(w)) / 86_400_000_000).alias("d"))
    u = d.groupBy("user_id").agg(F.trunc(F.min("t"), "month").alias("cohort"), *[F.max(F.col("d") == k).alias(f"d{k}") for k in (1, 7, 30)])
    return u.groupBy("cohort").agg(F.count(F.lit(1)).alias("users"), *[F.count_if(F.col(f"d{k}")).alias(f"d{k}") for k in (1, 7, 30)])


@query(
    "funnel_steps",
    """with u as (select user_id, min(ts) filter (event_type = 'view') v from events group by 1), c as (select u.user_id, v, min(e.ts) c from u join events e on e.user_id = u.user_id and e.event_type = 'click' and e.ts > v group by 1, 2),
p as (select c.user_id, min(e.ts) p from c join events e on e.user_id = c.user_id and e.event_type = 'purchase' and e.ts > c.c group by 1)
select (select count(v) from u) as viewed, (select count(*) from c) as clicked, (select count(*) from p) as bought""",
)
def funnel_steps(spark: SparkSession, sf: str) -> DataFrame:
    """First view, first click after it, first purchase after that: running minima in one window per user."""
    w = Window.partitionBy("user_id").orderBy("ts")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, sf, "events").withColumn("us", us)
    e = e.withColumn("v", F.min(F.when(F.col("event_type") == "view", F.col("us"))).over(upto))
    e = e.withColumn("c", F.min(F.when((F.col("event_type") == "click") & (F.col("us") > F.col("v")), F.col("us"))).over(upto))
    u = e.groupBy("user_id").agg(F.max(F.col("v").isNotNull()).alias("v"), F.max(F.col("c").isNotNull()).alias("c"), F.max((F.col("event_type") == "purchase") & F.coalesce(F.col("us") > F.col("c"), F.lit(False))).alias("p"))
    return u.agg(F.count_if("v").alias("viewed"), F.count_if("c").alias("clicked"), F.count_if("p").alias("bought"))


@query(
    "recency_quintiles",
    """with o as (select c_custkey, count(o_orderkey) f, coalesce(sum(o_totalprice), 0) m from customer left join orders on o_custkey = c_custkey group by 1), s as (select *, cume_dist() over (order by f) pf, cume_dist() over (order by round(m, 2)) pm from o)
select c_custkey, case when f = 0 then 1 when pf > .8 then 5 when pf > .6 then 4 when pf > .4 then 3 when pf > .2 then 2 else 1 end as f_score, case when f = 0 then 1 when pm > .8 then 5 when pm > .6 then 4 when pm > .4 then 3 when pm > .2 then 2 else 1 end as m_score from s""",
)
def recency_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from the share of customers at or below a value; the global ranks by range sort over distinct values."""
    from ..plans.ordering import range_sorted, with_running

    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("f"), F.round(F.sum("o_totalprice"), 2).alias("m"))
    c = load(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("m", F.lit(0.0)).alias("m"))
    n = c.count()
    for k in ("f", "m"):
        d = with_running(range_sorted(c.groupBy(k).agg(F.count(F.lit(1)).alias("_n")), [F.col(k)]), {"_le": "_n"})
        pct = F.col("_le") / F.lit(n)
        score = F.when(pct > 0.8, 5).when(pct > 0.6, 4).when(pct > 0.4, 3).when(pct > 0.2, 2).otherwise(1)
        c = c.join(d.select(k, score.alias(f"{k}_score")), k)
    return c.select("c_custkey", *[F.when(F.col("f") == 0, 1).otherwise(F.col(f"{k}_score")).alias(f"{k}_score") for k in ("f", "m")])


@query(
    "transition_matrix",
    "select prev, event_type as next, count(*) as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) prev from events) where prev is not null group by 1, 2",
)
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf, "events").select(prev.alias("prev"), F.col("event_type").alias("next")).where("prev is not null").groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_stitching",
    """select user_id, min(ts) as born, arg_max(event_type, row(ts, event_id)) as state, count(*) as n, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1""",
)
def event_stitching(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "events").groupBy("user_id")
    return g.agg(F.min("ts").alias("born"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query(
    "causal_impact",
    """with d as (select ts::date as day, date_diff('day', date '2024-01-01', ts::date) as x, sum(value) as y from events group by 1, 2), s as (select regr_slope(y, x) b, regr_intercept(y, x) a from d where x < 15)
select day, round(y - (a + b * x), 4) as effect from d, s where x >= 15""",
)
def causal_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation of later days from the trend of the first fifteen; the trend is one row."""
    x = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    d = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), x.alias("x")).agg(F.sum("value").alias("y"))
    s = d.where("x < 15").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return d.where("x >= 15").join(F.broadcast(s), F.lit(True)).select("day", F.round(F.col("y") - (F.col("a") + F.col("b") * F.col("x")), 4).alias("effect"))
