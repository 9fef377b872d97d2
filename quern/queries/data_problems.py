"""Queries of the general data problems (p1, p2, p4 to p7) on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fold_name
from ..operators import changefeed, dedup, drift, history, incremental, late
from ..plans.runtime import materialize, scratch
from ..registry import query
from ..sources.tables import load

# ---------------------------------------------------------------- p1

_P1_ROWS = """
  select 'orders' as source, id as record_id, updated_at, _ingested_at as ingested_at from raw_orders where updated_at is not null
  union all select 'customers', id, updated_at, _ingested_at from raw_customers where updated_at is not null"""

_P1_PENDING = f"""
with rows_ as ({_P1_ROWS}),
w as (select source, last_updated hi, started_at s,
        lag(last_updated) over (partition by source order by started_at, run_id, attempt) lo,
        row_number() over (partition by source order by started_at, run_id, attempt) rn
      from raw_watermarks where run_status = 'success'),
taken as (select distinct r.source, r.record_id, r.updated_at from rows_ r join w on w.source = r.source
  and r.updated_at <= w.hi and r.ingested_at <= w.s and (w.rn = 1 or r.updated_at > w.lo)),
pending as (select distinct source, record_id, updated_at from rows_ r
  where not exists (select 1 from taken t where t.source = r.source and t.record_id = r.record_id and t.updated_at = r.updated_at))
"""


def change_rows(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, table: str) -> DataFrame:
        return load(spark, sf, table).select(F.lit(name).alias("source"), F.col("id").alias("record_id"), "updated_at", F.col("_ingested_at").alias("ingested_at"))

    return of("orders", "raw_orders").unionByName(of("customers", "raw_customers"))


@query("p1_found", _P1_PENDING + "select distinct source, record_id from pending")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pending = incremental.pending_changes(change_rows(spark, sf), load(spark, sf, "raw_watermarks"))
    return pending.where("record_id is not null").select("source", "record_id").distinct()


@query(
    "p1_next_watermarks",
    _P1_PENDING
    + """select s.source, l.old as last_updated, coalesce(p.n, 0) as open_changes, greatest(l.top, p.newest) as new_last_updated
from (values ('orders'), ('customers')) s(source)
left join (select source, arg_max(last_updated, started_at) old, max(last_updated) top from raw_watermarks where run_status = 'success' group by 1) l using (source)
left join (select source, count(*) n, max(updated_at) newest from pending group by 1) p using (source)""",
)
def p1_next_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    runs = load(spark, sf, "raw_watermarks")
    return incremental.next_watermarks(runs, incremental.pending_changes(change_rows(spark, sf), runs), ["orders", "customers"])


@query(
    "p1_refreshed",
    """select cast(updated_at as date) as change_day, count(distinct id) as n_orders, count(*) as n_rows, cast(sum(amount_cents) as bigint) as cents
from raw_orders where updated_at is not null group by 1""",
)
def p1_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """A daily table kept by two refreshes: what was readable at the last success, then everything."""
    src = load(spark, sf, "raw_orders").where("updated_at is not null").withColumn("change_day", F.to_date("updated_at"))
    seen_by = load(spark, sf, "raw_watermarks").where("source = 'orders' and run_status = 'success'").agg(F.max("started_at")).first()[0]

    def daily(df: DataFrame) -> DataFrame:
        return df.groupBy("change_day").agg(F.countDistinct("id").alias("n_orders"), F.count(F.lit(1)).alias("n_rows"), F.sum("amount_cents").cast("bigint").alias("cents"))

    t = incremental.IncrementalTable(spark, scratch(spark, "p1"), ["change_day"])
    t.refresh(src.where(F.col("_ingested_at") <= F.lit(seen_by)) if seen_by else src, daily)
    t.refresh(src, daily)
    return t.read().select("change_day", "n_orders", "n_rows", "cents")


# ---------------------------------------------------------------- p2

_KEY = """case when regexp_matches(regexp_replace(regexp_replace(lower({0}), '^\\s*urn:uuid:', ''), '[{{}}()\\-\\s]', '', 'g'), '^[0-9a-f]{{32}}$')
  then regexp_replace(regexp_replace(lower({0}), '^\\s*urn:uuid:', ''), '[{{}}()\\-\\s]', '', 'g') else '=' || {0} end""".format("idempotency_key")


@query(
    "p2_found",
    f"""select table_name, row_id from (
select 'outbox' as table_name, id as row_id, row_number() over (partition by {_KEY} order by id) r, idempotency_key is null as alone from outbox
union all select 'idempotency_log', id, row_number() over (partition by {_KEY}, consumer order by id), idempotency_key is null or consumer is null from idempotency_log
union all select 'sample_events', landing_id, row_number() over (partition by topic, partition_id, kafka_offset order by landing_id),
  topic is null or partition_id is null or kafka_offset is null from sample_events) where r > 1 and not alone""",
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    key = dedup.uuid_key(F.col("idempotency_key")).alias("key")
    parts = [
        ("outbox", load(spark, sf, "outbox").select(F.col("id").alias("row_id"), key), ["key"]),
        ("idempotency_log", load(spark, sf, "idempotency_log").select(F.col("id").alias("row_id"), key, "consumer"), ["key", "consumer"]),
        ("sample_events", load(spark, sf, "sample_events").select(F.col("landing_id").alias("row_id"), "topic", "partition_id", "kafka_offset"), ["topic", "partition_id", "kafka_offset"]),
    ]
    out = None
    for name, df, keys in parts:
        d = dedup.duplicates(df, keys, "row_id").select(F.lit(name).alias("table_name"), "row_id")
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "p2_kept_outbox",
    f"""select id, idempotency_key, event_type, published_at from
(select *, row_number() over (partition by {_KEY} order by id) r from outbox) where r = 1 or idempotency_key is null""",
)
def p2_kept_outbox(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "outbox").withColumn("key", dedup.uuid_key(F.col("idempotency_key")))
    return dedup.deduplicate(o, ["key"], "id").select("id", "idempotency_key", "event_type", "published_at")


# ---------------------------------------------------------------- p4

_P4_ROWS = """
with rows_ as (
  select 'sample_events' as table_name, topic, partition_id, kafka_offset, landing_id as row_id, event_timestamp as event_time, received_at as arrival, payload from sample_events
  union all select 'cdc_audit_log', topic, partition_id, kafka_offset, seq, event_ts, applied_at, payload from cdc_audit_log),
first_ as (select * from rows_ qualify row_number() over (partition by table_name, topic, partition_id, kafka_offset,
  case when topic is null or partition_id is null or kafka_offset is null then row_id end order by row_id) = 1),
placed as (select f.*, epoch_us(arrival) a, epoch_us(event_time) - ((epoch_us(event_time) % (period_minutes::bigint * 60000000)) + period_minutes::bigint * 60000000) % (period_minutes::bigint * 60000000) as period_start,
  period_minutes::bigint * 60000000 p, cutoff_minutes::bigint * 60000000 c from first_ f join lateness_limits using (table_name, topic) where event_time is not null and arrival is not null),
judged as (select *, case when a < period_start + p then 'on_time' when a <= period_start + p + c then 'correction' else 'too_late' end as verdict from placed)
"""


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both event tables in one shape; ``amount`` is the payload's measure, null if it has none."""
    amount = F.round(F.try_to_number(F.regexp_extract("payload", r'"amount"\s*:\s*(-?[0-9]+)', 1), F.lit("S999999999999999999"))).cast("bigint").alias("amount")
    s = load(spark, sf, "sample_events").select(F.lit("sample_events").alias("table_name"), "topic", "partition_id", "kafka_offset", F.col("landing_id").alias("row_id"), F.col("event_timestamp").alias("event_time"), F.col("received_at").alias("arrival"), amount)
    c = load(spark, sf, "cdc_audit_log").select(F.lit("cdc_audit_log").alias("table_name"), "topic", "partition_id", "kafka_offset", F.col("seq").alias("row_id"), F.col("event_ts").alias("event_time"), F.col("applied_at").alias("arrival"), amount)
    return s.unionByName(c)


def restated(spark: SparkSession, sf: str) -> late.RestatedPeriods:
    """Both event tables taken in as two batches: the first nine tenths of the arrivals by time, then the rest."""
    rows = event_rows(spark, sf)
    lo, hi = rows.agg(F.min("arrival"), F.max("arrival")).first()
    t = late.RestatedPeriods(spark, scratch(spark, "p4"), load(spark, sf, "lateness_limits"))
    cut = F.lit(lo + (hi - lo) * 0.9 if lo else None).cast("timestamp_ntz")
    later = F.coalesce(F.col("arrival") > cut, F.lit(False))
    t.apply(rows.where(~later), "amount")
    t.apply(rows.where(later), "amount")
    return t


@query("p4_found", _P4_ROWS + "select table_name, row_id, verdict from judged where verdict <> 'on_time'")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The verdicts as the restated partitions have them."""
    return restated(spark, sf).retained().where("verdict <> 'on_time'").select("table_name", "row_id", "verdict")


@query(
    "p4_periods",
    _P4_ROWS
    + r"""select table_name, topic, period_start, count(*) as n_rows, count(*) filter (verdict = 'on_time') as n_first, count(*) filter (verdict = 'correction') as n_corrections,
cast(sum(try_cast(nullif(regexp_extract(payload, '"amount"\s*:\s*(-?[0-9]+)', 1), '') as bigint)) as bigint) as total
from judged where verdict <> 'too_late' group by 1, 2, 3""",
)
def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    return restated(spark, sf).read().select("table_name", "topic", "period_start", "n_rows", "n_first", "n_corrections", "total")


# ---------------------------------------------------------------- p5


_P5 = r"""with e as (select subject, file_no, coalesce(event_id, -1) ev, payload::json p from schema_events where subject is not null and file_no is not null and payload is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
f as (select subject, file_no, ev, json_extract(p, '$.id')::varchar id, replace(substr(t.fullkey, 3), '"', '') path,
  case when t.type in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' when t.type = 'DOUBLE' then 'fraction' when t.type = 'VARCHAR' then 'string' when t.type = 'BOOLEAN' then 'boolean' when t.type = 'ARRAY' then 'array' when t.type = 'NULL' then 'null' else 'object' end jt, t.value::varchar v
  from e, json_tree(p) t where t.fullkey <> '$' and not regexp_matches(t.fullkey, '\[[0-9]+\]') and (t.type <> 'OBJECT' or t.value::varchar = '{}')),
bt as (select subject, file_no, path, jt, count(*) n from f group by all),
pr as (select subject, file_no, path, arg_max(jt, row(n, -ascii(jt))) filter (jt <> 'null') jt from bt group by 1, 2, 3),
fi as (select distinct subject, file_no from pr), st as (select a.subject, a.file_no from fi a join fi b on a.subject = b.subject and b.file_no = a.file_no - 1),
pv as (select subject, file_no + 1 as file_no, path, jt from pr),
j as (select coalesce(n.subject, o.subject) subject, coalesce(n.file_no, o.file_no) file_no, coalesce(n.path, o.path) path, n.path is not null has_n, o.path is not null has_o, n.jt nt, o.jt ot from pr n full join pv o on n.subject = o.subject and n.file_no = o.file_no and n.path = o.path),
s as (select j.* from j join st using (subject, file_no)),
l as (select subject, file_no, id, path, arg_max(v, row(ev, v)) v from f where jt <> 'null' group by 1, 2, 3, 4),
g as (select s.subject, s.file_no, l.id, s.path, l.v from s join l on l.subject = s.subject and l.file_no = s.file_no - 1 and l.path = s.path where not has_n),
k as (select s.subject, s.file_no, l.id, s.path, l.v from s join l on l.subject = s.subject and l.file_no = s.file_no and l.path = s.path where not has_o),
a as (select g.subject, g.file_no, g.path o, k.path n, count(*) filter (g.v = k.v) / count(*) r from g join k using (subject, file_no, id) group by 1, 2, 3, 4 having count(*) filter (g.v = k.v) > 0),
q as (select *, row_number() over (partition by subject, file_no, o order by r desc, n) ro, row_number() over (partition by subject, file_no, n order by r desc, o) rn from a),
r as (select subject, file_no, o, n from q where ro = 1 and rn = 1 and r >= 0.5)
select subject, file_no, 'renamed' as change_kind, o as old_field, n as new_field from r
union all select subject, file_no, 'removed', path, '' from s where not has_n and (subject, file_no, path) not in (select subject, file_no, o from r)
union all select subject, file_no, 'added', '', path from s where not has_o and (subject, file_no, path) not in (select subject, file_no, n from r)
union all select subject, file_no, 'retyped', path, path from s where has_n and has_o and nt <> ot"""


@query("p5_found", _P5)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """A rename is defined by the values of common ids here, so files without any have none."""
    return drift.changes(materialize(drift.flattened(load(spark, sf, "schema_events")), "fields"), without_ids=False)


@query("p5_unified")
def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All payloads as one table with a column name that outlives renames."""
    f = materialize(drift.flattened(load(spark, sf, "schema_events")), "fields")
    return drift.unified(f, drift.changes(f, without_ids=False))


def user_fields(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(drift.table_fields(load(spark, sf, "dim_users"), "dim_users", "_schema_version", "_cdc_lsn", "id"), "fields")


@query("p5_users_changes")
def p5_users_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of dim_users against the version before, as p5_found has them, and columns whose values are recoded or reformatted."""
    return drift.table_changes(user_fields(spark, sf))


@query(
    "p5_users",
    r"""with v as (select id, _cdc_lsn l, _schema_version sv, tier from dim_users where id is not null and _cdc_lsn is not null and tier is not null),
a as (select id, arg_max(tier, l) o from v where sv = 2 group by 1), b as (select id, arg_min(tier, l) n from v where sv = 3 group by 1), m as (select o, arg_max(n, row(c, n)) n from (select o, n, count(*) c from a join b using (id) group by 1, 2) group by 1)
select id, email, username, coalesce(account_status, status) as status, case when coalesce(_schema_version < 3, m.n is not null and tier not in (select n from m), false) then m.n else tier end as tier,
regexp_replace(phone, '[^\p{L}\p{N}]+', '', 'g') as phone, created_at, updated_at, _cdc_op, _cdc_lsn, _dw_loaded_at from dim_users left join m on tier = o""",
)
def p5_users(spark: SparkSession, sf: str) -> DataFrame:
    """dim_users in one shape by the changes found in it; their list is bounded by the schema."""
    found = drift.table_changes(user_fields(spark, sf)).collect()
    u = drift.unified_table(load(spark, sf, "dim_users"), found, "_schema_version", "_cdc_lsn", "id")
    kept = [c for c in u.columns if not c.startswith("_")]
    order = ["id", "email", "username", "status", "tier", "phone", "created_at", "updated_at"]
    return u.select(*[c for c in order if c in kept], *[c for c in kept if c not in order], "_cdc_op", "_cdc_lsn", "_dw_loaded_at")


# ---------------------------------------------------------------- p6

_FOLD = "regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[\\s\\x{{00a0}}]+', '', 'g')"
_P6 = f"""
with obs as (
  select customer_id, cast(effective_date as date) d, city, segment, null::timestamp l from dim_customers
  union all select customer_id, cast(snapshot_date as date), city, segment, loaded_at from customer_snapshots),
daily as (select customer_id, d, arg_max(row(city, segment), row(coalesce(l, timestamp '0001-01-01'), coalesce(city, ''), coalesce(segment, ''))) v
  from obs where customer_id is not null and d is not null group by 1, 2),
filled as (select customer_id, d, last_value(v[1] ignore nulls) over w city, last_value(v[2] ignore nulls) over w segment
  from daily window w as (partition by customer_id order by d rows unbounded preceding)),
marked as (select *, row({_FOLD.format('city')}, segment) k, lag(row({_FOLD.format('city')}, segment)) over (partition by customer_id order by d) pk from filled),
starts as (select customer_id, d, city, segment, lead(d) over (partition by customer_id order by d) nxt from marked where pk is null or pk is distinct from k)
"""


def customer_versions(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "dim_customers").select("customer_id", F.col("effective_date").cast("date").alias("on_date"), "city", "segment", F.lit(None).cast("timestamp_ntz").alias("loaded_at"))
    s = load(spark, sf, "customer_snapshots").select("customer_id", F.col("snapshot_date").cast("date").alias("on_date"), "city", "segment", "loaded_at")
    return history.versions(d.unionByName(s), "customer_id", "on_date", {"city": fold_name(F.col("city")), "segment": F.col("segment")}, "loaded_at")


@query("p6_found", _P6 + "select customer_id, strftime(d, '%Y-%m-%d') as effective_date, coalesce(strftime(nxt - interval 1 day, '%Y-%m-%d'), '') as end_date from starts")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    v = customer_versions(spark, sf)
    return v.select("customer_id", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"), F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("")).alias("end_date"))


@query(
    "p6_history",
    _P6 + "select customer_id, segment, d as effective_date, cast(nxt - interval 1 day as date) as end_date, nxt is null as is_current, " + _FOLD.format("city") + " as city_key from starts",
)
def p6_history(spark: SparkSession, sf: str) -> DataFrame:
    return customer_versions(spark, sf).withColumn("city_key", fold_name(F.col("city"))).drop("city")


# ---------------------------------------------------------------- p7

_P7 = """
with f as (select 'dim_users' as table_name, id, lower(_cdc_op) op, _cdc_lsn lsn from dim_users
  union all select 'fact_orders', id, lower(_cdc_op), _cdc_lsn from fact_orders),
s as (select table_name, id, max(lsn) filter (coalesce(op, 'u') <> 'd') live, max(lsn) filter (op = 'd') dead from f where lsn is not null and id is not null group by 1, 2)
select table_name, id as record_id, live as last_lsn from s where live is not null and (dead is null or live > dead)"""


@query("p7_found", _P7)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    def feed(t: str) -> DataFrame:
        return load(spark, sf, t).select(F.lit(t).alias("table_name"), "id", "_cdc_op", F.col("_cdc_lsn").cast("bigint").alias("_cdc_lsn"))

    parts = [changefeed.rebuilt(feed(t), ["table_name", "id"], "_cdc_op", "_cdc_lsn", []) for t in ("dim_users", "fact_orders")]
    return parts[0].unionByName(parts[1]).select("table_name", F.col("id").alias("record_id"), F.col("last_pos").alias("last_lsn"))


def _state_sql(table: str, columns: list[str]) -> str:
    val = ", ".join(f"arg_max({c}, row(lsn, {c})) filter ({c} is not null and op <> 'd' and (reset is null or lsn >= reset)) as {c}" for c in columns)
    return f"""with f as (select *, coalesce(lower(_cdc_op), 'u') op, cast(_cdc_lsn as bigint) lsn from {table} where id is not null and _cdc_lsn is not null),
s as (select id, max(lsn) filter (op <> 'd') live, max(lsn) filter (op = 'd') dead, max(lsn) filter (op in ('c', 'r', 'd')) reset from f group by 1)
select f.id, {val}, any_value(live) as last_lsn from f join s on f.id = s.id where live is not null and (dead is null or live > dead) group by f.id"""


_USER_COLUMNS = ["email", "username", "status", "account_status", "tier", "phone"]
_ORDER_COLUMNS = ["user_id", "status", "total_amount", "currency"]


@query("p7_users_state", _state_sql("dim_users", _USER_COLUMNS))
def p7_users_state(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.rebuilt(load(spark, sf, "dim_users"), ["id"], "_cdc_op", "_cdc_lsn", _USER_COLUMNS).withColumnRenamed("last_pos", "last_lsn")


@query("p7_orders_state", _state_sql("fact_orders", _ORDER_COLUMNS))
def p7_orders_state(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.rebuilt(load(spark, sf, "fact_orders"), ["id"], "_cdc_op", "_cdc_lsn", _ORDER_COLUMNS).withColumnRenamed("last_pos", "last_lsn")
