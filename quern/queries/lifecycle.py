"""Queries on table versions, change logs, delta relations and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import delta, quality as Q, versions as V
from ..plans.runtime import scratch
from ..registry import query
from ..sources.tables import load

_OP = "case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return load(spark, sf, "events").select("user_id", "ts", "event_id", op.alias("op"), "value")


@query("scd1_current", f"select user_id, event_id, value from (select *, {_OP} op, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1 and op <> 'DELETE'")
def scd1_current(spark: SparkSession, sf: str) -> DataFrame:
    return V.scd1(_changes(spark, sf), ["user_id"], ["ts", "event_id"], "op").select("user_id", "event_id", "value")


_SCD2 = f"select *, coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '9999-12-31') valid_to, {_OP} op from events"


@query("scd2_intervals", f"select user_id, value, ts as valid_from, valid_to, valid_to = timestamp '9999-12-31' as is_current from ({_SCD2}) where op <> 'DELETE'")
def scd2_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return V.scd2(_changes(spark, sf), ["user_id"], "ts", ["event_id"], "op", ["value"])


@query("scd3_previous", "select user_id, value as current, prev as previous from (select *, lag(value) over (partition by user_id order by ts, event_id) prev, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def scd3_previous(spark: SparkSession, sf: str) -> DataFrame:
    return V.scd3(_changes(spark, sf), ["user_id"], ["ts", "event_id"], "value")


@query("scd6_current_value", f"select user_id, value, ts as valid_from, last_value(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as current_value from ({_SCD2}) where op <> 'DELETE'")
def scd6_current_value(spark: SparkSession, sf: str) -> DataFrame:
    return V.scd6(_changes(spark, sf), ["user_id"], "ts", ["event_id"], "op", "value").select("user_id", "value", "valid_from", "current_value")


@query(
    "log_compaction",
    "select table_name, record_id, op, seq from (select *, lower(op) o, row_number() over (partition by table_name, record_id order by lsn desc, seq desc) r, bool_or(lower(op) <> 'd') over (partition by table_name, record_id) seen from cdc_audit_log where lsn is not null and record_id is not null) where r = 1 and (seen or o <> 'd')",
)
def log_compaction(spark: SparkSession, sf: str) -> DataFrame:
    log = load(spark, sf, "cdc_audit_log").where("lsn is not null and record_id is not null").select("table_name", "record_id", "lsn", "seq", "op", F.lower("op").alias("o"))
    return V.compact_log(log, ["table_name", "record_id"], ["lsn", "seq"], "o").select("table_name", "record_id", "op", "seq")


@query(
    "log_lineage",
    "select table_name, record_id, count(*) as n, count(*) filter (lower(op) = 'u') as updates, min(seq) as first_seq, max(seq) as last_seq from cdc_audit_log group by 1, 2",
)
def log_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "cdc_audit_log").groupBy("table_name", "record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("op") == "u").alias("updates"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "snapshot_diff",
    """with a as (select customer_id, arg_max(city, row(loaded_at, city)) city, arg_max(segment, row(loaded_at, segment)) segment from customer_snapshots where snapshot_date = (select min(snapshot_date) from customer_snapshots) group by 1),
b as (select customer_id, arg_max(city, row(loaded_at, city)) city, arg_max(segment, row(loaded_at, segment)) segment from customer_snapshots where snapshot_date = (select max(snapshot_date) from customer_snapshots) group by 1)
select coalesce(a.customer_id, b.customer_id) as customer_id, case when a.customer_id is null then 'INSERT' when b.customer_id is null then 'DELETE' else 'UPDATE' end as op from a full join b using (customer_id)
where a.customer_id is null or b.customer_id is null or a.city is distinct from b.city or a.segment is distinct from b.segment""",
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "customer_snapshots")
    ends = s.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))

    def of(end: str) -> DataFrame:
        x = s.join(F.broadcast(ends.select(F.col(end).alias("snapshot_date"))), "snapshot_date")
        pick = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("loaded_at", c))).alias(c) for c in ("city", "segment")]
        return x.groupBy("customer_id").agg(*pick)

    return V.snapshot_diff(of("lo"), of("hi"), ["customer_id"], ["city", "segment"]).select("customer_id", "op")


@query(
    "merge_copy_on_write",
    "select o_orderkey, case when o_orderstatus = 'P' and o_orderdate >= timestamp '2000-01-01' then 'F' else o_orderstatus end as o_orderstatus from orders where not (o_orderstatus = 'F' and o_orderdate >= timestamp '2000-01-01')",
)
def merge_copy_on_write(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    late = o.where((F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & F.col("o_orderstatus").isin("P", "F"))
    feed = late.select("o_orderkey", F.lit("F").alias("o_orderstatus"), (F.col("o_orderstatus") == "F").alias("gone"))
    return V.merge_upsert(o.drop("o_orderdate"), feed, ["o_orderkey"], F.col("gone"))


@query(
    "merge_on_read",
    """with l as (select id, status, epoch_us(updated_at) v, coalesce(status = 'cancelled', false) gone from raw_orders where updated_at is not null and updated_at >= timestamp '2025-06-15'
union all select id, status, -1, false from (select id, arg_max(status, row(updated_at, status)) filter (status is not null) status from raw_orders where updated_at < timestamp '2025-06-15' group by 1)),
r as (select *, row_number() over (partition by id order by v desc, gone desc, coalesce(status, '') desc) r from l) select id, status from r where r = 1 and not gone""",
)
def merge_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """A base of what was known by the middle of June, and the later changes as its log."""
    r = load(spark, sf, "raw_orders").where("updated_at is not null")
    cut = F.lit("2025-06-15").cast("timestamp_ntz")
    base = r.where(F.col("updated_at") < cut).groupBy("id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("updated_at", "status"))).alias("status"))
    log = r.where(F.col("updated_at") >= cut).select("id", "status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("v"), (F.col("status") == "cancelled").alias("gone"))
    return V.merge_on_read(base, log, ["id"], "v", "gone")


@query(
    "retention_rules",
    "select event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events where ts >= (select max(ts) from events) - interval 20 day) where r <= 5",
)
def retention_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    return V.retained(e, ["user_id"], "ts", "event_id", F.lit(now).cast("timestamp_ntz"), ttl_days=20, most=5).select("event_id")


@query("table_time_travel", "select 1 as version, count(*) as n from orders where o_orderstatus = 'F' union all select 2, count(*) from orders where o_orderstatus in ('F', 'O') union all select 3, count(*) from orders where o_orderstatus in ('F', 'O') and o_orderkey % 2 = 1 union all select 4, count(*) from orders where o_orderstatus in ('F', 'O')")
def table_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    """Append, append, delete and roll back, then count each version."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    t = V.VersionedTable(spark, scratch(spark, "versions"))
    t.append(o.where("o_orderstatus = 'F'"))
    t.append(o.where("o_orderstatus = 'O'"))
    t.delete("o_orderkey % 2 = 0")
    t.rollback(2)
    out = None
    for v in t.versions():
        c = t.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


# ---------------------------------------------------------------- delta relations


@query(
    "delta_join",
    """with b as (select o_orderkey k, o_custkey c from orders), d as (select k, c from b where k % 10 = 0) select c_mktsegment, cast(sum(case when k % 20 = 0 then -1 else 1 end) as bigint) as _diff from d join customer on c = c_custkey group by 1 having sum(case when k % 20 = 0 then -1 else 1 end) <> 0""",
)
def delta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose number divides by ten change: every other one is withdrawn, the rest come in."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = delta.signed(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    base = delta.signed(o.where("o_orderkey % 10 <> 0 or o_orderkey % 20 = 0"))
    d = o.where("o_orderkey % 10 = 0").withColumn("_diff", F.when(F.col("o_orderkey") % 20 == 0, -1).otherwise(1))
    return delta.joined(base, d, c, c.limit(0), ["c_custkey"]).groupBy("c_mktsegment").agg(F.sum("_diff").alias("_diff")).where("_diff <> 0")


@query(
    "delta_aggregate",
    """with b as (select o_custkey c, o_orderkey k from orders where o_orderkey % 7 <> 0), d as (select o_custkey c, o_orderkey k from orders where o_orderkey % 7 = 0), o as (select c, count(*) n, sum(k) t from b where c in (select c from d) group by 1), n as (select c, count(*) n, sum(k) t from (select * from b union all select * from d) where c in (select c from d) group by 1)
select c as o_custkey, n, cast(t as bigint) as total, -1 as _diff from o union all select c, n, cast(t as bigint), 1 from n""",
)
def delta_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    o = delta.signed(load(spark, sf, "orders").select("o_custkey", "o_orderkey"))
    return delta.aggregated(o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 7 = 0"), ["o_custkey"], "o_orderkey")


@query(
    "delta_extremes",
    "select l_suppkey, min(l_linenumber) as lo, max(l_linenumber) as hi, count(distinct l_linenumber) as n_distinct from (select l_suppkey, l_linenumber, sum(case when l_returnflag = 'R' then -1 else 1 end) s from lineitem group by 1, 2) where s > 0 group by 1",
)
def delta_extremes(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("_diff"))
    return delta.extremes(rows, ["l_suppkey"], "l_linenumber")


# ---------------------------------------------------------------- quality

_CHECKS = [
    ("not_null:customer_id", "customer_id is not null and cast(customer_id as varchar) <> ''"),
    ("in_set:status", "status is null or status in ('placed', 'paid', 'shipped', 'delivered', 'cancelled')"),
    ("range:quantity", "quantity is null or quantity between 1 and 3"),
    ("range:amount_cents", "amount_cents is null or amount_cents between 1 and 100000"),
]


def _checks() -> list[Q.Check]:
    return [Q.not_null("customer_id"), Q.in_set("status", ["placed", "paid", "shipped", "delivered", "cancelled"]), Q.in_range("quantity", 1, 3, "warning"), Q.in_range("amount_cents", 1, 100000)]


@query(
    "quality_summary",
    " union all ".join(f"select '{n}' as check_name, '{'warning' if 'quantity' in n else 'error'}' as severity, count(*) as n_rows, count(*) filter (not coalesce({g}, false)) as n_bad from raw_orders" for n, g in _CHECKS),
)
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.summary(load(spark, sf, "raw_orders"), _checks())


@query("quality_quarantine", f"select id, count(*) as n from raw_orders where not (({_CHECKS[0][1]}) and ({_CHECKS[1][1]}) and ({_CHECKS[3][1]})) group by 1")
def quality_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quarantine(load(spark, sf, "raw_orders"), _checks())[1].groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("quality_repeats", "select id from (select id, row_number() over (partition by aggregate_id order by id) r from outbox where aggregate_id is not null and aggregate_id <> '') where r > 1")
def quality_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return Q.repeats(load(spark, sf, "outbox"), "aggregate_id", "id").select("id")


@query("quality_orphans", "select id, count(*) as n from raw_orders where customer_id is not null and customer_id not in (select id from raw_customers) group by 1")
def quality_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return Q.orphans(load(spark, sf, "raw_orders"), "customer_id", load(spark, sf, "raw_customers"), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("profile_numeric", " union all ".join(f"select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as n_null, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, min({c}) as lo, max({c}) as hi from lineitem" for c in _NUM))
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    p = Q.profile(load(spark, sf, "lineitem"), _NUM)
    return p.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(
    "histogram_equi_width",
    "select least(cast(floor((l_extendedprice - lo) / ((hi - lo) / 20)) as bigint), 19) as bin, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem, (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) group by 1",
)
def histogram_equi_width(spark: SparkSession, sf: str) -> DataFrame:
    return Q.equi_width(load(spark, sf, "lineitem"), "l_extendedprice", 20)


@query(
    "histogram_equi_depth",
    "select least((r - 1) // greatest(1, t // 16), 15) as bin, count(*) as n, min(v) as lo, max(v) as hi from (select l_quantity v, row_number() over (order by l_quantity) r, count(*) over () t from lineitem) group by 1",
)
def histogram_equi_depth(spark: SparkSession, sf: str) -> DataFrame:
    return Q.equi_depth(load(spark, sf, "lineitem"), "l_quantity", 16)


@query(
    "histogram_max_diff",
    """with d as (select o_totalprice v, count(*) c from orders group by 1), g as (select v, c, v - lag(v) over (order by v) gap from d), k as (select v from g where gap is not null order by gap desc, v desc limit 7)
select cast(b as bigint) as bin, cast(sum(c) as bigint) as n, min(v) as lo, max(v) as hi from (select d.v, c, sum(case when k.v is not null then 1 else 0 end) over (order by d.v rows unbounded preceding) b from d left join k on d.v = k.v) group by 1""",
)
def histogram_max_diff(spark: SparkSession, sf: str) -> DataFrame:
    return Q.max_diff(load(spark, sf, "orders"), "o_totalprice", 8)


@query(
    "drift_psi_ks",
    """with b as (select l_returnflag = 'R' as f, cast(floor(l_quantity / 5) as bigint) b from lineitem), j as (select b, count(*) filter (not f) a, count(*) filter (f) n from b group by 1), s as (select b, a / sum(a) over () p, n / sum(n) over () q from j)
select round(sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))), 8) as psi, round(max(d), 8) as ks from (select *, abs(sum(p) over (order by b) - sum(q) over (order by b)) d from s)""",
)
def drift_psi_ks(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").withColumn("b", F.floor(F.col("l_quantity") / 5))
    d = Q.drift(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), "b")
    return d.select(F.round("psi", 8).alias("psi"), F.round("ks", 8).alias("ks"))


@query(
    "illegal_transitions",
    "select event_id, previous from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) previous from events) where previous is not null and not ((previous, event_type) in (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('signup', 'view'), ('click', 'view')))",
)
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    ok = [("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"), ("click", "view")]
    return Q.illegal_transitions(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", ok).select("event_id", "previous")


@query("personal_data_scan", r"select id, regexp_matches(email, '^[^@\s]+@[^@\s]+\.[a-z]+$') as has_email, regexp_matches(phone, '\d{4,}') as has_phone from dim_users where regexp_matches(coalesce(email, ''), '^[^@\s]+@[^@\s]+\.[a-z]+$') or regexp_matches(coalesce(phone, ''), '\d{4,}')")
def personal_data_scan(spark: SparkSession, sf: str) -> DataFrame:
    mail, phone = F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+$"), F.col("phone").rlike(r"\d{4,}")
    return load(spark, sf, "dim_users").where(F.coalesce(mail, F.lit(False)) | F.coalesce(phone, F.lit(False))).select("id", mail.alias("has_email"), phone.alias("has_phone"))
