"""Scans, filters, joins, aggregates, windows, sorts, sets and scalars on the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.runtime import broadcast_if_small
from ..operators.quality import exact_percentiles
from ..registry import query
from ..sources.tables import load


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


# ---------------------------------------------------------------- TPC-H shapes


@query(
    "q1_pricing_summary",
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 6) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
def q1_pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").where(F.col("l_shipdate") <= _ts("1998-09-02"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(_revenue()), 4).alias("sum_disc"),
        F.round(F.sum(_revenue() * (1 + F.col("l_tax"))), 4).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "q3_unshipped_orders",
    """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
)
def q3_unshipped_orders(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = load(spark, sf, "orders").where(F.col("o_orderdate") < _ts("1998-03-15"))
    li = load(spark, sf, "lineitem").where(F.col("l_shipdate") > _ts("1998-03-15"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left_semi").join(li, o.o_orderkey == li.l_orderkey)
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_revenue()), 4).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query(
    "q4_exists_semi",
    """select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by 1""",
)
def q4_exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where((F.col("o_orderdate") >= _ts("1997-01-01")) & (F.col("o_orderdate") < _ts("1998-01-01")))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    return o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate > o.o_orderdate), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q5_region_revenue",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1""",
)
def q5_region_revenue(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").join(load(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    n = broadcast_if_small(n, 1000, load(spark, sf, "nation"))
    suppliers, customers = load(spark, sf, "supplier"), load(spark, sf, "customer")
    s = suppliers.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    c = customers.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")
    o = load(spark, sf, "orders").join(broadcast_if_small(c, base=customers), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    # both sides shrink to the region before they meet
    li = load(spark, sf, "lineitem").join(broadcast_if_small(s, base=suppliers), F.col("l_suppkey") == F.col("s_suppkey"))
    j = li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(_revenue()), 4).alias("revenue"))


@query(
    "q6_forecast_revenue",
    """select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01'
and l_discount between 0.05 and 0.07 and l_quantity < 24""",
)
def q6_forecast_revenue(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").where((F.col("l_shipdate") >= _ts("1997-01-01")) & (F.col("l_shipdate") < _ts("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query(
    "q10_returned_items",
    """select c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
where l_returnflag = 'R' group by 1, 2, 3 order by revenue desc, c_custkey limit 20""",
)
def q10_returned_items(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", _revenue().alias("v"))
    by = li.join(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum("v"), 4).alias("revenue"))
    c = load(spark, sf, "customer").join(broadcast_if_small(load(spark, sf, "nation"), 1000), F.col("c_nationkey") == F.col("n_nationkey"))
    return by.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query(
    "q11_having_scalar_subquery",
    """select l_suppkey, round(sum(l_extendedprice), 2) as total from lineitem group by 1 having sum(l_extendedprice) > (select avg(t) from (select sum(l_extendedprice) t from lineitem group by l_suppkey))""",
)
def q11_having_scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    by = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("t"))
    mean = by.agg(F.avg("t").alias("m"))  # one row
    return by.join(F.broadcast(mean), F.col("t") > F.col("m")).select("l_suppkey", F.round("t", 2).alias("total"))


@query(
    "q12_conditional_counts",
    """select l_returnflag, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high, cast(sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as low
from orders join lineitem on o_orderkey = l_orderkey group by 1""",
)
def q12_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    hi = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    j = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("l_returnflag").agg(F.count_if(hi).alias("high"), F.count_if(~hi).alias("low"))


@query(
    "q14_promo_share",
    """select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_share
from lineitem join part on l_partkey = p_partkey""",
)
def q14_promo_share(spark: SparkSession, sf: str) -> DataFrame:
    j = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.agg(F.round(100.0 * F.sum(F.when(F.col("p_type").like("PROMO%"), _revenue()).otherwise(0)) / F.sum(_revenue()), 6).alias("promo_share"))


@query(
    "q18_large_orders",
    "select o_orderkey, o_custkey, sum(l_quantity) as qty from orders join lineitem on o_orderkey = l_orderkey group by 1, 2 having sum(l_quantity) > 250",
)
def q18_large_orders(spark: SparkSession, sf: str) -> DataFrame:
    big = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 250")
    return load(spark, sf, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "qty")


@query(
    "join_ten_way",
    """select r.r_name as customer_region, r2.r_name as supplier_region, p_brand, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation cn on c_nationkey = cn.n_nationkey join region r on cn.n_regionkey = r.r_regionkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region r2 on sn.n_regionkey = r2.r_regionkey
join part on l_partkey = p_partkey group by 1, 2, 3""",
)
def join_ten_way(spark: SparkSession, sf: str) -> DataFrame:
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    places = broadcast_if_small(places, 1000, load(spark, sf, "nation"))
    customers, suppliers, parts = (load(spark, sf, t) for t in ("customer", "supplier", "part"))
    c = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("customer_region"))
    s = suppliers.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("supplier_region"))
    o = load(spark, sf, "orders").join(broadcast_if_small(c, base=customers), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "customer_region")
    p = parts.select("p_partkey", "p_brand")
    # the small dimensions first, so that one join of the large tables shuffles
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    li = li.join(broadcast_if_small(s, base=suppliers), F.col("l_suppkey") == F.col("s_suppkey")).join(broadcast_if_small(p, base=parts), F.col("l_partkey") == F.col("p_partkey"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("customer_region", "supplier_region", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


# ---------------------------------------------------------------- filters and expressions

_FILTERS = {
    "filter_like": ("part", "p_name like '%ring%' and p_brand not like 'Brand#1_'", ["p_partkey", "p_name"]),
    "filter_between": ("lineitem", "l_quantity between 10 and 20 and l_discount not between 0.02 and 0.08", ["l_orderkey", "l_linenumber", "l_quantity"]),
    "filter_in": ("orders", "o_orderpriority in ('1-URGENT', '5-LOW') and o_orderstatus not in ('F')", ["o_orderkey", "o_orderpriority"]),
    "filter_nulls": ("raw_orders", "status is null or customer_id is null or amount_cents is null", ["id", "updated_at"]),
    "filter_not_or": ("customer", "not (c_acctbal < 0 or c_mktsegment = 'MACHINERY') and (c_nationkey > 5 or c_acctbal > 5000)", ["c_custkey"]),
    "filter_box": ("lineitem", "l_quantity >= 5 and l_quantity <= 15 and l_extendedprice >= 10000 and l_extendedprice <= 30000 and l_tax <= 0.04", ["l_orderkey", "l_linenumber"]),
}


def _register_filters() -> None:
    for name, (table, cond, cols) in _FILTERS.items():

        def run(spark: SparkSession, sf: str, table: str = table, cond: str = cond, cols: list[str] = cols) -> DataFrame:
            return load(spark, sf, table).where(cond).select(*cols)

        query(name, f"select {', '.join(cols)} from {table} where {cond}")(run)


_register_filters()


@query(
    "expr_arithmetic",
    """select l_orderkey, l_linenumber, l_extendedprice / l_quantity as unit, cast(l_orderkey as bigint) // 7 as q, l_orderkey % 7 as m, -l_tax as neg, abs(l_discount - 0.05) > 0.03 as far,
l_extendedprice * 2 as up, greatest(l_discount, l_tax) as g, least(l_discount, l_tax) as l from lineitem""",
)
def expr_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.expr("l_orderkey div 7").alias("q"),
        (F.col("l_orderkey") % 7).alias("m"),
        (-F.col("l_tax")).alias("neg"),
        (F.abs(F.col("l_discount") - 0.05) > 0.03).alias("far"),
        (F.col("l_extendedprice") * 2).alias("up"),
        F.greatest("l_discount", "l_tax").alias("g"),
        F.least("l_discount", "l_tax").alias("l"),
    )


@query(
    "expr_case_cast",
    """select o_orderkey, case when o_totalprice < 100000 then 'small' when o_totalprice < 300000 then 'middle' else 'large' end as size, cast(floor(o_totalprice) as bigint) as whole, cast(o_orderkey as varchar) as key_text,
try_cast(substr(o_orderpriority, 1, 1) as integer) as rank, coalesce(nullif(o_orderstatus, 'P'), 'open') as status from orders""",
)
def expr_case_cast(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(p < 100000, "small").when(p < 300000, "middle").otherwise("large").alias("size"),
        F.floor(p).cast("bigint").alias("whole"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rank"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("open")).alias("status"),
    )


@query(
    "scalar_strings",
    """select p_partkey, upper(p_name) as u, length(p_name) as n, p_brand || '/' || p_type as both_, replace(p_name, ' ', '-') as dashed, split_part(p_name, ' ', 1) as first_word, trim('  ' || p_type || ' ') as t,
substr(p_brand, 7) as no, reverse(p_type) as r, position('e' in p_name) as at, lpad(substr(p_brand, 7), 4, '0') as padded, regexp_extract(p_brand, '([0-9]+)', 1) as digits from part""",
)
def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey",
        F.upper(n).alias("u"),
        F.length(n).alias("n"),
        F.concat_ws("/", "p_brand", "p_type").alias("both_"),
        F.regexp_replace(n, " ", "-").alias("dashed"),
        F.split_part(n, F.lit(" "), F.lit(1)).alias("first_word"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("t"),
        F.expr("substring(p_brand, 7)").alias("no"),
        F.reverse("p_type").alias("r"),
        F.locate("e", n).alias("at"),
        F.lpad(F.expr("substring(p_brand, 7)"), 4, "0").alias("padded"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
    )


@query(
    "scalar_dates",
    """select o_orderkey, date_trunc('month', o_orderdate)::date as month, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(dayofyear(o_orderdate) as bigint) as doy, strftime(o_orderdate, '%Y-%m') as ym,
cast(o_orderdate + interval 30 day as date) as due, date_diff('day', o_orderdate::date, date '2002-01-01') as age_days, cast(case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as bigint) as fiscal_year,
cast(last_day(o_orderdate) as date) as month_end from orders""",
)
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.trunc(d, "month").alias("month"),
        F.year(d).cast("bigint").alias("y"),
        F.quarter(d).cast("bigint").alias("q"),
        F.dayofyear(d).cast("bigint").alias("doy"),
        F.date_format(d, "yyyy-MM").alias("ym"),
        F.date_add(F.to_date(d), 30).alias("due"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date(d)).cast("bigint").alias("age_days"),
        F.when(F.month(d) >= 4, F.year(d)).otherwise(F.year(d) - 1).cast("bigint").alias("fiscal_year"),
        F.last_day(d).alias("month_end"),
    )


@query("scalar_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as missing from events")
def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("scalar_hash", "select c_custkey, sha256(c_name) as h, md5(c_mktsegment) as m from customer")
def scalar_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"), F.md5("c_mktsegment").alias("m"))


@query(
    "scalar_arrays",
    """select o_custkey, list_sort(list(distinct o_orderstatus)) as statuses, len(list(o_orderkey)) as n, list_sum(list(o_orderkey)) as key_sum from orders group by 1""",
)
def scalar_arrays(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"), F.collect_list("o_orderkey").alias("keys"))
    return g.select("o_custkey", "statuses", F.size("keys").cast("bigint").alias("n"), F.aggregate("keys", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("key_sum"))


# ---------------------------------------------------------------- joins

_J = "select o_orderkey, c_custkey, c_name from orders {0} join customer on o_custkey = c_custkey and c_acctbal > 5000"


def _join(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
        return o.join(c, (o.o_custkey == c.c_custkey) & (c.c_acctbal > 5000), how).select("o_orderkey", "c_custkey", "c_name")

    return run


for _name, _how, _sql in (("join_inner", "inner", ""), ("join_left", "left", "left"), ("join_right", "right", "right"), ("join_full", "full", "full")):
    query(_name, _J.format(_sql))(_join(_how))


@query("join_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_cross_small", "select r_name, n_name from region cross join nation")
def join_cross_small(spark: SparkSession, sf: str) -> DataFrame:
    """A full product, of two reference tables whose size is fixed and checked."""
    return load(spark, sf, "nation").crossJoin(broadcast_if_small(load(spark, sf, "region"), 1000)).select("r_name", "n_name")


@query(
    "join_theta_bands",
    """select o_orderkey, band from orders join (values ('a', 0.0, 100000.0), ('b', 100000.0, 250000.0), ('c', 250000.0, 1e12)) b(band, lo, hi) on o_totalprice >= lo and o_totalprice < hi""",
)
def join_theta_bands(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.createDataFrame([("a", 0.0, 100000.0), ("b", 100000.0, 250000.0), ("c", 250000.0, 1e12)], "band string, lo double, hi double")
    return load(spark, sf, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).select("o_orderkey", "band")


@query(
    "join_null_safe",
    """select a.status, a.n, b.n as n_users from (select status, count(*) n from raw_orders group by 1) a full join (select status, count(*) n from dim_users group by 1) b on a.status is not distinct from b.status""",
)
def join_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "raw_orders").groupBy("status").agg(F.count(F.lit(1)).alias("n")).alias("a")
    b = load(spark, sf, "dim_users").groupBy("status").agg(F.count(F.lit(1)).alias("n_users")).alias("b")
    return a.join(b, F.col("a.status").eqNullSafe(F.col("b.status")), "full").select("a.status", "n", "n_users")


@query(
    "join_residual",
    """select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey and l_shipdate >= o_orderdate + interval 90 day and l_extendedprice > o_totalprice * 0.2""",
)
def join_residual(spark: SparkSession, sf: str) -> DataFrame:
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    cond = (li.l_orderkey == o.o_orderkey) & (li.l_shipdate >= o.o_orderdate + F.expr("interval 90 days")) & (li.l_extendedprice > o.o_totalprice * 0.2)
    return li.join(o, cond).select("l_orderkey", "l_linenumber")


@query(
    "subquery_correlated_count",
    "select o_orderkey, (select count(*) from orders i where i.o_custkey = o.o_custkey and i.o_orderdate < o.o_orderdate) as earlier from orders o",
)
def subquery_correlated_count(spark: SparkSession, sf: str) -> DataFrame:
    """The correlated count as a running count, so one shuffle instead of a self-join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("o_custkey", "o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", (F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(same)).alias("earlier"))


@query(
    "subquery_above_group_mean",
    "select o_orderkey from (select o_orderkey, o_totalprice, avg(o_totalprice) over (partition by o_custkey) m from orders) where o_totalprice > m + 1e-6",
)
def subquery_above_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").withColumn("m", F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))).where("o_totalprice > m + 1e-6").select("o_orderkey")


# ---------------------------------------------------------------- aggregates


@query(
    "agg_basic",
    """select o_orderstatus, count(*) as n, count(distinct o_custkey) as custs, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as lo, max(o_totalprice) as hi, round(stddev_samp(o_totalprice), 4) as sd,
round(var_pop(o_totalprice), 2) as vp, bool_or(o_totalprice > 499000) as any_large, bool_and(o_totalprice > 0) as all_positive from orders group by 1""",
)
def agg_basic(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("custs"), F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.stddev_samp(p), 4).alias("sd"),
        F.round(F.var_pop(p), 2).alias("vp"), F.bool_or(p > 499000).alias("any_large"), F.bool_and(p > 0).alias("all_positive"),
    )


_SETS = "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, grouping(l_returnflag) * 2 + grouping(l_linestatus) as g from lineitem group by {0}"


def _sets(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        li = load(spark, sf, "lineitem")
        r, s = F.col("l_returnflag"), F.col("l_linestatus")
        g = li.rollup(r, s) if kind == "rollup" else li.cube(r, s) if kind == "cube" else li.groupingSets([[r], [s]], r, s)
        return g.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.grouping_id().cast("bigint").alias("g"))

    return run


query("agg_rollup", _SETS.format("rollup (l_returnflag, l_linestatus)"))(_sets("rollup"))
query("agg_cube", _SETS.format("cube (l_returnflag, l_linestatus)"))(_sets("cube"))
query("agg_grouping_sets", _SETS.format("grouping sets ((l_returnflag), (l_linestatus))"))(_sets("sets"))


@query(
    "agg_argmax",
    "select o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) as top_order, arg_min(o_orderkey, row(o_totalprice, o_orderkey)) as low_order, count(*) filter (o_orderstatus = 'F') as finished from orders group by 1",
)
def agg_argmax(spark: SparkSession, sf: str) -> DataFrame:
    k = F.struct("o_totalprice", "o_orderkey")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", k).alias("top_order"), F.min_by("o_orderkey", k).alias("low_order"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("agg_nested", "select s as o_orderstatus, round(max(t), 2) as max_of_sums, round(sum(m), 2) as sum_of_maxima from (select o_orderstatus s, o_custkey, sum(o_totalprice) t, max(o_totalprice) m from orders group by 1, 2) group by 1")
def agg_nested(spark: SparkSession, sf: str) -> DataFrame:
    inner = load(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.sum("o_totalprice").alias("t"), F.max("o_totalprice").alias("m"))
    return inner.groupBy("o_orderstatus").agg(F.round(F.max("t"), 2).alias("max_of_sums"), F.round(F.sum("m"), 2).alias("sum_of_maxima"))


@query(
    "agg_percentiles",
    "select l_returnflag, quantile_cont(l_extendedprice, 0.5) as median, quantile_disc(l_extendedprice, 0.9) as p90, mode(l_linenumber) as m from lineitem group by 1",
)
def agg_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles; the most frequent line number is unique in the data."""
    li = load(spark, sf, "lineitem")
    p = exact_percentiles(li, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9}, ("p90",))
    m = li.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).groupBy("l_returnflag").agg(F.max_by("l_linenumber", "n").alias("m"))
    return p.join(m, "l_returnflag")


@query(
    "agg_nearest_rank",
    """select l_suppkey, v[greatest(1, least(len(v), cast(floor(0.9 * len(v) + 0.5) as bigint)))] as p90, len(v) as n from (select l_suppkey, list_sort(list(l_quantity)) v from lineitem group by 1) where len(v) >= 3""",
)
def agg_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank int(q * n + 0.5) within [1, n]: by a window, so no group is gathered into one array."""
    w = Window.partitionBy("l_suppkey").orderBy("l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    r = load(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("n"))
    return r.where("n >= 3").where(F.col("r") == F.greatest(F.lit(1), F.least(F.col("n"), F.floor(0.9 * F.col("n") + 0.5)))).select("l_suppkey", F.col("l_quantity").alias("p90"), "n")


@query(
    "agg_pivot",
    """select l_linestatus, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1""",
)
def agg_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")])


@query("agg_unpivot", "select p_partkey, k, v from (select p_partkey, p_brand, p_type from part) unpivot (v for k in (p_brand, p_type))")
def agg_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").unpivot(["p_partkey"], ["p_brand", "p_type"], "k", "v")


@query(
    "agg_zero_filled",
    "select s.status, coalesce(n, 0) as n from (values ('F'), ('O'), ('P'), ('X')) s(status) left join (select o_orderstatus, count(*) n from orders group by 1) on status = o_orderstatus",
)
def agg_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    n = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "status", "left").na.fill(0, ["n"])


@query(
    "agg_concentration",
    """select n_suppliers, hhi, round(2.0 * weighted / (n_suppliers * total) - (n_suppliers + 1.0) / n_suppliers, 8) * n_suppliers / (n_suppliers - 1) as gini from
(select count(*) n_suppliers, round(sum((v / t) * (v / t)), 10) hhi, sum(rn * v) weighted, sum(v) total from (select v, row_number() over (order by v, l_suppkey) rn, sum(v) over () t from (select l_suppkey, sum(l_quantity) v from lineitem group by 1)))""",
)
def agg_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Herfindahl index and Gini of suppliers' quantities, ranks by a distributed sort."""
    from ..plans.ordering import range_sorted, with_running

    v = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    ranked = with_running(range_sorted(v.withColumn("one", F.lit(1)), [F.col("v"), F.col("l_suppkey")]), {"rn": "one"})
    a = ranked.agg(F.count(F.lit(1)).alias("n_suppliers"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.sum(F.col("rn") * F.col("v")).alias("weighted"), F.sum("v").alias("total"))
    n = F.col("n_suppliers")
    gini = F.round(2.0 * F.col("weighted") / (n * F.col("total")) - (n + 1.0) / n, 8) * n / (n - 1)
    return a.select("n_suppliers", F.round(F.col("sq") / (F.col("total") * F.col("total")), 10).alias("hhi"), gini.alias("gini"))


@query("agg_weighted_price", "select l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as vwap from lineitem group by 1")
def agg_weighted_price(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("vwap"))


@query("agg_distinct", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# ---------------------------------------------------------------- windows


@query(
    "window_ranks",
    """select o_orderkey, row_number() over w as rn, rank() over (partition by o_custkey order by o_orderpriority) as rk, dense_rank() over (partition by o_custkey order by o_orderpriority) as dr, ntile(5) over w as q,
round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""",
)
def window_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(5).over(w).alias("q"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd")
    )


@query(
    "window_offsets",
    """select o_orderkey, lag(o_totalprice) over w as prev, lead(o_totalprice, 2) over w as next2, first_value(o_orderkey) over w as first_key, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second_key,
round(o_totalprice / lag(o_totalprice) over w - 1, 8) as growth from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
)
def window_offsets(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf, "orders").select(
        "o_orderkey", F.lag(p).over(w).alias("prev"), F.lead(p, 2).over(w).alias("next2"), F.first("o_orderkey").over(w).alias("first_key"), F.nth_value("o_orderkey", 2).over(whole).alias("second_key"), F.round(p / F.lag(p).over(w) - 1, 8).alias("growth")
    )


@query(
    "window_frames",
    """select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate), 2) as running_range, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running_rows,
round(sum(o_totalprice) over (partition by o_custkey), 2) as total, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as moving3,
round(sum(o_totalprice) over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey rows unbounded preceding), 2) as ytd,
count(*) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as last90 from orders""",
)
def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    p, by = F.col("o_totalprice"), Window.partitionBy("o_custkey")
    rows = by.orderBy("o_orderdate", "o_orderkey")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.round(F.sum(p).over(by.orderBy("o_orderdate")), 2).alias("running_range"),
        F.round(F.sum(p).over(rows.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running_rows"),
        F.round(F.sum(p).over(by), 2).alias("total"),
        F.round(F.avg(p).over(rows.rowsBetween(-2, 0)), 4).alias("moving3"),
        F.round(F.sum(p).over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("ytd"),
        F.count(F.lit(1)).over(by.orderBy(days).rangeBetween(-90, 0)).alias("last90"),
    )


@query("window_top_per_group", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r <= 3")
def window_top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query(
    "window_rank_of_sums",
    "select l_suppkey, qty, rank() over (order by qty desc) as rk, dense_rank() over (order by qty desc) as dr from (select l_suppkey, sum(l_quantity) qty from lineitem group by 1)",
)
def window_rank_of_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks over a whole table without a single-task window: ranks of the distinct sums by a global range sort."""
    from ..plans.ordering import range_sorted, with_running

    q = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    sums = q.groupBy("qty").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    ranked = with_running(range_sorted(sums, [F.col("qty").desc()]), {"before": "n", "dr": "one"})
    return q.join(ranked.select("qty", (F.col("before") - F.col("n") + 1).alias("rk"), "dr"), "qty").select("l_suppkey", "qty", "rk", "dr")


@query(
    "window_monthly_growth",
    """select m, total, round(total / lag(total, 1) over (order by m) - 1, 8) as mom, round(total / lag(total, 12) over (order by m) - 1, 8) as yoy from (select date_trunc('month', o_orderdate)::date m, round(sum(o_totalprice), 2) total from orders group by 1)""",
)
def window_monthly_growth(spark: SparkSession, sf: str) -> DataFrame:
    """The windows run over one row per month, a number bounded by the calendar."""
    g = load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    w = Window.orderBy("m")
    return g.select("m", "total", F.round(F.col("total") / F.lag("total", 1).over(w) - 1, 8).alias("mom"), F.round(F.col("total") / F.lag("total", 12).over(w) - 1, 8).alias("yoy"))


@query(
    "window_outliers",
    """select o_orderkey from (select o_orderkey, o_totalprice p, avg(o_totalprice) over (partition by o_orderpriority) m, stddev_samp(o_totalprice) over (partition by o_orderpriority) s from orders) where abs(p - m) > 1.7 * s + 1e-6""",
)
def window_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """z-scores against group moments: an aggregate with a row per group and a join, since groups are few and large."""
    o = load(spark, sf, "orders")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return o.join(broadcast_if_small(m), "o_orderpriority").where("abs(o_totalprice - m) > 1.7 * s + 1e-6").select("o_orderkey")


# ---------------------------------------------------------------- sorts and sets


@query("sort_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("sort_offset", "select c_custkey, c_acctbal from customer order by c_acctbal asc nulls last, c_custkey limit 30 offset 50")
def sort_offset(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey").offset(50).limit(30)


@query("set_union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return set_union_all(spark, sf).distinct()


@query("set_intersect", "select l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")))


@query("set_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(load(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("set_except_all", "select l_suppkey as k from lineitem where l_quantity > 25 except all select l_suppkey from lineitem where l_quantity <= 25")
def set_except_all(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.where("l_quantity > 25").select(F.col("l_suppkey").alias("k")).exceptAll(li.where("l_quantity <= 25").select(F.col("l_suppkey").alias("k")))


@query(
    "sql_recursive_calendar",
    "with recursive d(day) as (select date '1998-01-01' union all select cast(day + interval 1 day as date) from d where day < date '1998-12-31') select day, count(o_orderkey) as n from d left join orders on o_orderdate::date = day group by 1",
)
def sql_recursive_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """A date spine with zero-filled counts."""
    spine = spark.range(1).select(F.explode(F.sequence(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))).alias("day"))
    n = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, "day", "left").na.fill(0, ["n"])


@query(
    "sql_text_front_end",
    "select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from customer, orders, nation where c_custkey = o_custkey and c_nationkey = n_nationkey and o_orderstatus <> 'P' group by n_name having count(*) > 10",
)
def sql_text_front_end(spark: SparkSession, sf: str) -> DataFrame:
    """Plain SQL text with comma joins through the catalog of registered tables."""
    from ..sources.catalog import sql

    return sql(spark, sf, "select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from customer, orders, nation where c_custkey = o_custkey and c_nationkey = n_nationkey and o_orderstatus <> 'P' group by n_name having count(*) > 10")
