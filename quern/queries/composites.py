"""Composite queries: features, calendars, protection, metrics, reconciliation and text analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import fold_accents
from ..operators import features as X
from ..operators.quality import exact_percentiles
from ..registry import query
from ..sources.tables import load


@query(
    "feature_transforms",
    """select o_orderkey, round((o_totalprice - m) / s, 6) as z, round((o_totalprice - lo) / (hi - lo), 8) as unit, round(ln(1 + o_totalprice), 8) as logp, least(4, cast(floor((o_totalprice - lo) / ((hi - lo) / 5)) as bigint)) as bucket
from orders, (select avg(o_totalprice) m, stddev_pop(o_totalprice) s, min(o_totalprice) lo, max(o_totalprice) hi from orders)""",
)
def feature_transforms(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    t = X.transformed(o, X.fitted(o, ["o_totalprice"]), ["o_totalprice"])
    bucket = F.least(F.lit(4), F.floor(F.col("o_totalprice_unit") * 5))
    return t.select("o_orderkey", F.round("o_totalprice_z", 6).alias("z"), F.round("o_totalprice_unit", 8).alias("unit"), F.round("o_totalprice_log", 8).alias("logp"), bucket.alias("bucket"))


_HOLIDAYS = ["1998-01-01", "1998-01-28", "1998-04-30", "1998-05-01", "1998-09-02"]


@query(
    "business_days",
    f"""with c as (select cast(range as date) d from range(date '1990-01-01', date '2012-01-01', interval 1 day)), w as (select d from c where isodow(d) < 6 and d not in ({', '.join(f"date '{h}'" for h in _HOLIDAYS)}))
select o_orderkey, n as working_days from orders join (select c.d, count(w.d) n from c left join w on w.d >= c.d and w.d < c.d + interval 10 day group by 1) on d = o_orderdate::date""",
)
def business_days(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_orderdate is not null")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", X.business_days_between(d, F.date_add(d, 10), _HOLIDAYS).alias("working_days"))


@query("pseudonyms", "select id, sha256('s3|' || email) as token from dim_users where email is not null")
def pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "dim_users").where("email is not null").select("id", X.pseudonym(F.col("email"), "s3").alias("token"))


@query("crypto_shredding", "select c_custkey, c_mktsegment, case when c_mktsegment <> 'BUILDING' then c_name end as readable from customer")
def crypto_shredding(spark: SparkSession, sf: str) -> DataFrame:
    """Names sealed under a key per segment; the key of one segment is deleted before reading."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("readable"))
    keys = c.select(F.col("c_mktsegment").alias("owner")).distinct().withColumn("key", F.substring(F.md5("owner"), 1, 16))
    return X.unsealed(X.sealed(c, "readable", "c_mktsegment", keys), "readable", "c_mktsegment", keys.where("owner <> 'BUILDING'"))


@query("row_level_view", "select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE')")
def row_level_view(spark: SparkSession, sf: str) -> DataFrame:
    """What a tenant (a region) may see."""
    mine = load(spark, sf, "nation").join(load(spark, sf, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return load(spark, sf, "customer").join(mine, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "merkle_root",
    """with recursive l(d, i, h) as (select 0, row_number() over (order by o_orderkey) - 1, sha256(o_orderpriority) from orders union all
select d + 1, p, sha256(a || b) from (select d, i // 2 as p, h as a, coalesce(lead(h) over (partition by d order by i), h) as b, i, count(*) over (partition by d) as c from l) where c > 1 and i % 2 = 0) select h as root from l order by d desc limit 1""",
)
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    return X.merkle_root(load(spark, sf, "orders"), ["o_orderkey"], "o_orderpriority")


@query(
    "semantic_metrics",
    "select l_returnflag, round(sum(l_extendedprice), 2) as gross, round(sum(l_extendedprice * (1 - l_discount)), 4) as net, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 8) as net_share, round(sum(l_extendedprice) / count(*), 4) as mean_price from lineitem group by 1",
)
def semantic_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = [X.Metric("gross", F.sum("l_extendedprice")), X.Metric("net", F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))), X.Metric("n", F.count(F.lit(1))), X.Metric("net_share", over=("net", "gross")), X.Metric("mean_price", over=("gross", "n"))]
    d = X.metrics(load(spark, sf, "lineitem"), ["l_returnflag"], m)
    return d.select("l_returnflag", F.round("gross", 2).alias("gross"), F.round("net", 4).alias("net"), "n", F.round("net_share", 8).alias("net_share"), F.round("mean_price", 4).alias("mean_price"))


@query(
    "cumulative_metric",
    "select s as o_orderstatus, m, n, cast(sum(n) over (partition by s order by m) as bigint) as n_to_date from (select o_orderstatus s, date_trunc('month', o_orderdate)::date m, count(*) n from orders group by 1, 2)",
)
def cumulative_metric(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return X.cumulative(d, ["o_orderstatus"], "m", "n")


@query(
    "schema_migration",
    "select p_partkey as part_id, split_part(p_name, ' ', 1) as colour, split_part(p_name, ' ', 2) as thing, try_cast(p_brand as integer) as p_brand, coalesce(p_size, 0) as p_size, 2 as version from part",
)
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").drop("p_type", "p_retailprice")
    return X.migrated(p, [("rename", "p_partkey", "part_id"), ("split", "p_name", " ", ["colour", "thing"]), ("cast", "p_brand", "int"), ("default", "p_size", 0), ("add", "version", 2)])


@query("replica_counters", "select l_suppkey, cast(sum(m) as bigint) as total from (select l_suppkey, l_linenumber, max(l_orderkey) m from lineitem group by 1, 2) group by 1")
def replica_counters(spark: SparkSession, sf: str) -> DataFrame:
    return X.merged_counters(load(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_orderkey")


@query("replica_registers", "select user_id, arg_max(event_type, row(ts, event_id)) as value from events group by 1")
def replica_registers(spark: SparkSession, sf: str) -> DataFrame:
    return X.merged_registers(load(spark, sf, "events"), "user_id", "ts", "event_id", "event_type")


@query(
    "bayesian_quality",
    """with g as (select product_id, count(*) filter (status is not null) ok, count(*) filter (status is null) bad from raw_orders group by 1),
t as (select product_id, ok, bad, sum(exp(lgamma(ok + bad + 2) - lgamma(j + 1) - lgamma(ok + bad + 2 - j) + j * ln(0.9) + (ok + bad + 1 - j) * ln(0.1))) p from g, unnest(range(ok + 1)) r(j) group by 1, 2, 3)
select product_id, ok, bad, round((ok + 1) / (ok + bad + 2), 8) as mean, round(p, 5) as p_healthy from t""",
)
def bayesian_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior pass rate of the status check per product."""
    b = X.beta_scores(load(spark, sf, "raw_orders"), "product_id", F.col("status").isNotNull())
    return b.withColumns({"mean": F.round("mean", 8), "p_healthy": F.round("p_healthy", 5)})


@query(
    "closest_words",
    "with s as (select distinct status from raw_orders where status is not null), v(v) as (values ('placed'), ('paid'), ('shipped'), ('delivered'), ('cancelled')), d as (select status, arg_min(v, row(levenshtein(lower(trim(status)), v), v)) c, min(levenshtein(lower(trim(status)), v)) m from s, v group by 1) select status, case when m <= 2 then c end as closest from d",
)
def closest_words(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "raw_orders").select("status").where("status is not null").distinct()
    return X.closest_word(s, "status", ["placed", "paid", "shipped", "delivered", "cancelled"])


@query(
    "lexicon_scores",
    """with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') ws from documents), u as (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) i, ws from w),
s as (select doc_id, sum(v * case when i > 1 and ws[i - 1] in ('not', 'no', 'không') then -1 else 1 end) score from u join (values ('slow', -1.0), ('failed', -2.0), ('fault', -1.0), ('clear', 1.0), ('safe', 1.0), ('cheap', 0.5), ('cost', -0.5), ('chậm', -1.0), ('lỗi', -1.0)) l(x, v) using (x) group by 1)
select d.doc_id, case when text is not null then coalesce(score, 0)::double end as score from documents d left join s using (doc_id)""",
)
def lexicon_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Polarity of every document's words, over whole texts."""
    words = {"slow": -1.0, "failed": -2.0, "fault": -1.0, "clear": 1.0, "safe": 1.0, "cheap": 0.5, "cost": -0.5, "chậm": -1.0, "lỗi": -1.0}
    return X.lexicon_score(load(spark, sf, "documents"), "text", words, ["not", "no", "không"]).select("doc_id", "score")


@query(
    "run_length_encoding",
    "select user_id, event_type, min(ts) as first_at, count(*) as n from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) g from events) group by user_id, event_type, g",
)
def run_length_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return X.run_lengths(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "reconciliation",
    """with o as (select o_orderkey k, o_totalprice a from orders where o_orderkey % 11 <> 0), l as (select l_orderkey k, sum(l_extendedprice) a from lineitem group by 1), c as (select o_orderkey k, o_totalprice a from orders)
select k as id, case when n < 3 then 'missing' when hi - lo > 50000 then 'mismatch' else 'matched' end as status, absent, round(hi - lo, 6) as spread from (select k, count(distinct s) n, max(a) hi, min(a) lo,
concat_ws(',', case when not bool_or(s = 'book') then 'book' end, case when not bool_or(s = 'copy') then 'copy' end, case when not bool_or(s = 'lines') then 'lines' end) absent from (select k, a, 'book' s from o union all select k, a, 'lines' from l union all select k, a, 'copy' from c) group by 1)""",
)
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"))
    li = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("a"))
    return X.reconciled({"book": o.where("id % 11 <> 0"), "copy": o, "lines": li}, "id", "a", 50000)


@query(
    "daily_fact",
    """with o as (select o_orderdate::date d, count(*) n_orders, round(sum(o_totalprice), 2) v from orders group by 1), s as (select l_shipdate::date d, count(*) n_lines from lineitem group by 1), e as (select ts::date d, count(*) n_events from events group by 1)
select d as day, coalesce(n_orders, 0) as n_orders, coalesce(n_lines, 0) as n_lines, coalesce(n_events, 0) as n_events from o full join s using (d) full join e using (d)""",
)
def daily_fact(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources on one day key: a union of partial aggregates, so one shuffle instead of two outer joins."""
    part = lambda t, c, n: load(spark, sf, t).groupBy(F.to_date(c).alias("day")).agg(F.count(F.lit(1)).alias(n))
    u = part("orders", "o_orderdate", "n_orders").unionByName(part("lineitem", "l_shipdate", "n_lines"), True).unionByName(part("events", "ts", "n_events"), True)
    return u.groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_orders", "n_lines", "n_events")])


@query(
    "best_spread",
    "select l_partkey, round(max(p) - min(p), 4) as spread, arg_min(l_suppkey, row(p, l_suppkey)) as cheapest from (select l_partkey, l_suppkey, arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) p from lineitem group by 1, 2) group by 1",
)
def best_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Latest unit price per part and supplier, then the span between suppliers."""
    k = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    last = load(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), k).alias("p"))
    return last.groupBy("l_partkey").agg(F.round(F.max("p") - F.min("p"), 4).alias("spread"), F.min_by("l_suppkey", F.struct("p", "l_suppkey")).alias("cheapest"))


@query(
    "fall_from_peak",
    "select o_orderkey from (select o_orderkey, o_totalprice p, max(o_totalprice) over w m, count(*) over w c from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)) where c >= 3 and p < 0.2 * m",
)
def fall_from_peak(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.max("o_totalprice").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("c"))
    return o.where("c >= 3 and p < 0.2 * m").select("o_orderkey")


@query(
    "monthly_median_index",
    """with m as (select date_trunc('month', l_shipdate)::date m, median(l_extendedprice / l_quantity) v from lineitem group by 1), r as (select m, v, v / lag(v) over (order by m) r from m)
select m as month, round(v, 4) as median_price, round(exp(sum(ln(coalesce(r, 1))) over (order by m)), 6) as index from r""",
)
def monthly_median_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chained month over month; the windows run over a row per month."""
    li = load(spark, sf, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    g = exact_percentiles(li, ["month"], "price", {"v": 0.5})
    w = Window.orderBy("month")
    r = g.withColumn("r", F.coalesce(F.col("v") / F.lag("v").over(w), F.lit(1.0)))
    return r.select("month", F.round("v", 4).alias("median_price"), F.round(F.exp(F.sum(F.log("r")).over(w)), 6).alias("index"))


@query(
    "peer_change",
    """with a as (select user_id, list_sort(list(distinct event_type)) v from events where ts < timestamp '2024-01-20' group by 1), b as (select user_id, list_sort(list(distinct event_type)) v from events where ts >= timestamp '2024-01-20' group by 1)
select user_id, round(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))), 6) as similarity from a join b using (user_id)""",
)
def peer_change(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of an entity's partners before and after a date; one aggregate for both sets."""
    cut = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    g = load(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(cut, F.col("event_type"))).alias("a"), F.collect_set(F.when(~cut, F.col("event_type"))).alias("b"))
    return g.where((F.size("a") > 0) & (F.size("b") > 0)).select("user_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("similarity"))


@query(
    "shadow_diff",
    "select 'only_new' as kind, count(*) as n from orders where o_orderstatus <> 'P' and not (o_totalprice > 150000) union all select 'only_old', count(*) from orders where o_totalprice > 150000 and o_orderstatus = 'P' union all select 'both', count(*) from orders where o_totalprice > 150000 and o_orderstatus <> 'P'",
)
def shadow_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a pipeline over the same input: rows either alone gives."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old, new = (d.select("o_orderkey", "o_totalprice", F.lit(1).alias(n)) for d, n in ((o.where("o_totalprice > 150000"), "_old"), (o.where("o_orderstatus <> 'P'"), "_new")))
    j = old.join(new, ["o_orderkey", "o_totalprice"], "full_outer")
    kind = F.when(F.col("_old").isNull(), "only_new").when(F.col("_new").isNull(), "only_old").otherwise("both")
    n = j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = spark.createDataFrame([("only_new",), ("only_old",), ("both",)], "kind string")
    return kinds.join(n, "kind", "left").na.fill(0, ["n"])


@query(
    "query_log_shapes",
    r"""select md5(regexp_replace(regexp_replace(lower(trim(payload)), '"[^"]*"', '?', 'g'), '[0-9]+(\.[0-9]+)?', '#', 'g')) as shape, count(*) as n from sample_events where payload is not null group by 1""",
)
def query_log_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts grouped by their shape: literals replaced, then hashed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim("payload")), r'"[^"]*"', "?"), r"[0-9]+(\.[0-9]+)?", "#")
    return load(spark, sf, "sample_events").where("payload is not null").groupBy(F.md5(s).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("folded_cities", "select count(distinct lower(regexp_replace(replace(replace(strip_accents(city), 'đ', 'd'), 'Đ', 'D'), '\\s+', '', 'g'))) as n_cities from customer_snapshots")
def folded_cities(spark: SparkSession, sf: str) -> DataFrame:
    c = F.lower(F.regexp_replace(fold_accents(F.col("city")), r"\s+", ""))
    return load(spark, sf, "customer_snapshots").agg(F.countDistinct(c).alias("n_cities"))


@query("text_tokens", "select lower(trim(lang)) as lang, sum(len(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')))::bigint as n_words from documents where text is not null group by 1")
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of Latin letters and digits, by language as spelt without regard to case."""
    d = load(spark, sf, "documents").where("text is not null").withColumn("t", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return d.groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.sum(F.size(F.filter(F.split("t", "[^a-z0-9]+"), lambda w: w != ""))).alias("n_words"))
