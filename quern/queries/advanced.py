"""Queries on graphs, provenance, sketches, sequences and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G, layout as L, provenance as P, sequences as S, sketches as K
from ..registry import query
from ..sources.tables import load

# ---------------------------------------------------------------- graphs

_USER_EDGES = "(select distinct user_id as src, (user_id * 7 + k * 13) % (select count(distinct user_id) from events) as dst from (select user_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events) where k is not null)"


def _user_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an edge of its user to another one, drawn over all users, with its time."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    n = F.broadcast(e.agg(F.countDistinct("user_id").alias("_n")))  # one row
    return e.select("user_id", k.alias("k"), "ts").where("k is not null").join(n, F.lit(True)).select(F.col("user_id").alias("src"), ((F.col("user_id") * 7 + F.col("k") * 13) % F.col("_n")).alias("dst"), "ts")


def _user_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _user_steps(spark, sf).select("src", "dst").distinct()


_UND = f"(select distinct least(src, dst) a, greatest(src, dst) b from {_USER_EDGES} where src <> dst)"


@query("graph_triangles", f"with e as {_UND} select x.a, x.b, y.b as c from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b")
def graph_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return G.triangles(_user_edges(spark, sf))


@query(
    "graph_four_cycles",
    f"""with e as {_UND}, f as (select a, b from e union all select b, a from e), w as (select x.b as l, y.b as r, count(*) n from f x join f y on x.a = y.a and x.b < y.b group by 1, 2) select cast(sum(n * (n - 1) // 2) // 2 as bigint) as n_cycles from w""",
)
def graph_four_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.four_cycles(_user_edges(spark, sf))


@query(
    "graph_components",
    """with recursive e as (select distinct o_custkey as a, 1000000000 + l_suppkey as b from orders join lineitem on l_orderkey = o_orderkey where o_orderkey is not null union select 1000000000 + l_suppkey, o_custkey from orders join lineitem on l_orderkey = o_orderkey),
r(v, c) using key (v) as (select a, min(least(a, b)) from e group by 1 union select e.b, min(r.c) from r join e on e.a = r.v join recurring.r as old on old.v = e.b where r.c < old.c group by 1)
select v, c as component from r""",
)
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and the suppliers that served them."""
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.lit(1000000000) + F.col("l_suppkey")).alias("dst"))
    return G.components(e)


@query(
    "graph_pagerank",
    f"""with recursive e as {_USER_EDGES}, o as (select src v, count(*) out from e group by 1), vs as (select v, out, count(*) over () n from (select src v from e union select dst from e) left join o using (v)),
r(i, v, rank) as (select 0, v, 1.0::double / n from vs union all
select i, v, 0.15 / n + 0.85 * (coalesce(s, 0) + coalesce(x, 0) / n) from (select any_value(i) + 1 i from r) cross join vs left join (select dst v, sum(rank / out) s from e join r on r.v = e.src join o on o.v = e.src group by 1) using (v) cross join (select sum(rank) x from r left join o using (v) where out is null) where i <= 50)
select v, round(rank, 9) as rank from r where i = 50""",
)
def graph_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty rounds; without a number of rounds the operator goes on until the ranks settle."""
    return G.pagerank(_user_edges(spark, sf), 50).select("v", F.round("rank", 9).alias("rank"))


@query(
    "graph_within_hops",
    f"""with recursive e as (select src, dst from {_USER_EDGES}), r(v, h) as (select 1, 0 union select e.dst, h + 1 from r join e on e.src = r.v where h < 3) select cast(v as bigint) as v, min(h) as hops from r group by 1""",
)
def graph_within_hops(spark: SparkSession, sf: str) -> DataFrame:
    return G.within_hops(_user_edges(spark, sf), spark.createDataFrame([(1,)], "v bigint"), 3)


@query(
    "graph_cascade",
    f"""with recursive e as (select src, dst, cast(src % 5 + 1 as double) amount from {_USER_EDGES}), w(v, wave) using key (v) as (select 1::bigint, 0 union
select d.v, k.k from (select max(wave) + 1 k from recurring.w) k, (select e.dst v, sum(amount) loss from e join recurring.w f on f.v = e.src group by 1) d where d.loss > d.v % 40 and d.v not in (select v from recurring.w))
select v, wave from w""",
)
def graph_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Failures spread from user 1 over exposures weighted by events."""
    e = _user_edges(spark, sf).withColumn("amount", (F.col("src") % 5 + 1).cast("double"))
    v = e.select(F.col("dst").alias("v")).distinct().withColumn("buffer", (F.col("v") % 40).cast("double"))
    return G.cascade(e, v, spark.createDataFrame([(1,)], "v bigint"))


@query(
    "graph_timed_cycles",
    f"""with n as (select count(distinct user_id) n from events), e as (select user_id as src, (user_id * 7 + k * 13) % n as dst, epoch_us(ts) t from (select *, try_cast(json_extract_string(props, '$.k') as bigint) k from events), n where k is not null)
select x.src as a, y.src as b, z.src as c, x.t as t0, z.t as t1 from e x join e y on x.dst = y.src and y.t > x.t and y.t - x.t <= 43200000000 join e z on y.dst = z.src and z.dst = x.src and z.t > y.t and z.t - x.t <= 43200000000
where x.src <> x.dst and y.src <> y.dst and z.src <> z.dst and y.dst <> x.src""",
)
def graph_timed_cycles(spark: SparkSession, sf: str) -> DataFrame:
    c = G.timed_cycles(_user_steps(spark, sf), 3, 43200)
    return c.select(F.get("path", F.lit(0)).alias("a"), F.get("path", F.lit(1)).alias("b"), F.get("path", F.lit(2)).alias("c"), "t0", "t1")


@query(
    "graph_simple_cycles",
    f"""with e as (select distinct src, dst from {_USER_EDGES} where src <> dst) select a.src as a, a.dst as b, null::bigint as c from e a join e b on b.src = a.dst and b.dst = a.src where a.dst > a.src
union all select a.src, a.dst, b.dst from e a join e b on b.src = a.dst join e c on c.src = b.dst and c.dst = a.src where a.dst > a.src and b.dst > a.src and b.dst <> a.dst""",
)
def graph_simple_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Directed cycles of two and three users, each from its smallest."""
    c = G.simple_cycles(_user_edges(spark, sf), 3)
    return c.select(*[F.get("path", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query(
    "graph_lineage_impact",
    f"""with recursive e as (select distinct src, dst from {_USER_EDGES} where src < dst), r(v, d) as (select 0::bigint, 0 union select e.dst, r.d + 1 from r join e on e.src = r.v where r.d < 4) select v, min(d) as depth from r group by 1""",
)
def graph_lineage_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What a change of node 0 reaches downstream, with the fewest steps."""
    e = _user_edges(spark, sf).where("src < dst")
    return G.within_hops(e, spark.createDataFrame([(0,)], "v bigint"), 4).withColumnRenamed("hops", "depth")


@query(
    "graph_layered_chains",
    f"""with n as (select count(distinct user_id) n from events), e as (select user_id as src, (user_id * 7 + k * 13) % n as dst, epoch_us(ts) t from (select *, try_cast(json_extract_string(props, '$.k') as bigint) k from events), n where k is not null)
select x.src as a, y.src as b, z.src as c, z.dst as d, x.t as t0, z.t as t1 from e x join e y on x.dst = y.src and y.t > x.t and y.t - x.t <= 1800000000 join e z on y.dst = z.src and z.t > y.t and z.t - x.t <= 1800000000
where x.src <> x.dst and y.dst not in (x.src, y.src) and z.dst not in (x.src, y.src, z.src)""",
)
def graph_layered_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of three steps through different users within half an hour."""
    c = G.timed_cycles(_user_steps(spark, sf), 3, 1800, closed=False)
    return c.select(*[F.get("path", F.lit(i)).alias(n) for i, n in enumerate("abcd")], "t0", "t1")


@query(
    "join_cyclic_pattern",
    "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber join lineitem c on b.l_suppkey = c.l_suppkey and c.l_partkey = a.l_partkey",
)
def join_cyclic_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """A triangle query over three relations; counts are pushed below the closing join, so no wedge is kept."""
    li = load(spark, sf, "lineitem")
    wedge = li.select("l_orderkey", F.col("l_linenumber").alias("n1"), "l_partkey").join(li.select("l_orderkey", F.col("l_linenumber").alias("n2"), "l_suppkey"), "l_orderkey").where("n1 < n2")
    left = wedge.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("x"))
    right = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("y"))
    return left.join(right, ["l_partkey", "l_suppkey"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- provenance


@query("provenance_bag", "select n_regionkey, count(*) as derivations from nation join customer on n_nationkey = c_nationkey group by 1")
def provenance_bag(spark: SparkSession, sf: str) -> DataFrame:
    n = P.annotate(load(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("k")), F.lit(1))
    c = P.annotate(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), F.lit(1))
    return P.project(P.join(n, c, ["k"], P.BAG), ["n_regionkey"], P.BAG).withColumnRenamed("_k", "derivations")


@query("provenance_boolean", "select n_regionkey, bool_or(c_acctbal > 0 and n_nationkey % 2 = 0) as holds from nation join customer on n_nationkey = c_nationkey group by 1")
def provenance_boolean(spark: SparkSession, sf: str) -> DataFrame:
    n = P.annotate(load(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("k")), F.col("k") % 2 == 0)
    c = P.annotate(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), F.col("c_acctbal") > 0)
    return P.project(P.join(n, c, ["k"], P.BOOLEAN), ["n_regionkey"], P.BOOLEAN).withColumnRenamed("_k", "holds")


@query("provenance_cheapest", "select r_name, min(n_nationkey + r_regionkey) as cost from region join nation on r_regionkey = n_regionkey group by 1")
def provenance_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    r = P.annotate(load(spark, sf, "region").select("r_name", F.col("r_regionkey").alias("k")), F.col("k"))
    n = P.annotate(load(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey"), F.col("n_nationkey"))
    return P.project(P.join(r, n, ["k"], P.TROPICAL), ["r_name"], P.TROPICAL).withColumnRenamed("_k", "cost")


@query("provenance_why", "select r_name, list_sort(list('n' || n_nationkey || '+r' || r_regionkey)) as witnesses from region join nation on r_regionkey = n_regionkey group by 1")
def provenance_why(spark: SparkSession, sf: str) -> DataFrame:
    r = P.annotate(load(spark, sf, "region").select("r_name", F.col("r_regionkey").alias("k")), F.array(F.array(F.concat(F.lit("r"), F.col("k").cast("string")))))
    n = P.annotate(load(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey"), F.array(F.array(F.concat(F.lit("n"), "n_nationkey"))))
    p = P.project(P.join(r, n, ["k"], P.WHY), ["r_name"], P.WHY)
    return p.select("r_name", F.array_sort(F.transform("_k", lambda w: F.array_join(w, "+"))).alias("witnesses"))


@query("provenance_probability", "select n_regionkey, round(1 - exp(sum(ln(1 - (c_custkey % 10) / 1000.0))), 8) as p from nation join customer on n_nationkey = c_nationkey group by 1")
def provenance_probability(spark: SparkSession, sf: str) -> DataFrame:
    n = P.annotate(load(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("k")), F.lit(1.0))
    c = P.annotate(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), (F.col("c_custkey") % 10) / 1000.0)
    return P.project(P.join(n, c, ["k"], P.PROBABLE), ["n_regionkey"], P.PROBABLE).select("n_regionkey", F.round("_k", 8).alias("p"))


@query("provenance_polynomial", "select n_regionkey, count(*) || '*c' as polynomial from nation join customer on n_nationkey = c_nationkey group by 1")
def provenance_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    """How a row came about: every customer is one source c, so the derivations add up to a coefficient."""
    n = P.annotate(load(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("k")), P.token())
    c = P.annotate(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), P.token("c"))
    return P.project(P.join(n, c, ["k"], P.HOW), ["n_regionkey"], P.HOW).select("n_regionkey", P.polynomial(F.col("_k")).alias("polynomial"))


@query("provenance_union", "select k, sum(n)::bigint as derivations from (select s_nationkey k, count(*) n from supplier group by 1 union all select c_nationkey, count(*) from customer group by 1) group by 1")
def provenance_union(spark: SparkSession, sf: str) -> DataFrame:
    s = P.annotate(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), F.lit(1))
    c = P.annotate(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), F.lit(1))
    return P.union(s, c, P.BAG).withColumnRenamed("_k", "derivations")


# ---------------------------------------------------------------- sketches and samples


@query("sketch_distinct_within_bounds", "select l_returnflag, true as within from lineitem group by 1")
def sketch_distinct_within_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """States per flag and status merged per flag; the estimate must lie within 5 % of the exact count."""
    li = load(spark, sf, "lineitem")
    est = K.merge_distinct(K.distinct_sketch(li, ["l_returnflag", "l_linestatus"], "l_partkey"), ["l_returnflag"])
    exact = li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"))
    return est.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


def _slot_sql(x: str, depth: int, width: int) -> str:
    return "[" + ", ".join(f"{{'row': {i}, 'slot': ((({x}) % {K.PRIME}) * {2 * i * 7919 + 104729} + {i * 1299709 + 15485863}) % {K.PRIME} % {width}}}" for i in range(depth)) + "]"


def _draw_sql(x: str, seed: int) -> str:
    a = f"((({x})::bigint % {K.PRIME}) * 48271 + {seed}) % {K.PRIME}"
    b = f"(({a}) * ({a}) + 12345) % {K.PRIME}"
    return f"(((({b}) * 69621) % {K.PRIME}) + 0.5) / {K.PRIME}::double"


@query("sketch_count_estimates", f"""with c as (select s.row as r, s.slot as k, count(*) n from (select unnest({_slot_sql('l_partkey', 5, 2048)}) s from lineitem) group by 1, 2)
select l_partkey, min(n) as estimate from (select l_partkey, unnest({_slot_sql('l_partkey', 5, 2048)}) s from (select distinct l_partkey from lineitem)) join c on s.row = r and s.slot = k group by 1""")
def sketch_count_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Count-min over whole numbers, whose counters SQL can compute as well."""
    li = load(spark, sf, "lineitem")
    return K.count_min_estimate(K.count_min(li, "l_partkey", whole=True), li, "l_partkey", whole=True)


@query("heavy_hitters", "select user_id, count(*) as n from events group by 1 having count(*) >= 0.01 * (select count(*) from events)")
def heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    return K.heavy_hitters(load(spark, sf, "events"), "user_id", 0.01)


@query("sketch_quantiles_within_bounds", "select l_returnflag, true as q10, true as q50, true as q90 from lineitem group by 1")
def sketch_quantiles_within_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """KLL quantiles whose exact rank is within 3 % of the one asked for."""
    li = load(spark, sf, "lineitem")
    s = K.quantile_sketch(li, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    j = li.join(F.broadcast(s), "l_returnflag")  # a row per flag
    ranks = j.groupBy("l_returnflag").agg(*[F.avg((F.col("l_extendedprice") <= F.col(f"q{p}")).cast("double")).alias(f"q{p}") for p in (10, 50, 90)])
    return ranks.select("l_returnflag", *[(F.abs(F.col(f"q{p}") - p / 100) < 0.03).alias(f"q{p}") for p in (10, 50, 90)])


_DIGEST = """with v as (select {0} v, count(*) c from {1} where {0} is not null group by 1), r as (select *, sum(c) over (order by v) u, sum(c) over () t from v),
d as (select sum(v * c) / sum(c) as mean, sum(c) as weight from r group by floor(50 * (asin(2 * ((u - c / 2.0) / t) - 1) / pi() + 0.5)))"""


@query("digest_centroids", _DIGEST.format("l_extendedprice", "lineitem") + " select round(mean, 4) as mean, cast(weight as bigint) as weight from d")
def digest_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of prices: fine at both ends."""
    return K.centroid_digest(load(spark, sf, "lineitem"), "l_extendedprice", 100).select(F.round("mean", 4).alias("mean"), "weight")


@query("digest_merged_cdf", "select p as price, true as close from (values (2000.0), (20000.0), (45000.0), (90000.0)) t(p) where (select count(*) from lineitem) > 0")
def digest_merged_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Digests per return flag merged into one; its part below a price lies within 2 % of the exact one."""
    from functools import reduce

    li = load(spark, sf, "lineitem")
    parts = [K.centroid_digest(li.where(F.col("l_returnflag") == f), "l_extendedprice", 100) for f in ("A", "N", "R")]
    probes = spark.createDataFrame([(2000.0,), (20000.0,), (45000.0,), (90000.0,)], "price double")
    est = K.digest_cdf(K.merge_digests(reduce(DataFrame.unionByName, parts)), probes, "price")
    exact = li.agg(*[F.avg((F.col("l_extendedprice") <= p).cast("double")).alias(f"e{i}") for i, p in enumerate((2000.0, 20000.0, 45000.0, 90000.0))])
    e = F.element_at(F.create_map(*[x for i, p in enumerate((2000.0, 20000.0, 45000.0, 90000.0)) for x in (F.lit(p), F.col(f"e{i}"))]), F.col("price"))
    return est.join(F.broadcast(exact), F.lit(True)).select("price", (F.abs(F.col("cdf") - e) < 0.02).alias("close"))


@query("bloom_no_false_negatives", "select c_custkey, true as maybe from customer where c_custkey % 2 = 0")
def bloom_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every member is found; the odd keys, which are no members, are looked up as well and dropped where found by mistake."""
    c = load(spark, sf, "customer")
    b = K.bloom_bits(c.where("c_custkey % 2 = 0"), "c_custkey", 1 << 18)
    return K.bloom_maybe(c, "c_custkey", b, 1 << 18).where("c_custkey % 2 = 0").select("c_custkey", "maybe")


@query("bloom_counting_after_removal", f"""with s as (select c_custkey k, unnest(list_distinct(list_transform({_slot_sql('c_custkey', 4, 16384)}, lambda z: z.slot))) slot from customer),
b as (select slot, count(*) n from s where k % 3 <> 1 group by 1) select s.k as c_custkey, bool_and(coalesce(n, 0) > 0) as maybe from s left join b using (slot) group by 1""")
def bloom_counting_after_removal(spark: SparkSession, sf: str) -> DataFrame:
    """A counting filter of all customers, from which a third is removed by subtracting its counters."""
    c = load(spark, sf, "customer").select("c_custkey")
    whole, gone = K.counting_bloom(c, "c_custkey"), K.counting_bloom(c.where("c_custkey % 3 = 1"), "c_custkey")
    left = whole.unionByName(gone.withColumn("n", -F.col("n"))).groupBy("slot").agg(F.sum("n").alias("n"))
    return K.counting_bloom_maybe(c, "c_custkey", left)


@query("sample_reservoir", f"select o_orderkey from orders order by {_draw_sql('o_orderkey', 7)} desc, o_orderkey limit 100")
def sample_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return K.reservoir(load(spark, sf, "orders").select("o_orderkey"), 100, 7, "o_orderkey", draw=K.whole_draw(F.col("o_orderkey"), 7))


@query("sample_weighted", f"select o_orderkey from orders order by ln({_draw_sql('o_orderkey', 3)}) / (o_totalprice * o_totalprice) desc, o_orderkey limit 50")
def sample_weighted(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return K.reservoir(o, 50, 3, "o_orderkey", F.col("o_totalprice") * F.col("o_totalprice"), K.whole_draw(F.col("o_orderkey"), 3)).select("o_orderkey")


@query(
    "approximate_total",
    f"""with s as (select o_totalprice / 0.2 wx from orders where {_draw_sql('o_orderkey', 11)} < 0.2), a as (select count(*) / 0.2 n, sum(wx) e, sqrt(sum(wx * wx * 0.8)) se from s)
select round(n, 4) as n_estimate, round(e, 2) as estimate, round(e - 1.96 * se, 2) as lo, round(e + 1.96 * se, 2) as hi from a""",
)
def approximate_total(spark: SparkSession, sf: str) -> DataFrame:
    e = K.sampled_total(load(spark, sf, "orders"), "o_totalprice", 0.2, "o_orderkey", 11, draw=K.whole_draw(F.col("o_orderkey"), 11))
    return e.select(F.round("n_estimate", 4).alias("n_estimate"), *[F.round(c, 2).alias(c) for c in ("estimate", "lo", "hi")])


@query(
    "coreset_by_sensitivity",
    f"""select o_orderkey, round(1 / p, 8) as w from (select *, least(1.0, 2000 * abs(o_totalprice) / (select sum(abs(o_totalprice)) from orders)) p from orders) where p > 0 and {_draw_sql('o_orderkey', 5)} < p""",
)
def coreset_by_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    c = K.sensitivity_coreset(load(spark, sf, "orders"), "o_totalprice", 2000, 5, "o_orderkey", draw=K.whole_draw(F.col("o_orderkey"), 5))
    return c.select("o_orderkey", F.round("w", 8).alias("w"))


@query(
    "private_counts",
    f"""select o_orderpriority, round(n + case when u < 0 then 1 else -1 end * ln(1 - 2 * abs(u)) / 0.5, 6) as noisy from (select *, {_draw_sql("ascii(o_orderpriority) * 7919", 1)} - 0.5 u from (select o_orderpriority, count(*) n from orders group by 1))""",
)
def private_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Laplace noise at epsilon 0.5, drawn from the key so that a check can draw it as well."""
    noisy = K.noisy_counts(load(spark, sf, "orders"), ["o_orderpriority"], 0.5, 1, draw=K.whole_draw((F.ascii("o_orderpriority") * 7919).cast("bigint"), 1))
    return noisy.select("o_orderpriority", F.round("noisy", 6).alias("noisy"))


@query(
    "private_answers",
    f"""with a as (select e, case when u < p then t else 1 - t end r from (select o_orderkey, (o_orderstatus = 'F')::int t, exp(1.0) / (exp(1.0) + 1) p, exp(1.0) e, {_draw_sql('o_orderkey', 2)} u from orders)) select count(*) as n, round((sum(r) - count(*) / (any_value(e) + 1)) / ((any_value(e) - 1) / (any_value(e) + 1)), 6) as estimate from a""",
)
def private_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Randomised response at epsilon 1: each row tells the truth with probability e / (e + 1); the estimate takes the bias out."""
    return K.randomised_response(load(spark, sf, "orders"), F.col("o_orderstatus") == "F", 1.0, K.whole_draw(F.col("o_orderkey"), 2)).select("n", F.round("estimate", 6).alias("estimate"))


@query(
    "budget_ledger",
    """with recursive e as (select user_id, ts, event_id, case event_type when 'purchase' then 0.5 else 0.1 end::double eps, row_number() over (partition by user_id order by ts, event_id) r from events),
l as (select user_id, r, eps <= 1 as ok, case when eps <= 1 then eps else 0 end::double spent from e where r = 1 union all
select e.user_id, e.r, l.spent + e.eps <= 1 + 1e-12, case when l.spent + e.eps <= 1 + 1e-12 then l.spent + e.eps else l.spent end from l join e on e.user_id = l.user_id and e.r = l.r + 1)
select user_id, event_id, eps as epsilon, ok as accepted, round(spent, 9) as spent from l join e using (user_id, r)""",
)
def budget_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events ask for a tenth of the budget, purchases for half of it."""
    e = load(spark, sf, "events").withColumn("eps", F.when(F.col("event_type") == "purchase", 0.5).otherwise(0.1))
    return K.budget_ledger(e, "user_id", ["ts", "event_id"], "eps", 1.0).select("user_id", "event_id", "epsilon", "accepted", "spent")


@query(
    "budget_renyi",
    """with a(alpha) as (values (2.0), (4.0), (8.0), (16.0), (32.0)), l as (select user_id, alpha, sum(alpha * power(case event_type when 'purchase' then 2 else 1 end, 2) / (2 * 400)) l from events, a group by 1, 2)
select user_id, round(min(l + ln(1 / 1e-5) / (alpha - 1)), 8) as epsilon from l group by 1""",
)
def budget_renyi(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian answers (sigma 20, sensitivity 1 or 2) composed over Renyi orders, as one epsilon per user."""
    orders = [2.0, 4.0, 8.0, 16.0, 32.0]
    one, two = (dict(zip(orders, K.gaussian_loss(x, 20.0, orders))) for x in (1.0, 2.0))
    cells = F.array(*[F.struct(F.lit(a).alias("alpha"), F.when(F.col("event_type") == "purchase", two[a]).otherwise(one[a]).alias("loss")) for a in orders])
    e = load(spark, sf, "events").select("user_id", F.inline(cells))
    return K.renyi_epsilon(e, "user_id", 1e-5).select("user_id", F.round("epsilon", 8).alias("epsilon"))


# ---------------------------------------------------------------- sequences

#: Two views, then a click within two days, then a purchase within four.
VIEWED_THEN_BOUGHT = [S.Step("view", 2, 2 * 86400 * 1_000_000), S.Step("click", 1, 2 * 86400 * 1_000_000), S.Step("purchase", 1, 4 * 86400 * 1_000_000)]


@query(
    "sequence_matches",
    """with recursive e as (select user_id, epoch_us(ts) t, event_type k, row_number() over (partition by user_id order by ts, event_id) r from events where ts is not null and user_id is not null),
m(user_id, r, step, seen, f, l, hit) as (select user_id, 0::bigint, 0, 0, 0::bigint, 0::bigint, false from (select distinct user_id from e) union all
select user_id, r, case when gone then 0 when fits and full_ then (step + 1) % 3 else step end, case when gone then 0 when fits then case when full_ then 0 else seen + 1 end else seen end,
case when fits and step = 0 and seen = 0 then t else f end, case when fits then t else l end, fits and full_ and step = 2
from (select *, not gone and k = ['view', 'click', 'purchase'][step + 1] and not ((step > 0 or seen > 0) and t - l > [2, 2, 4][step + 1] * 86400000000) fits, seen + 1 >= [2, 1, 1][step + 1] full_
from (select m.*exclude(r), e.r, e.t, e.k, m.step > 0 and e.t - m.f > 864000000000 gone from m join e on e.user_id = m.user_id and e.r = m.r + 1)))
select user_id, f as first_us, l as last_us from m where hit""",
)
def sequence_matches(spark: SparkSession, sf: str) -> DataFrame:
    return S.matches(load(spark, sf, "events"), "user_id", "ts", "event_type", "value", "event_id", VIEWED_THEN_BOUGHT, 10 * 86400)


@query(
    "hash_chain",
    """with recursive e as (select user_id, event_id, event_type || ':' || event_id c, row_number() over (partition by user_id order by event_id) r from events),
h as (select user_id, event_id, r, sha256(c) link from e where r = 1 union all select e.user_id, e.event_id, e.r, sha256(h.link || e.c) from h join e on e.user_id = h.user_id and e.r = h.r + 1) select user_id, event_id, link from h""",
)
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("c", F.concat_ws(":", "event_type", "event_id"))
    return S.hash_chain(e, "user_id", ["event_id"], "c")


@query("replay_is_deterministic", "select 0 as n_differences from (select 1)")
def replay_is_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    run = lambda d: d.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"), F.count(F.lit(1)).alias("n"))
    return S.replay_differs(run(e), run(e.repartition(7, "event_id"))).agg(F.count(F.lit(1)).cast("int").alias("n_differences"))


# ---------------------------------------------------------------- layout


@query(
    "layout_z_order",
    "select l_orderkey, l_linenumber, " + " + ".join(f"(((cast(floor((l_quantity - 0) / 51.0 * 15) as bigint) >> {b}) & 1) << {2 * b}) + (((cast(floor(l_discount / 0.2 * 15) as bigint) >> {b}) & 1) << {2 * b + 1})" for b in range(4)) + " as z from lineitem",
)
def layout_z_order(spark: SparkSession, sf: str) -> DataFrame:
    z = L.z_value([L.scaled("l_quantity", 0, 51, 4), L.scaled("l_discount", 0, 0.2, 4)], 4)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"))


@query(
    "layout_hilbert",
    """with recursive s as (select row_number() over () id, l_orderkey, l_linenumber, l_quantity, l_discount, least(greatest(floor(l_quantity / 51.0 * 63), 0), 63)::bigint x, least(greatest(floor(l_discount / 0.2 * 63), 0), 63)::bigint y from lineitem),
h(id, cx, cy, d, k) as (select id, x, y, 0::bigint, 5 from s union all
select id, case when ry = 0 then ly else lx end, case when ry = 0 then lx else ly end, d + xor(3 * rx, ry) * (1 << (2 * k)), k - 1
from (select *, case when ry = 0 and rx = 1 then top - (cx & top) else cx & top end lx, case when ry = 0 and rx = 1 then top - (cy & top) else cy & top end ly from (select *, (cx >> k) & 1 rx, (cy >> k) & 1 ry, (1 << k) - 1 top from h where k >= 0)))
select l_orderkey, l_linenumber, l_quantity, l_discount, d as curve from h join s using (id) where k = -1""",
)
def layout_hilbert(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return L.hilbert_ordered(li, L.scaled("l_quantity", 0, 51, 6), L.scaled("l_discount", 0, 0.2, 6), 6)


@query("layout_skew", "select sum(n)::bigint as n_rows, count(*) as n_keys, round(max(n) / sum(n), 8) as top_share, greatest(1, cast(ceil(max(n) / greatest(1, floor(sum(n) / 200))) as bigint)) as salts from (select count(*) n from sample_events group by msg_key)")
def layout_skew(spark: SparkSession, sf: str) -> DataFrame:
    return L.skew_report(load(spark, sf, "sample_events"), "msg_key")


@query("layout_salted_sum", "select user_id, sum(event_id)::bigint as total from events group by 1")
def layout_salted_sum(spark: SparkSession, sf: str) -> DataFrame:
    return L.salted_sum(load(spark, sf, "events"), ["user_id"], "event_id", 16, "event_id")


@query(
    "layout_ring_owners",
    """with r as (select ('0x' || substr(sha256('n' || n || '/' || i), 1, 15))::bigint p, 'n' || n as owner from range(1, 5) a(n), range(64) b(i)), k as (select ('0x' || substr(sha256(c_custkey::varchar), 1, 15))::bigint h from customer)
select coalesce(r.owner, (select arg_min(owner, p) from r)) as owner, count(*) as n from k asof left join r on k.h <= r.p group by 1""",
)
def layout_ring_owners(spark: SparkSession, sf: str) -> DataFrame:
    return L.ring_owner(load(spark, sf, "customer").select("c_custkey"), "c_custkey", ["n1", "n2", "n3", "n4"]).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query(
    "layout_compaction_plan",
    """with f as (select source || '' as partition, path, n_chars as bytes from documents where n_chars < 4000 and source is not null and path is not null), c as (select *, sum(bytes) over (partition by partition order by path rows unbounded preceding) c from f)
select partition, cast(floor((c - 1) / 4000.0) as bigint) as group_no, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from c group by 1, 2 having count(*) > 1""",
)
def layout_compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "documents").where("source is not null and path is not null").select(F.col("source").alias("partition"), "path", F.col("n_chars").alias("bytes"))
    return L.compaction_plan(f, 4000)


@query(
    "vector_top_k",
    """select query_id, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) r from (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as cosine
from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)) where r <= 5""",
)
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors by cosine of every hundredth vector against all."""
    e = load(spark, sf, "embeddings")
    return L.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
