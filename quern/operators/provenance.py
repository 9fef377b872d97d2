"""Relational algebra over annotated rows: the annotation column ``_k`` follows a semiring."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_VALUES = "map<string,bigint>"


@dataclass(frozen=True)
class Semiring:
    """How alternatives add up (over a group) and joint use multiplies."""

    name: str
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]


def _why_times(a: Column, b: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_union(x, y))))))


BOOLEAN = Semiring("boolean", F.bool_or, lambda a, b: a & b)
BAG = Semiring("bag", F.sum, lambda a, b: a * b)
TROPICAL = Semiring("tropical", F.min, lambda a, b: a + b)
#: Witness sets: each way a row came about, as the set of rows it used.
WHY = Semiring("why", lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))), _why_times)
#: Independent alternatives; computed through logarithms.
PROBABLE = Semiring("probable", lambda k: 1 - F.exp(F.sum(F.log(F.greatest(1 - k, F.lit(1e-300))))), lambda a, b: a * b)


def token(*names: str) -> Column:
    """The polynomial of one monomial with coefficient one: a map from sorted token names to a count."""
    return F.create_map(F.lit("*".join(sorted(names))), F.lit(1).cast("bigint"))


def _how_plus(k: Column) -> Column:
    # monomials are as many as there are different ones in the group; equal ones are added up while the lists are merged
    flat = F.flatten(F.collect_list(F.map_entries(k)))
    return F.aggregate(flat, F.create_map().cast(_VALUES), lambda acc, e: F.map_zip_with(acc, F.map_from_entries(F.array(e)), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def _how_times(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(F.map_entries(a), lambda x: F.transform(F.map_entries(b), lambda y: F.struct(F.array_join(F.array_sort(F.filter(F.concat(F.split(x["key"], "[*]"), F.split(y["key"], "[*]")), lambda t: t != "")), "*").alias("key"), (x["value"] * y["value"]).alias("value")))))
    return F.aggregate(pairs, F.create_map().cast(_VALUES), lambda acc, e: F.map_zip_with(acc, F.map_from_entries(F.array(e)), lambda _, p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))))


#: Polynomials N[X]: how often each combination of sources derives a row.
HOW = Semiring("how", _how_plus, _how_times)


def polynomial(k: Column) -> Column:
    """A polynomial as text, monomials in order: 2*a*b + c."""
    one = F.transform(F.array_sort(F.map_entries(k)), lambda e: F.when(e["key"] == "", e["value"].cast("string")).otherwise(F.concat(e["value"].cast("string"), F.lit("*"), e["key"])))
    return F.array_join(one, " + ")


def annotate(df: DataFrame, k: Column) -> DataFrame:
    return df.withColumn("_k", k)


def project(df: DataFrame, columns: list[str], s: Semiring) -> DataFrame:
    """Equal rows become one, their annotations added."""
    if s is HOW:  # coefficients of equal monomials add up before the shuffle; only then is a group a map
        m = df.select(*columns, F.explode(F.map_entries("_k")).alias("_m")).groupBy(*columns, F.col("_m.key").alias("_t")).agg(F.sum("_m.value").alias("_n"))
        return m.groupBy(*columns).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_n"))).alias("_k"))
    return df.groupBy(*columns).agg(s.plus(F.col("_k")).alias("_k"))


def join(a: DataFrame, b: DataFrame, on: list[str], s: Semiring) -> DataFrame:
    j = a.withColumnRenamed("_k", "_ka").join(b.withColumnRenamed("_k", "_kb"), on)
    return j.withColumn("_k", s.times(F.col("_ka"), F.col("_kb"))).drop("_ka", "_kb")


def union(a: DataFrame, b: DataFrame, s: Semiring) -> DataFrame:
    cols = [c for c in a.columns if c != "_k"]
    return project(a.unionByName(b), cols, s)


def exact_probability(df: DataFrame, witnesses: str, prob: dict[str, float]) -> DataFrame:
    """Adds ``p``: the probability that some witness holds, by inclusion and exclusion over independent tokens."""

    @F.pandas_udf("double")
    def p(ws: pd.Series) -> pd.Series:
        def one(sets) -> float:
            sets = [frozenset(x) for x in sets]
            total = 0.0
            for r in range(1, len(sets) + 1):
                for c in itertools.combinations(sets, r):
                    q = 1.0
                    for t in frozenset().union(*c):
                        q *= prob.get(t, 0.0)
                    total += (-1) ** (r + 1) * q
            return total

        return ws.map(one)

    return df.withColumn("p", p(witnesses))
