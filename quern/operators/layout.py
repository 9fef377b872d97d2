"""Data layout: space-filling curves, partitioners, skew and compaction advice, row-group pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.ordering import range_sorted, with_running
from ..plans.runtime import scratch


def scaled(c: str, lo: float, hi: float, bits: int) -> Column:
    """A column as an integer of so many bits over [lo, hi]."""
    return F.least(F.greatest(F.floor((F.col(c).cast("double") - lo) / max(hi - lo, 1e-300) * ((1 << bits) - 1)), F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")


def z_value(columns: list[Column], bits: int) -> Column:
    """Interleaved bits: a Morton number, as a native expression."""
    z = F.lit(0).cast("bigint")
    n = len(columns)
    for b in range(bits):
        for i, c in enumerate(columns):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint")), b * n + i))
    return z


def z_ordered(df: DataFrame, columns: dict[str, tuple[float, float]], bits: int = 10, partitions: int = 8) -> DataFrame:
    """Rows range-partitioned and sorted along the curve, so each file covers a small box."""
    z = z_value([scaled(c, lo, hi, bits) for c, (lo, hi) in columns.items()], bits)
    return df.withColumn("_z", z).repartitionByRange(partitions, "_z").sortWithinPartitions("_z").drop("_z")


def hilbert_ordered(df: DataFrame, x: Column, y: Column, bits: int = 8) -> DataFrame:
    """Adds ``curve``, the place on a Hilbert curve of side 2 ** bits; in numpy batches, because nested expressions would double with every bit."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cx, cy, d = b["_x"].to_numpy("int64"), b["_y"].to_numpy("int64"), 0
            for k in range(bits - 1, -1, -1):
                rx, ry = (cx >> k) & 1, (cy >> k) & 1
                d = d + ((3 * rx) ^ ry) * (1 << (2 * k))
                top = (1 << k) - 1
                flip = (ry == 0) & (rx == 1)
                lx, ly = np.where(flip, top - (cx & top), cx & top), np.where(flip, top - (cy & top), cy & top)
                cx, cy = np.where(ry == 0, ly, lx), np.where(ry == 0, lx, ly)
            yield b.drop(columns=["_x", "_y"]).assign(curve=d)

    src = df.withColumn("_x", x.cast("bigint")).withColumn("_y", y.cast("bigint"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return src.mapInPandas(place, f"{names}, curve bigint")


def hash_bucket(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n))


def ring_owner(df: DataFrame, c: str, nodes: list[str], points: int = 64) -> DataFrame:
    """Adds ``owner`` by consistent hashing: the first ring point at or after the key's hash.

    The ring has nodes * points entries, a setting; a key is looked up in a sorted array.
    """
    ring = sorted((int(hashlib.sha256(f"{n}/{i}".encode()).hexdigest()[:15], 16), n) for n in nodes for i in range(points))
    at, who = F.array(*[F.lit(p) for p, _ in ring]), F.array(*[F.lit(n) for _, n in ring])
    h = F.conv(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    # array_position of the first point not below the hash, through a filter that stays in the JVM
    k = F.size(F.filter(at, lambda p: p < h))
    return df.withColumn("owner", F.get(who, k % len(ring)))


def skew_report(df: DataFrame, c: str) -> DataFrame:
    """Rows, distinct keys, the largest key's share, and salts that bring it to the mean of a task of ``n / 200`` rows."""
    g = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    a = g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"))
    return a.select("n_rows", "n_keys", F.round(F.col("largest") / F.col("n_rows"), 8).alias("top_share"), F.greatest(F.lit(1), F.ceil(F.col("largest") / F.greatest(F.lit(1), F.floor(F.col("n_rows") / 200)))).cast("bigint").alias("salts"))


def salted_sum(df: DataFrame, keys: list[str], value: str, salts: int, row_id: str) -> DataFrame:
    """A sum in two levels, for engines or aggregates that can't combine before the shuffle."""
    part = df.groupBy(*keys, F.pmod(F.xxhash64(row_id), F.lit(salts)).alias("_salt")).agg(F.sum(value).alias("_s"))
    return part.groupBy(*keys).agg(F.sum("_s").alias("total"))


def compaction_plan(files: DataFrame, target_bytes: int) -> DataFrame:
    """Small files of a partition put into rewrite groups of about the target size, in file order: partition, group_no, n_files, bytes.

    ``files`` has partition, path, bytes. Files at or above the target stay.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("partition").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    s = files.where(F.col("bytes") < target_bytes).withColumn("_c", F.sum("bytes").over(w))
    g = s.groupBy("partition", F.floor((F.col("_c") - 1) / target_bytes).alias("group_no")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
    return g.where("n_files > 1")


def prunable(stats: DataFrame, lo, hi) -> DataFrame:
    """Row groups a range predicate can skip, from their min, max and null count."""
    return stats.withColumn("skip", F.col("min_value").isNull() | (F.col("max_value") < lo) | (F.col("min_value") > hi))


def nearest(base: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(query_id, row_id, cosine): the k nearest rows of each query by cosine, to six digits, ties by id; the query itself is left out.

    Queries are taken in blocks of at most ``block`` vectors, so what is sent to the tasks is bounded; each
    Arrow batch of the base is held against a block by one matrix product and gives its k best per query only.
    A block is one pass over the base; blocks are formed by a range sort of ids.
    """
    spark = base.sparkSession
    n = queries.count()
    q = with_running(range_sorted(queries.select(F.col(row_id).alias("_q"), F.col(vector).alias("_v"), F.lit(1).alias("_one")), [F.col("_q")]), {"_n": "_one"}) if n else queries
    kind = dict(base.dtypes)[row_id]
    schema = f"query_id {kind}, `{row_id}` {kind}, cosine double"
    out = scratch(spark, "nearest")
    for b in range(-(-n // block)):
        rows = q.where(F.col("_n").between(b * block + 1, (b + 1) * block)).select("_q", "_v").collect()  # at most ``block``
        ids = np.array([r["_q"] for r in rows])
        m = np.array([r["_v"] for r in rows], dtype="float64")
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((ids, m))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for x in batches:
                if not len(x):
                    continue
                v = np.array(x[vector].tolist(), dtype="float64")
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own = x[row_id].to_numpy()
                score = np.round(m @ v.T, 6)
                score[ids[:, None] == own[None, :]] = -np.inf
                for i, s in zip(ids, score):
                    top = np.lexsort((own, -s))[:k]
                    top = top[np.isfinite(s[top])]
                    yield pd.DataFrame({"query_id": i, row_id: own[top], "cosine": s[top]})

        near = base.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(row_id, vector).mapInPandas(best, schema)
        w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), row_id)
        near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").write.mode("append").parquet(out)
        sent.unpersist()
    return spark.read.schema(schema).parquet(out) if n else spark.createDataFrame([], schema)


def file_stats(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, min_value, max_value, n) of a column per data file: a manifest, made by a scan of that column alone."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), F.count(F.lit(1)).alias("n"))


def files_in_range(spark: SparkSession, path: str, column: str, lo: str | None, hi: str | None) -> list[str]:
    """Files that may hold values between two bounds; as many as the planner lists anyway."""
    s = file_stats(spark, path, column)
    kind = dict(s.dtypes)["min_value"]
    low = F.col("max_value") if lo is None else F.lit(lo).cast(kind)
    high = F.col("min_value") if hi is None else F.lit(hi).cast(kind)
    return [r["file"] for r in prunable(s, low, high).where("not skip").select("file").collect()]


def quantile_scores(df: DataFrame, columns: dict[str, str], parts: int) -> DataFrame:
    """Adds for each column a score from 1 to ``parts`` by the part of all rows at or below its value.

    Ranks come from a range sort of the distinct values; nulls get no score.
    """
    out = df
    for c, name in columns.items():
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        d = with_running(range_sorted(counts, [F.col("_v")]), {"_le": "_n"})
        total = F.broadcast(d.agg(F.max("_le").alias("_t")))  # one row
        # in whole numbers, so that a share on a boundary falls where it should
        score = F.least(F.lit(parts), F.greatest(F.lit(1), F.ceil(F.col("_le") * parts / F.col("_t")))).cast("int")
        out = out.join(d.join(total, F.lit(True)).select("_v", score.alias(name)), F.col(c) == F.col("_v"), "left").drop("_v")
    return out
