"""File formats, landing manifests, dead letters and log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, overwrite_partitions: bool = False, **options: str) -> None:
    """Write a table; with ``overwrite_partitions`` only the partitions in ``df`` are replaced."""
    w = df.write.format(fmt).options(**options).mode("overwrite")
    if overwrite_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def sniff_delimiter(spark: SparkSession, path: str, candidates: str = ",;|\t") -> str:
    """The mark that splits the first lines most evenly; reads 50 lines."""
    lines = [r[0] for r in spark.read.text(path).limit(50).collect() if r[0]]
    score = {c: (min((x.count(c) for x in lines), default=0), -len({x.count(c) for x in lines})) for c in candidates}
    return max(candidates, key=lambda c: score[c])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with header; the delimiter is sniffed, types are inferred unless a schema is given; bad rows keep their text in ``_corrupt``."""
    return read(spark, path, "csv", schema, sep=sniff_delimiter(spark, path), header="true", inferSchema=str(schema is None).lower(), mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down, and reads are split by a numeric column."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def unseen(listed: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Landed files or records whose key (path, size, checksum) the manifest doesn't have yet."""
    return listed.dropDuplicates(key).join(manifest.select(*key), key, "left_anti")


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with the first reason that failed."""
    why = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        why = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(why)
    d = df.withColumn("reason", why)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def with_retry(letters: DataFrame, attempts: str, most: int, base_seconds: int, failed_at: str) -> DataFrame:
    """Adds ``verdict`` (retry or give_up) and ``retry_at``, which backs off by powers of two."""
    again = F.col(attempts) < most
    wait = F.lit(base_seconds) * F.pow(F.lit(2), F.col(attempts))
    at = F.timestamp_micros(F.unix_micros(F.col(failed_at).cast("timestamp")) + (wait * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    return letters.withColumn("verdict", F.when(again, "retry").otherwise("give_up")).withColumn("retry_at", F.when(again, at))


def replay(log: DataFrame, offset: str, time: str, from_offset: int | None = None, from_time: str | None = None, until: str | None = None) -> DataFrame:
    """The part of a log from an offset or a time on, up to a time (exclusive)."""
    out = log
    if from_offset is not None:
        out = out.where(F.col(offset) >= from_offset)
    if from_time is not None:
        out = out.where(F.col(time) >= F.lit(from_time).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col(time) < F.lit(until).cast("timestamp_ntz"))
    return out


def read_bar_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text files without a header whose fields end in a bar, as benchmark generators write them."""
    return spark.read.schema(f"{schema}, _end string").option("sep", "|").option("header", "false").csv(path).drop("_end")


def write_bar_separated(df: DataFrame, path: str) -> None:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat(F.concat_ws("|", *cells), F.lit("|"))).write.text(path)


def with_rescued(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of JSON objects read by a schema: its fields, and in ``_rescued`` whatever the schema doesn't have, as text by name.

    A text that is no object gives nulls, with itself under the name ``_corrupt``.
    """
    names = [f.split()[0] for f in schema.split(",")]
    every = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    known = F.from_json(column, schema)
    rest = F.map_filter(every, lambda k, v: ~k.isin(*names))
    rescued = F.when(F.col(column).isNull(), None).when(every.isNull(), F.create_map(F.lit("_corrupt"), F.col(column))).otherwise(rest)
    return df.withColumn("_known", known).withColumn("_rescued", rescued).select(*[c for c in df.columns if c != column], "_known.*", "_rescued")


def generated_lines(spark: SparkSession, n: int, parts: int = 8) -> DataFrame:
    """``n`` made-up order lines (id, order_no, quantity, price, day), by arithmetic on their number: the same for any cut."""
    i = F.col("id")
    quantity = (i * 7919 + 13) % 50 + 1
    price = ((i * 104729 + 7) % 100_000) / 100
    return spark.range(0, n, 1, parts).select("id", F.floor(i / 4).alias("order_no"), quantity.alias("quantity"), price.alias("price"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 366).cast("int")).alias("day"))
