"""A catalog of the Parquet tables of a folder, and SQL text over it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import load


def tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the tables in a folder, on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL text; the tables it may name are bound as arguments, so sessions share no views."""
    used = {t: load(spark, sf_dir, t) for t in tables(spark, sf_dir) if re.search(rf"\b{t}\b", text)}
    bound = text
    for t in sorted(used, key=len, reverse=True):
        bound = re.sub(rf"(?<=[\s,(]){t}(?=[\s,)]|$)", "{" + t + "}", bound)
    return spark.sql(bound, **used)
