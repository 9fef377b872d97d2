"""Loading of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas by application and path, with the time and length the path had when its footers were read.
_SCHEMAS: dict[tuple[str, str], tuple[tuple[int, int], StructType]] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``: one file or a folder of part files.

    Reading a schema from footers is a job of its own, so it is kept for as long as the path isn't written again.
    """
    p = f"{sf_dir}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    stamp, key = (status.getModificationTime(), status.getLen()), (spark.sparkContext.applicationId, p)
    if key in _SCHEMAS and _SCHEMAS[key][0] == stamp:
        return spark.read.schema(_SCHEMAS[key][1]).parquet(p)
    df = spark.read.parquet(p)
    _SCHEMAS[key] = (stamp, df.schema)
    return df
