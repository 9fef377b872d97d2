"""A data source for line-oriented JSON stores whose reader answers pushed equality and range filters."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_OPS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.pushed = schema, options["path"], []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in _OPS:
                self.pushed.append((f.attribute[0], type(f), f.value))
            else:
                yield f  # Spark applies what isn't taken

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if x.endswith(".json"))
        return [InputPartition(x) for x in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = self.schema.names
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                if all(r.get(c) is not None and _OPS[op](r[c], v) for c, op, v in self.pushed):
                    yield tuple(r.get(n) for n in names)


class JsonLines(DataSource):
    """``spark.read.format("json_lines").schema(...).load(path)`` after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)
