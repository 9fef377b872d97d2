import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.plans.runtime import session

    # generated code costs more to compile than it saves on small tables; QUERN_TEST_CODEGEN=1 tests it as it ships
    plain = {} if os.environ.get("QUERN_TEST_CODEGEN") else {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    s = session("tests", "local[4]", **plain, **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a DataFrame as tuples; None sorts first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))


#: Names that operators use inside; tables get extra columns of these names.
CLASHING = ["row_id", "table_name", "verdict", "period_start", "key", "n", "size", "rec", "words", "weight", "repeats", "is_spam", "ratio", "city_key", "_on", "_live", "last_pos", "_fp_n", "value"]


@pytest.fixture(scope="session")
def variants(spark, tmp_path_factory):
    """Copies of the smallest tables: empty, with a row of nulls and clashing extra columns, and with every row twice."""
    import glob

    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("variants")
    for f in sorted(glob.glob("/root/testdata/sf0.001/*.parquet")):
        name = os.path.basename(f)
        df = spark.read.parquet(f)
        nulls = df.limit(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema])
        odd = df.unionByName(nulls).withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
        for kind, d in (("empty", df.limit(0)), ("odd", odd), ("twice", df.unionByName(df))):
            d.coalesce(1).write.parquet(str(root / kind / name))
    return str(root)
