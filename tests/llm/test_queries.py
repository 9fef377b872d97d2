"""The subpackage's queries run on the smallest tables, with token counts as the library gives them."""

import os

import pytest

import __spark_entry__ as entry
from quern.llm import tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith(("p3_", "p8_", "p9_", "p10_"))))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_token_sizes(spark):
    texts = ["", None, "Khi hàng đợi đầy", "a <|endoftext|> b", "x" * 50_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "z", "k")], "doc_id bigint, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(df, ["doc_id"]).collect()}
    assert got == {i: tokens.count_tokens(t) for i, t in enumerate(texts)} and got[0] == got[1] == 0
