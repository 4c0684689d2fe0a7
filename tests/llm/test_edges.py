"""Every query of this subpackage on empty tables, and rows that are repeated whole."""

import pytest
from pyspark.sql import functions as F

from pastframe.llm import bpe, weak_quality
from pastframe.llm.queries import queries, vocabulary_path

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """The given tables without their rows."""
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    got = queries()[name](spark, empty)
    assert got.columns and got.count() == 0


def test_rows_repeated_whole_are_each_encoded(spark):
    df = spark.createDataFrame([(1, "Twice, ok"), (1, "Twice, ok"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit("old"))
    rows = bpe.encode_decode(df, vocabulary_path()).collect()
    assert len(rows) == 3 and rows[0].ids == rows[1].ids != rows[2].ids == [] and rows[0].decoded == rows[1].decoded


def test_long_words_have_whole_shapes():
    assert weak_quality.shape("a" * 100 + "7") == "xd"


def test_levels_of_short_conversations_go_many_at_a_time(spark):
    from pastframe.llm import tool_calls

    data = [(c, f"k{i}", i, [f"k{i - 1}", "gone"] if i else (["k4"] if c == 3 else [])) for c in range(8) for i in range(2 + c)]
    calls = spark.createDataFrame(data, "conv_id long, call_id string, turn int, depends_on array<string>")
    told = lambda df: sorted(map(tuple, df.collect()))
    got = tool_calls._levels(calls)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(c, f"k{i}", i, i) for c in range(8) if c != 3 for i in range(2 + c)]  # in conversation 3 calls wait for each other
    assert told(got) == want == told(tool_calls._levels(calls, 12)) == told(tool_calls._levels(calls, 4))
