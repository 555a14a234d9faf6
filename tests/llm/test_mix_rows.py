"""The mix by rows: rows without an id and rows that share one are drawn each for itself."""

from collections import Counter

import pytest

from millrace.llm import mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, _times int")


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_stay_near_the_target(spark, doc_id):
    """2,400 words of rows of one id (or none) against a source of small weight: its target is 1,600 of 4,800 words."""
    rows = [(doc_id, f"w{i} " * 20, "b", "x", i) for i in range(120)] + [(1000 + i, f"v{i} " * 20, "a", "y", 1) for i in range(120)]
    weights = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 2400), ("b", 2400)], "source string, source_size long")).collect()}
    df = _docs(spark, rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    took = Counter()
    for r in out.collect():
        took[r.source] += len(r.text.split())
    assert all(abs(took[s] - weights[s]) <= 20 for s in weights), took
    per_row = Counter(tuple(r) for r in out.collect())
    assert max(per_row.values()) <= 3 and set(per_row) <= set(rows)


def test_equal_rows_are_taken_as_often_as_their_sum(spark):
    rows = [(5, "same words here", "a", "x", 1)] * 50 + [(6, "others stand there", "b", "x", 1)] * 50
    df = _docs(spark, rows)
    taken = {r.doc_id: r.n for r in mixing.mixed(df).groupBy("doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    got = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert {k: 3 * v for k, v in got.items()} == {k: v for k, v in taken.items() if v}
    assert sorted(mixing.mix(df).collect()) == sorted(mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_columns_of_any_type(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'a b c' AS text, 's' AS source, map('k', 1) AS `x.y`, array(1, 2) AS size, struct(1 AS a) AS key")
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == 1
