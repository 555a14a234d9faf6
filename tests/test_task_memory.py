"""What one task holds does not grow with the table: rows of many groups are dealt out once, in parts of bounded size."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import diff
from millrace.plans import registry
from millrace.session import tasks_for

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_rows(spark):
    assert tasks_for(spark.range(1000), 100) == 10 and tasks_for(spark.range(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(("name", "key"), [("missing_between_versions", "row_id"), ("resettle_touched", "order_key"), ("group_by_lookup", "bucket#[0-9]+, dim1")])
def test_rows_are_dealt_once(spark, name, key):
    """No aggregate's parts are sent by the key again."""
    plan = spark._jvm.PythonSQLUtils.explainString(registry.queries()[name](spark, SF)._jdf.queryExecution(), "simple")
    import re

    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(rf"hashpartitioning\({key}#?[^)]*\), ENSURE_REQUIREMENTS", plan)


def test_keys_of_one_side(spark):
    a, b = (spark.createDataFrame(x, "k long, s string") for x in ([(1, "a"), (1, "a"), (2, None), (3, "c")], [(3, "c"), (4, "d"), (2, None), (None, None)]))
    got = sorted(((r.k, r.s, r.side) for r in diff.key_difference(a, b, ["k", "s"], 3).collect()), key=str)
    assert got == sorted([(1, "a", "vanished"), (2, None, "vanished"), (2, None, "new"), (4, "d", "new"), (None, None, "new")], key=str)
    assert diff.key_difference(a, b, ["k", "s"]).filter(F.col("side") == "new").count() == 3


def test_sections_are_chunked_in_parts(spark, monkeypatch):
    """What a task gives on at once is the chunks of few bytes, however many rows a batch of sections has."""
    import pyarrow as pa

    from millrace.operators import docs

    given = []

    class Secs:
        dtypes = [("doc_id", "bigint"), ("nr", "int"), ("body", "string")]

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return run

    bodies = ["a few words. " * 400, None, "short", "x" * 3_000_000, *["one two three. " * 200] * 2000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(bodies)), pa.int64()), "nr": pa.array([7] * len(bodies), pa.int32()), "body": pa.array(bodies, pa.string())})
    for b in docs.chunk(Secs(), most_tokens=128, overlap_tokens=16)(iter([batch])):
        assert b.nbytes < 4 * docs.AT_ONCE or set(b.column(0).to_pylist()) == {3}
        given += b.to_pylist()
    want = []
    for i, x in enumerate(bodies):
        leaves = docs.pack(x or "", 512, 64)
        want += [(i, 7, -1, None, x), *((i, 7, k, 7, t) for k, t in enumerate(leaves) if len(leaves) > 1)]
    assert [tuple(r.values()) for r in given] == want
