"""Quality rules and mixing against their SQL on small frames with odd rows."""

import math

import duckdb
import pytest

from millrace.llm import mixing, quality

ODD = [
    (0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "one two three " * 40, ""), (4, "x " * 200_000, "b"), (5, "menu\nHome\nNext!\n" + "Good words stand in this line, one by one.\n" * 12, "b"),
    (6, "a b c d a b c e a b c\n" * 3 + "word%d " * 60, "c"), (7, "".join(f"w{i} " for i in range(300)), "é"), (7, "".join(f"w{i} " for i in range(300)), "é"), (None, "no id here", None),
    (8, "We use cookies on this site.\n" + "".join(f"v{i} " for i in range(90)), "z"), (9, "a | b | c | d\n" * 30, "z"), (10, " ".join(f"t{i % 100}" for i in range(400)), "z"),
    (11, "loud!! words!! here!!\n" + " ".join(f"u{i}" for i in range(80)) + ".", "b"), (12, "tail  \r\ntail  \r\n" + " ".join(f"k{i}" for i in range(70)), "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", s, len(t or ""), "clash", 1) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, kept int")


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return con.sql(sql).df()


def rows_of(frame, cols):
    clean = lambda v: None if v is None or v != v else (round(v, 9) if isinstance(v, float) else v)
    return sorted((tuple(clean(r[c]) for c in cols) for r in frame.astype(object).to_dict("records")), key=repr)


def test_quality_is_its_sql(spark, docs):
    got = quality.quality(docs).toPandas()
    want = by_sql(docs, quality.SQL)
    cols = list(got.columns)
    assert rows_of(got, cols[1:]) == rows_of(want, cols[1:])
    assert quality.quality(docs.limit(0)).count() == 0


def test_kept_documents_lose_their_failing_lines(spark, docs):
    out = quality.keep_clean(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert "cookies" not in text[8][0] and text[8][1] == len(text[8][0])
    assert 9 not in text and 0 not in text and 7 in text


def test_long_repeats_take_the_sorted_way(spark):
    t = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, t + " " + t), (2, t)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.quality(df).collect()}
    assert got == {1: 1000, 2: 0}


def test_mix_is_its_sql(spark, docs):
    once = docs.dropDuplicates(["doc_id"])
    got, want = mixing.mixed(once).toPandas(), by_sql(once, mixing.SQL)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert rows_of(got, cols[1:]) == rows_of(want, cols[1:])
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mixed(docs.limit(0)).count() == 0
    again = mixing.mixed(once).toPandas()
    assert rows_of(again, cols) == rows_of(got, cols)


def test_targets_by_hand(spark):
    """Plain rounds: share by weight, hold back what is above the cap, share that again."""
    sizes = {None: 40, "a": 10, "b": 1000, "c": 0, "d": 7, "e": 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    left, free, want = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / total > 3 * sizes[k]}
        if not over:
            want |= {k: left * weight[k] / total for k in free}
            break
        want |= {k: 3.0 * sizes[k] for k in over}
        left -= sum(3 * sizes[k] for k in over)
        free -= over
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in order)


def test_mix_repeats_whole_documents(spark, docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in out.filter("doc_id <> 7").groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mixed(docs).collect() if r.taken and r.doc_id not in (7, None)}
    assert times == want
