"""The pipeline on odd rows: every stage beside a plain form, and the whole run."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, quality
from millrace.llm.common import table
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, key string, words int, `_row` int, spans string"


def _prose(seed, n=90):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 4001}" for i in range(n)) + "."


def _rows():
    base = _prose(1, 200).split()
    near = " ".join(base[:100] + ["changed"] + base[101:])
    texts = [
        (0, None), (1, ""), (2, " \t\n "), (3, _prose(2)), (4, _prose(3) + " mail ann@example.org or +44 20 7946 0958 now"), (5, " ".join(base)), (6, near), (7, " ".join(base)), (8, "same again " * 80),
        (9, "Home\n" + _prose(4) + "\nall rights reserved\n" + _prose(5)), (10, "| a | b | c |\n" * 40 + _prose(6, 20)), (None, _prose(7)), (None, _prose(7)), (None, _prose(8) + " 10.1.2.3"), (11, _prose(9)), (11, _prose(10)),
        (12, "\n".join(_prose(100 + i, 60) for i in range(2600))), (13, "é ç Ü ñ 日本 " + _prose(11)), (14, "4111 1111 1111 1111 " + _prose(12)), (14, "4111 1111 1111 1111 " + _prose(12)),
    ]
    return [(i, t, ["en", None][k % 2], ["a", "b", None, ""][k % 4], len(t or ""), "clash", 1, "k", 2, 3, "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave, as lists of rows."""
    docs = spark.createDataFrame(_rows(), COLUMNS)
    out, seen = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, seen, SF)
        rows = got.collect()
        out[name] = (seen.collect(), rows, got.columns)
        seen = spark.createDataFrame(rows, got.schema)
    return out


def test_stages_in_their_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) == ["quality_rules", "near_duplicates", "personal_data", "mixture", "tokens"]
    names = [f.name for f in spark.createDataFrame([], COLUMNS).schema]
    assert all(stages[n][2] == names for n in list(stages)[:-1])
    assert max(len(r.text or "") for r in stages["quality_rules"][0]) > 800_000


def test_quality_rules_are_their_sql(spark, stages):
    given, got, _ = stages["quality_rules"]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(given, COLUMNS).toPandas().astype({"doc_id": "Int64"}))
    verdicts = con.sql(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall()
    assert Counter(i for i, k in verdicts if k) == Counter(r.doc_id for r in got)
    texts = {r.doc_id: r.text for r in got}
    assert {3, 4, 5, 9, 12} <= set(texts) and not {0, 1, 2, 8, 10} & set(texts)
    assert "rights" not in texts[9] and "Home" not in texts[9] and texts[3] == _prose(2)


def test_near_duplicates_are_brute_force(stages):
    given, got, _ = stages["near_duplicates"]
    want = brute([(r.doc_id, r.text) for r in given if r.doc_id is not None], 80)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c for c in want.values()})
    assert sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in given)
    ids = {r.doc_id for r in got}
    assert 5 in ids and not {6, 7} & ids


def test_personal_data_is_masked_and_nothing_else(stages):
    given, got, _ = stages["personal_data"]
    assert len(given) == len(got)
    told = {(r.doc_id, re.sub(r"\W|mail.*", "", r.text)[-40:]) for r in given if r.doc_id not in (4, 14, None)}
    assert told == {(r.doc_id, re.sub(r"\W|mail.*", "", r.text)[-40:]) for r in got if r.doc_id not in (4, 14, None)}
    for r in got:
        assert not re.search(r"ann@example|7946|4111 1111|10\.1\.2\.3", r.text)
        assert r.n_chars == len(r.text)
    four = next(r.text for r in got if r.doc_id == 4)
    assert four.startswith(_prose(3)) and four.endswith("now") and "<" in four


def test_mixture_is_what_the_sampling_takes(spark, stages):
    given, got, _ = stages["mixture"]
    size = lambda t: len((t or "").split())
    took = Counter()
    for r in got:
        took[r.source] += size(r.text)
    sizes = Counter()
    for r in given:
        sizes[r.source] += size(r.text)
    target = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    largest = {s: max(size(r.text) for r in given if r.source == s) for s in sizes}
    assert all(abs(took[s] - target[s]) <= largest[s] for s in sizes)
    most = Counter(tuple(r) for r in given)
    assert all(n <= 3 * most[k] for k, n in Counter(tuple(r) for r in got).items())


def test_tokens_are_the_librarys(stages):
    given, got, _ = stages["tokens"]
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = []
    for r in given:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)


def test_the_run_is_its_stages(spark, stages, tmp_path):
    spark.createDataFrame(_rows(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages["tokens"][1]))


def test_the_run_over_the_given_table(spark):
    docs = table(spark, SF, "documents")
    n = corpus_pipeline.run(spark, SF).count()
    assert 0 < n < 3 * docs.count()


def test_the_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
