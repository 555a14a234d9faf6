"""Pieces, merges, lexicon, shards and counts against the tokenizers library and plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, token_count, token_store
from millrace.llm.pretoken import ChunkIds, chunks, frequent_chunks

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello, World's  end", "a <|endoftext|>b <|ENDOFTEXT|>", "x<|startoftext|><|endoftext|>y", "ΟΔΟΣ ΣΑΣ İstanbul ǅ",
    "é ́a ﬁ Å", "tab\tnew\nline\x0bvt\x1cfs\x1fus\x85nel em　id​zw", "don't WE'LL 'S 's ''s", "12３٤ ½ Ⅷ 一二", "😀👍🏽 naïve_été__",
    "a" * 5000, "ab1" * 3000, "!?" * 2000, "word " * 3000, "﻿bom", "ͅ ϴ ẞ K",
]


@pytest.fixture(scope="module")
def lib():
    return token_count.library(PATH)


@pytest.fixture(scope="module")
def encoder():
    b = bpe.Bpe(PATH)
    words = ["the", "of", "ing", "things", "thing", "hello", "world", "'s", "ab", ",", "."]
    return bpe.Encoder(b, bpe.Lexicon.mapped(bpe.Lexicon.compile({w: b.merge(w) for w in words}).image()))


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_both_encoders_equal_the_library(lib, encoder, text):
    want = ids_of(lib, text)
    for enc in (encoder, ChunkIds(PATH)):
        assert enc.encode(text or "").tolist() == want
    assert encoder.decode(encoder.encode(text or "")) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    lib = token_count.library(PATH)
    b = bpe.Bpe(PATH) if not hasattr(test_any_text, "b") else test_any_text.b
    test_any_text.b = b
    enc = bpe.Encoder(b, bpe.Lexicon.compile({"a": b.merge("a")}))
    assert enc.encode(text).tolist() == ids_of(lib, text)
    own = ChunkIds(PATH) if not hasattr(test_any_text, "own") else test_any_text.own
    test_any_text.own = own
    assert own.encode(text).tolist() == ids_of(lib, text)


def test_scan_and_heap_agree():
    b = bpe.Bpe(PATH)
    for w in ("thanonontioniner", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "unbelievablyextraordinary", "èeuxouèeuxouèeuxou"):
        assert b._by_scan(b.symbols(w)) == b._by_heap(b.symbols(w))


def test_lexicon_is_minimal_and_a_perfect_hash():
    words = {w: [i] for i, w in enumerate(sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "😀"}))}
    lex = bpe.Lexicon.compile(words)
    order = sorted(words)
    assert lex.ranks(order).tolist() == list(range(len(order)))
    assert lex.ranks(["ta", "tapss", "x", "stopx", "😀😀"]).tolist() == [-1] * 5
    # root, s, st, "t" with a/o, two middles that share "p", p, end: fewer states than letters
    assert len(lex.a["end"]) <= 8


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano_selects_every_value(gaps):
    values = np.cumsum(gaps)
    ef = token_store.EliasFano.encode(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.full(10_000, 700))
    assert token_store.EliasFano.encode(values).n_bytes * 8 < 10_000 * 13


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "n", 1), (None, "no id", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_round_trip(spark, docs, lib):
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.round_trip(docs, PATH, 20).collect()}
    want = set()
    for r in docs.collect():
        ids = ids_of(lib, r.text)
        want.add((r.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == want
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    assert sorted(len(r.ids) for r in bpe.encode(docs, PATH, 20).collect()) == sorted(len(ids_of(lib, r.text)) for r in docs.collect())


def test_counts(spark, docs, lib):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, PATH, frequent=10, cache_size=50).collect())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(ids_of(lib, r.text)), n > 2048) for r in docs.collect())
    assert got == want
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0


def test_shards(spark, docs, lib):
    got = token_store.store_tokens(docs, PATH, roll_ids=500).collect()
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*ids_of(lib, r.text), 1], "<u4").tobytes()
        want.append((r.doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == want
    assert token_store.store_tokens(docs.limit(0), PATH).count() == 0


def test_one_document_by_select():
    counts = [0, 3, 700, 1, 2]
    ids = np.arange(706, dtype=np.uint32)
    s = token_store.Shard(token_store.pack([None, -7, -7, 7, 2**40], np.array(counts), ids, 2))
    assert [s.document(i).tolist() for i in range(5)] == [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [s.doc_id(i) for i in range(5)] == [None, -7, -7, 7, 2**40]
    empty = token_store.Shard(token_store.pack([None], np.array([0]), ids[:0], 4))
    assert (empty.doc_id(0), empty.document(0).tolist()) == (None, [])


def test_the_query_reads_by_select(spark, docs, monkeypatch):
    """The reader's own loop takes boundaries and doc_ids by select alone."""
    shard = token_store.pack([1, 2, 3], np.array([2, 0, 4]), np.arange(6), 2)
    asked = []
    monkeypatch.setattr(token_store.EliasFano, "select", lambda self, i, was=token_store.EliasFano.select: asked.append(i) or was(self, i))
    monkeypatch.setattr(token_store.EliasFano, "all", None)
    rows = [r for b in token_store.unpacked("f", shard, 2) for r in b.to_pylist()]
    assert [(r["doc_id"], r["at"], r["n_tokens"]) for r in rows] == [(1, 0, 2), (2, 2, 0), (3, 2, 4)]
    assert rows[2]["ids_crc32"] == zlib.crc32(np.arange(2, 6, dtype="<u4").tobytes())
    assert len(asked) == 8


def test_small_caches_forget_and_give_the_same(lib):
    own = ChunkIds(PATH, 6)
    texts = ["one two three four five six seven", "x" * 70 + " eight " + "y" * 80, "one two nine, ten! eleven; " + "x" * 70, "three a-b c4 one"]
    for _ in range(3):
        for t in texts:
            assert own.encode(t).tolist() == ids_of(lib, t)
    assert max(map(len, own.at)) <= 64 or own.long


def test_very_long_texts(spark, lib):
    text = " ".join(f"w{i % 999} and-{i} the word{i}," for i in range(60_000))
    want = ids_of(lib, text)
    df = spark.createDataFrame([(1, text), (2, "x"), (3, "z" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_count.count_tokens(df, PATH).collect()}
    assert got[1].n_tokens == len(want) and got[1].n_bytes == len(text)
    trip = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    assert trip[1].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert trip[1].decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    store = {r.doc_id: r for r in token_store.store_tokens(df, PATH, roll_ids=1000).collect()}
    assert store[1].ids_crc32 == zlib.crc32(np.array([*want, 1], "<u4").tobytes())
    assert got[3].n_tokens == trip[3].n_tokens == store[3].n_tokens - 1


def test_decoding_in_parts(encoder, lib):
    ids = encoder.encode("the things, of worlds <|endoftext|> and more 123 of them")
    whole = lib.decode(ids.tolist(), skip_special_tokens=False)
    assert b"".join(encoder.decode_parts(ids, 3)).decode() == whole
    assert encoder.decoded_sha256(ids, np.array([0, 4, len(ids)]), 3) == encoder.decoded_sha256(ids, np.array([0, 4, len(ids)]))


def test_ids_beyond_16_bits(spark, docs, lib):
    one = docs.filter("text IS NOT NULL").limit(1)
    r = one.first()
    got = token_store.store_tokens(spark.createDataFrame([r], docs.schema), PATH, end_id=70_000).first()
    assert got.ids_crc32 == zlib.crc32(np.array([*ids_of(lib, r.text), 70_000], "<u4").tobytes())
    assert token_store.id_width(PATH, 1) == 2
    with pytest.raises(ValueError, match="16 bits"):
        token_store.pack([1], np.array([1]), np.array([70_000]), 2)


def test_frequent_chunks(spark, docs):
    assert frequent_chunks(docs, 1) == [("word", 3000)]
    assert chunks("a\x1cb c") == ["a\x1cb", "c"]


def test_what_a_cache_holds_for_a_name(lib):
    """No object for each name, and new names are learned in parts."""
    import tracemalloc

    from millrace.llm import pretoken

    class One(pretoken.Known):
        most = 0

        def learn(self, new):
            self.most = max(self.most, len(new))
            return np.ones(len(new), np.uint32), np.ones(len(new), np.int64)

    held = One(500_000)
    tracemalloc.start()
    for k in range(0, 100_000, 20_000):
        assert len(set(held.places([f"name-{i:012d}" for i in range(k, k + 20_000)]).tolist())) == 20_000
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.n == 100_001 and size / held.n < 100 and held.most < 10_000
    assert held.places([f"name-{i:012d}" for i in (0, 99_999)]).tolist() == [1, 100_000]


def test_names_of_one_hash(lib, monkeypatch):
    from millrace.llm import pretoken

    monkeypatch.setattr(pretoken, "xxh3_64_intdigest", lambda name: len(name) % 2)
    own = ChunkIds(PATH, 20)
    for t in ("one two three four five six", "two one " + "x" * 70 + " seven, eight!", "six five four don't a-b one " + "y" * 71) * 3:
        assert own.encode(t).tolist() == ids_of(lib, t)
