"""Personal data against a plain scan; archives against their payloads."""

import hashlib
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii, warc

ODD = [
    None, "", "a@b.c", "write to x.y+z%q@mail-1.example.com. or a@b", "a@b.c+d@e.f@g.h", "..a@b..c", "no@dot x@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.1 1.1.1.999",
    "card 4111 1111-1111 1111.", "4111111111111112 4111111111111111", "41111111 11111111 1", "é4111111111111111é", "1  4111111111111111", "+1 (017) 555-7713 call", "+12345678", "+1234567890123456",
    "++1 2 3 4 5 6 7 8 9-", "iban DE89 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "GB82WEST12345698765431", "ssn 123-45-6789 and 123-45-6789", "123-45-6789 no word near it at all",
    'token = "b0b3c6a43eb78aa99cbd7049c572391524f37a8b"', "x" * 3_000, "1" * 2_000, "1 " * 500, "a@b." + "c." * 3_000, "+1" * 3_000, "1.1." * 2_000, "ünïcode 😀 a@b.co 😀 +49 (30) 123456789 😀",
    " ".join(f"u{i}@h{i}.org" for i in range(900)), "4111 1111 1111 1111 5500 0000 0000 0004", "4111111111111111-", "- 4111-1111-1111-1111 -", "a@b.c" * 5,
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    """The base spans as the contract words them."""
    n = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        (r"(?>[A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n(m)) <= 19 and luhn(n(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n(m)) <= 15),
    )
    out = []
    for k, (p, ok) in enumerate(rules):
        if k == 0 and "@" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) < 100_000 and ok(m[0])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0.5) for i, t in enumerate(ODD)] + [(2, ODD[2], "x", 0.5), (None, "z@y.x", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score double")


def test_base_spans(docs):
    names = ["email", "ip", "card", "phone"]
    for r in pii.find(docs).collect():
        text = "z@y.x" if r.doc_id is None else ODD[r.doc_id] or ""
        want = base(text)
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        got = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in names)
        assert got == line, text[:80]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["TOKEN", "Api_Key", "\u212aEY", "SECRET", "PASSWORD"])
def test_secrets_in_capitals(spark, word):
    key = "9233A8EC0F1D4B7792C3AA10E4D5F6B7C8D9E0F1"
    text = f'ALL OF IT IS LOUD: {word} = "{key}" AND MORE'
    docs = spark.createDataFrame([(1, text, len(text)), (2, f"NO SUCH WORD HERE {key}", 58)], "doc_id long, text string, n_chars long")
    at = text.index(key)
    assert {r.doc_id: r.spans for r in pii.find(docs).collect()} == {1: f"secret:{at}:{at + len(key)}", 2: ""}
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()} == {1: text.replace(key, "<secret>"), 2: f"NO SUCH WORD HERE {key}"}


def test_long_texts_take_no_longer_than_their_length(spark):
    long = ["x" * 300_000, "1" * 200_000, "1 " * 100_000, "a@b." + "c." * 100_000, "+1" * 100_000, "1.1." * 50_000, "A" * 200_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r.spans[:40] for r in pii.find(docs).collect()}
    assert got[3] == f"email:0:{4 + 200_000 - 1}" and got[5].startswith("ip:0:7,ip:8:15") and not got[0] + got[1] + got[2] + got[4] + got[6]


def test_added_spans(docs):
    got = {r.doc_id: (r.spans, r.scores) for r in pii.find(docs).collect()}
    at = lambda i: got[i][0]
    assert "iban:5:32" in at(18) and "iban:0:22" in at(19) and "iban" not in at(20)
    assert at(21) == "ssn:4:15" and at(22) == "" and "secret:9:49" in at(23)
    assert got[2][1] == "0.9"


def test_masked(docs):
    out = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == docs.columns
    assert out[2] == "<email>" and out[1] == "" and out[0] is None and out[9] == "card <card>."
    assert out[30] == "ünïcode 😀 <email> 😀 <phone> 😀"


def test_masking_by_a_plain_scan(spark):
    """Many spans over many pieces, spans over the borders of pieces, and kinds that overlap."""
    many = " ".join(f"u{i}@h{i}.org {i % 256}.1.1.{i % 300} +1 (017) 555-7713;" for i in range(3_000))
    wide = "é" * 1_020 + " " + "a." * 2_000 + "b@c.de " + "x" * 500 + " a@1.2.3.4 +4111111111111111 😀 ip 1.2.3.4"
    docs = spark.createDataFrame([(1, many), (2, wide), (3, "no"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for r in pii.masked(docs).collect():
        text = {1: many, 2: wide, 3: "no", 4: None}[r.doc_id]
        out, end = "", 0
        for kind, a, b in (x.split(":") for x in found[r.doc_id].split(",") if x):
            if int(a) >= end:
                out += text[end : int(a)] + f"<{kind}>"
            end = max(end, int(b))
        assert r.text == (None if text is None else out + text[end:])


def test_masking_takes_no_longer_than_the_spans(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert pii.masked(docs).first().text == " ".join(["<email>"] * 60_000)
    assert time.monotonic() - began < 60


def test_context_behind(spark):
    docs = spark.createDataFrame([(1, "123-45-6789 (SSN)"), (2, "123-45-6789 " + "x" * 30 + " ssn")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.find(docs).collect()} == {1: "ssn:0:11", 2: ""}


PAGES = [
    (1, "http://a/1", None), (2, "http://a/2", ""), (3, "http://a/3", "<p>é</p>" * 30), (4, None, "<p>é</p>" * 30), (0, "u\nv", "<p>é</p>" * 30), (5, "x", "short"), (6, "x", "short"),
    (7, "x", "line\r\n\r\nWARC/1.1\r\n" * 20), (8, "x", "big" * 400_000), (9, "x", "y" * 99), (10, "x", "y" * 99), (11, "x", "y" * 100), (12, "x", "y" * 100),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, owner int").repartition(3)
    got = warc.archive(pages, roll_bytes=300, payloads=True).collect()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(warc.SQL).fetchall()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    assert {r.page_id: r.refers_to for r in got if r.refers_to is not None} == {3: 0, 4: 0, 12: 11}
    assert {r.page_id: r.url for r in got}[0] == "u%0Av"
    assert warc.archive(pages.limit(0)).count() == 0


def test_null_and_repeated_page_ids(spark):
    h = "q" * 200
    pages = spark.createDataFrame([(None, "n", h), (4, "a", h), (4, "a", h), (9, "b", h)], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert got == [(-1, "revisit", 4), (4, "response", None), (4, "response", None), (9, "revisit", 4)]


def test_same_bytes_again(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    sums = [sorted((r.file, r.sha256) for r in warc.write_archives(pages, f"file://{tmp_path}/{k}").collect()) for k in "ab"]
    assert sums[0] == sums[1]
    raw = (tmp_path / "a" / sums[0][0][0]).read_bytes()
    fields, _ = warc.parse(next(warc.members(raw)))
    assert fields["WARC-Date"] == warc.DATE
    with pytest.raises(ValueError, match="within a member"):
        list(warc.members(raw[:-3]))


def test_record_ids_differ(spark, tmp_path):
    h = "q" * 200
    rows = [(4, "a", h)] * 3 + [(4, "b", h + "r"), (9, "b", h), (9, "b", h), (None, "n", "x"), (None, "n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_archives(pages, f"file://{tmp_path}/c").collect()
    got = [warc.parse(m)[0] for f in files for m in warc.members((tmp_path / "c" / f.file).read_bytes())]
    ids = {f["WARC-Record-ID"]: f["WARC-Type"] for f in got}
    assert len(ids) == len(rows)
    assert [ids[f["WARC-Refers-To"]] for f in got if f["WARC-Type"] == "revisit"] == ["response", "response"]


def test_many_records_of_one_file_take_linear_time():
    packed = b"".join(zlib.compress(warc.record(i, f"u{i}", bytes(str(i), "ascii") * 300, None), wbits=31) for i in range(20_000))
    began = time.process_time()
    assert [warc.parse(m)[1][:5] for m in warc.members(packed)][12_345] == b"12345"
    assert time.process_time() - began < 10


def test_a_digest_of_most_pages(spark):
    h = "common " * 30
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 1, F.lit(h)).otherwise(F.concat(F.lit(h), "id")).alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(pages, roll_bytes=5000).collect()}
    assert got == {i: ("revisit", 1) if i % 3 == 1 and i > 1 else ("response", None) for i in range(3000)}
