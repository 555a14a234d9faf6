"""Documents to sections and chunks, and their profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of document profiles, in the order in which ties are settled.
PROFILES = {
    "cv": ("experience", "education", "skills", "references", "curriculum"),
    "book": ("chapter", "preface", "contents", "author", "edition"),
    "invoice": ("invoice", "total", "due", "payment", "vat"),
    "report": ("summary", "results", "conclusion", "method", "figure"),
    "legal": ("agreement", "party", "hereby", "licensed", "law"),
}


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and tags out, blocks on their own lines, common entities in."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|li|ul|ol|tr|table|section|article|nav|header|footer|h[1-6]|br)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def read_documents(pages: DataFrame) -> DataFrame:
    """page_id, title, n_headings, text of HTML pages."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    heads = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return pages.select("page_id", F.nullif(title, F.lit("")).alias("title"), F.size(heads).alias("n_headings"), html_text(F.col("html")).alias("text"))


HEADING = r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$"


def headings(text: Column) -> Column:
    """The headings of a marked-up text: array of (level, heading)."""
    marks, names = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))
    return F.zip_with(marks, names, lambda m, n: F.struct(F.length(m).alias("level"), n.alias("heading")))


# The types of content that are read, and how.
KINDS = {"text/html": "html", "application/xhtml+xml": "html", "text/markdown": "markdown", "text/x-markdown": "markdown", "text/plain": "text"}


def uniform(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, title, headings, text of files (key, mime, content), each read by its type; parameters of a type (`; charset=...`) and its case
    do not count.

    A page's title is its title element, a marked-up text's its first heading, a plain text has none.  Files of other types
    stay, with kind, title and text null, so that nothing is lost unseen; null content is an empty text."""
    mime = F.lower(F.trim(F.substring_index(F.col("mime"), ";", 1)))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = files.select(key, F.try_element_at(kind, mime).alias("kind"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("c"))
    tag = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"
    of_page = F.zip_with(F.regexp_extract_all("c", F.lit(tag), F.lit(1)), F.regexp_extract_all("c", F.lit(tag), F.lit(2)), lambda n, h: F.struct(n.cast("int").alias("level"), html_text(h).alias("heading")))
    heads = F.when(F.col("kind") == "html", of_page).when(F.col("kind") == "markdown", headings(F.col("c"))).otherwise(F.array().cast("array<struct<level:int,heading:string>>"))
    title = F.when(F.col("kind") == "html", F.trim(F.regexp_extract("c", r"(?is)<title[^>]*>(.*?)</title>", 1))).when(F.col("kind") == "markdown", F.get("headings", F.lit(0))["heading"])
    text = F.when(F.col("kind") == "html", html_text(F.col("c"))).when(F.col("kind").isNotNull(), F.regexp_replace("c", "\r\n?", "\n"))
    return rows.withColumn("headings", heads).select(key, "kind", F.nullif(title, F.lit("")).alias("title"), "headings", text.alias("text"))


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, nr, level, path, depth, root, parent, heading, body: the text between headings under its path of headings
    (deeper ones cleared); root, parent and heading are the path's first, last but one and last.

    The text before the first heading is section 0 of level 0; sections without text are dropped.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(key, headings(t).alias("h"), F.split(t, HEADING, -1).alias("bodies"))
    start = F.struct(F.array().cast("array<struct<level:int,heading:string>>").alias("path"), F.array().cast("array<array<struct<level:int,heading:string>>>").alias("all"))
    item = lambda x: F.struct(x["level"].alias("level"), x["heading"].alias("heading"))

    def step(s: Column, x: Column) -> Column:
        path = F.concat(F.filter(s["path"], lambda p: p["level"] < x["level"]), F.array(item(x)))
        return F.struct(path.alias("path"), F.concat(s["all"], F.array(path)).alias("all"))

    paths = F.aggregate("h", start, step, lambda s: s["all"])
    every = F.concat(F.array(F.array().cast("array<struct<level:int,heading:string>>")), paths)
    rows = base.withColumn("paths", every).select(key, F.posexplode(F.arrays_zip("paths", "bodies")).alias("nr", "s"))
    body = F.trim(F.regexp_replace(F.col("s.bodies"), r"^\s+|\s+$", ""))
    last = F.try_element_at("s.paths", F.lit(-1))
    at = lambda i: F.try_element_at("s.paths", F.lit(i))["heading"]
    return rows.select(
        key, "nr", F.coalesce(last["level"], F.lit(0)).alias("level"), F.array_join(F.transform("s.paths", lambda p: p["heading"]), " > ").alias("path"), F.size("s.paths").alias("depth"),
        at(1).alias("root"), at(-2).alias("parent"), at(-1).alias("heading"), body.alias("body"),
    ).filter("body <> ''")


_CUTS = (re.compile(r"(?<=\n\n)"), re.compile(r"(?<=\n)"), re.compile(r"(?<=[.!?])(?=\s)"), re.compile(r"(?<=\s)"))


def pieces(text: str, most: int, depth: int = 0) -> Iterator[str]:
    """Text cut at paragraphs, else lines, else sentences, else words, else anywhere, into pieces of at most `most`."""
    if len(text) <= most:
        if text:
            yield text
    elif depth == len(_CUTS):
        for i in range(0, len(text), most):
            yield text[i : i + most]
    else:
        for p in _CUTS[depth].split(text):
            yield from pieces(p, most, depth + 1)


def pack(text: str, most: int, overlap: int) -> list[str]:
    """Pieces packed into chunks of at most `most` characters; each starts with the last pieces of the one before, up to overlap."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in pieces(text, most - overlap):
        if held and size + len(p) > most:
            out.append("".join(held))
            keep, n = [], 0
            for q in reversed(held):
                if n + len(q) > overlap:
                    break
                keep.append(q)
                n += len(q)
            held, size = keep[::-1], n
        held.append(p)
        size += len(p)
    if held:
        out.append("".join(held))
    return out


#: Bytes of the sections that are chunked at once; a longer section is chunked alone.
AT_ONCE = 1_000_000


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about AT_ONCE bytes of a column's texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(b):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield b.slice(at, upto - at)
        at = upto


def chunk(secs: DataFrame, key: str = "doc_id", most_tokens: int = 512, overlap_tokens: int = 64) -> DataFrame:
    """key, nr, leaf, parent, text: each section as a parent chunk (leaf -1, its whole text) and its leaves, by an estimate of
    four characters a token; parent is null for a parent, else its number.  A section of one leaf is its parent only.  A task
    holds the chunks of about AT_ONCE bytes of sections at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 2):
                row, leaf, text = [], [], []
                for i, body in enumerate(part.column(2).to_pylist()):
                    leaves = pack(body or "", most_tokens * 4, overlap_tokens * 4)
                    leaves = leaves if len(leaves) > 1 else []
                    row += [i] * (1 + len(leaves))
                    leaf += [-1, *range(len(leaves))]
                    text += [body, *leaves]
                own, nr = (part.column(k).take(pa.array(row, pa.int32())) for k in (0, 1))
                leaf = pa.array(leaf, pa.int32())
                parent = pc.if_else(pc.less(leaf, 0), pa.scalar(None, pa.int32()), nr)
                yield pa.RecordBatch.from_arrays([own, nr, leaf, parent, pa.array(text, pa.string())], [key, "nr", "leaf", "parent", "text"])

    return secs.select(key, F.col("nr").cast("int"), "body").mapInArrow(run, f"{key} {dict(secs.dtypes)[key]}, nr int, leaf int, parent int, text string")


def smallest(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunks that hold no other: leaves, and parents without leaves."""
    w = Window.partitionBy(key, "nr")
    return chunks.withColumn("_most", F.max("leaf").over(w)).filter("leaf >= 0 OR _most < 0").drop("_most")


def merge_small(chunks: DataFrame, key: str, most: int = 2048) -> DataFrame:
    """Neighbouring chunks of one parent put together while they stay within `most` characters: key, part, text."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nr", "leaf", "text"))).alias("c"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(s: Column, x: Column) -> Column:
        both = F.concat(s["now"], F.lit("\n"), x["text"])
        fits = s["now"].isNotNull() & (F.length(both) <= most)
        done = F.when(fits | s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(done.alias("done"), F.when(fits, both).otherwise(x["text"]).alias("now"))

    packed = F.aggregate("c", start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return rows.select(key, F.posexplode(packed).alias("part", "text"))


def profile(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id and its profile: the one with most keywords, if at least `least` occur, else other."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    score = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in PROFILES.items()}
    scored = docs.select("doc_id", *[c.alias(f"s_{k}") for k, c in score.items()])
    best = F.greatest(*[F.col(f"s_{k}") for k in score])
    name = F.when(best < least, F.lit("other"))
    for k in score:
        name = name.when(F.col(f"s_{k}") == best, F.lit(k))
    return scored.select("doc_id", name.alias("profile"), best.alias("score"))


def embed_rows(chunks: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """The text to embed: the path of headings, then the chunk."""
    return chunks.join(paths.select(key, "nr", "path"), [key, "nr"], "left").select(key, "nr", "leaf", F.concat_ws("\n", F.nullif("path", F.lit("")), "text").alias("embed_text"))
