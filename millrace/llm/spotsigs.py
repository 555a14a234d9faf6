"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Every anchor word starts a chain: itself and the next `CHAIN` words that are no anchors, if they come within `REACH`
words.  Words are compared without the marks at their ends; a word of marks only stays as it is.  The set of its chains
is a document's signature, and the chains' 64-bit hashes, distinct, sorted and in hexadecimal, are its fingerprint.  A
text without a chain takes every CHAIN + 1 words in a row that are no anchors, and one with fewer of them all its words
as one chain, so only texts without words have the empty fingerprint.  Likeness is Jaccard's; two empty signatures are
alike (1.0).  Two texts of 10,000 chains share a hash by chance with probability below 1e-11.

All of it is DataFrame expressions.  `neighbours` pairs each document with the next one without a global window: rows
are dealt by ranges of doc_id, and each range also gets the first document of the range below it.

`groups` joins signatures over the whole corpus.  Equal signatures are one class.  A class stands under the rarest of its
chains, so many that two classes of likeness `least` share one, and there under the partition of its set's length and
the next one, so only lengths that allow the likeness meet.  Under each such key every class is compared with the least
one; then, where a key still holds several components, the members outside its largest are compared with all of the key.
Jaccard is only worked out for pairs whose lengths allow it, and components come out exactly, though no group is ever
listed pair by pair.  Rarity is an order of its own for the `FREQUENT` chains that most documents hold (counted over all
documents in bounded memory), and by hash for all others; any order gives the same result.

Null text counts as empty.  Equal doc_ids are ordered by text; null doc_ids come last in the descending order and are in
no class.  One document is its own next.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_SEP, settled, text_col, wanted_rows, written
from millrace.llm.graph import components, parts, salted

# Common words of four languages.
ANCHORS = (
    "a", "an", "and", "are", "as", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "como", "con", "del", "el", "los", "no", "para", "por", "se", "su",
)
CHAIN = 2
REACH = 6
#: How many of the most common chains come last in the order of rarity.
FREQUENT = 1024
# Marks at the ends of words: punctuation, and symbols other than pictures.  Each run is tried once; the first look
# passes over what most text consists of.
_MARKS = r"\p{P}\p{Sm}\p{Sc}\p{Sk}"
ENDS = rf"(?=[^a-z0-9\t-\r ])(?:(?<![^\t-\r ])[{_MARKS}]++(?=[^\t-\r ])|(?<=[^\t-\r {_MARKS}])[{_MARKS}]++(?![^\t-\r ]))"


def _anchor(w: Column) -> Column:
    return w.isin(*ANCHORS)


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the lower-case words of a text column, without marks at their ends, worked out once."""
    bare = F.regexp_replace(F.lower(text), ENDS, "")
    return settled(df.withColumn(name, F.filter(F.split(bare, WORD_SEP, -1), lambda w: w != "")), name)


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the signature of a text column."""
    step = with_words(df, text, "_w")
    chains = F.filter(
        F.transform(
            "_w",
            lambda w, i: F.when(_anchor(w), F.concat(F.array(w), F.slice(F.filter(F.slice(F.col("_w"), i + 2, F.lit(REACH)), lambda x: ~_anchor(x)), 1, CHAIN))),
        ),
        lambda c: F.size(c) == CHAIN + 1,
    )
    hashes = F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c))))
    step = settled(step.withColumn("_i", hashes), "_i", "_w")
    # Without a chain: the words that are no anchors, in overlapping runs, or all words where there are too few.
    step = settled(step.withColumn("_c", F.when(F.size("_i") == 0, F.filter("_w", lambda w: ~_anchor(w)))), "_c", "_i", "_w")
    runs = F.transform(F.sequence(F.lit(1), F.size("_c") - CHAIN), lambda i: F.xxhash64(F.slice(F.col("_c"), i, F.lit(CHAIN + 1))))
    rest = F.when(F.size("_c") > CHAIN, F.sort_array(F.array_distinct(runs))).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    return settled(step.withColumn(name, F.when(F.size("_i") > 0, F.col("_i")).otherwise(rest)).drop("_c", "_i", "_w"), name)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signatures; sizes that rule out any overlap need no look at the chains."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def printed(sig: Column) -> Column:
    """A signature as text, sixteen hexadecimal digits a chain."""
    return F.array_join(F.transform(sig, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def neighbours(docs: DataFrame, ranges: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """doc_id and text of every document with next_text, the text of the document after it in descending order (the
    first's after the last).

    What is `known` of some doc_ids (class_id, group_id) travels with the texts through their one exchange and is dealt to
    the rows of its doc_id there, so the texts are not shuffled again for it."""
    spark = docs.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # The number of cuts below an id, by blocks of cuts first; a null id goes with the lowest.
    k = math.isqrt(len(cuts)) + 1
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))

    def dealt_to(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("part", F.lit(0))
        df = df.withColumn("block", F.greatest(below(F.array(*map(F.lit, cuts[::k]))) - 1, F.lit(0)))
        at = F.col("block") * k + below(F.slice(F.array(*map(F.lit, cuts)), F.col("block") * k + 1, F.lit(k)))
        return df.withColumn("part", F.coalesce(at, F.lit(0)).cast("int")).drop("block")

    rows = dealt_to(rows)
    # One row per range: the largest id of each, sent to the range above, the first of all to the last.
    tops = sorted(((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), key=lambda x: x[0])
    if not tops:
        return spark.createDataFrame([], "doc_id bigint, text string, next_text string, class_id bigint, group_id bigint")
    goes = spark.createDataFrame([(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], "_top bigint, _to int")
    sent = rows.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("part"), F.lit(True).alias("guest")))
    dealt = sent.withColumn("home", copies).select("doc_id", "text", F.inline(F.filter("home", lambda h: h["part"].isNotNull())))
    none = F.lit(None).cast("bigint")
    met = dealt.select("part", "guest", "doc_id", "text", none.alias("class_id"), none.alias("group_id"))
    if known is not None:
        riders = dealt_to(known.select("doc_id", "class_id", "group_id"))
        both = met.unionByName(riders.select("part", F.lit(None).cast("boolean").alias("guest"), "doc_id", F.lit(None).cast("string").alias("text"), "class_id", "group_id"))
        own = Window.partitionBy("part", "doc_id")
        met = both.repartition("part").withColumns({c: F.max(c).over(own) for c in ("class_id", "group_id")}).filter(F.col("guest").isNotNull())
    w = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return met.withColumn("next_text", F.lead("text").over(w)).filter(~F.col("guest")).select("doc_id", "text", "next_text", "class_id", "group_id")


def fingerprints(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every document's fingerprint, and how it stands to its edited text and to the next document.

    With what `groups` found (known) also its class (class_id: the least doc_id of its signature) and its group (group_id: the
    least doc_id that its links lead to); a text without words is in none, nor is a row without a doc_id."""
    step = neighbours(docs, known=known).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    step = settled(step.withColumn("edited", edited), "edited", "n_chars")
    for text, name in (("text", "sig"), ("edited", "edited_sig"), ("next_text", "next_sig")):
        step = with_signature(step, text, name)
    return step.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        *([F.when(F.size("sig") > 0, F.coalesce(c, "doc_id")).alias(c) for c in ("class_id", "group_id")] if known is not None else []),
    )


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id and sig of the documents with words."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    return with_signature(rows, "text", "sig").filter(F.size("sig") > 0).select("doc_id", "sig")


def _digest(sig: Column) -> Column:
    return F.unhex(F.md5(printed(sig).cast("binary")))


def keys(classes: DataFrame, frequent: list[int], least: float) -> DataFrame:
    """key, class_id, n of every class: its rarest chains, each under the partition of its length and the next one."""
    n = F.size("sig")
    first = (n - F.ceil(F.lit(least) * n - F.lit(1e-9)) + 1).cast("int")
    common = lambda c: c.isin(*frequent) if frequent else F.lit(False)
    order = F.sort_array(F.transform("sig", lambda c: F.struct(common(c).alias("f"), c.alias("c"))))
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("int")
    rows = classes.select("class_id", n.alias("n"), part.alias("p"), F.explode(F.slice(order, F.lit(1), first)).alias("x"))
    return rows.select("class_id", "n", F.explode(F.array(F.xxhash64("x.c", "p"), F.xxhash64("x.c", F.col("p") + 1))).alias("key"))


def confirmed(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a > b) of classes whose signatures are alike to `least` or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sigs = _signed(wanted_rows(docs, wanted, "doc_id")).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("sig").alias("sig"))
    sigs = written(sigs, "spotsigs")
    sa, sb = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    met = pairs.join(sa, "a").join(sb, "b")
    return met.filter(likeness(F.col("sa"), F.col("sb")) >= least - 1e-12).select("a", "b")


def fits(least: float) -> Column:
    """Whether the lengths of two sets (n and m) allow the likeness."""
    return F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - F.lit(1e-9)


def groups(docs: DataFrame, least: float = 0.8, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, class_id and group_id of every document that has another in its class or group."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    top = _signed(own).select(F.explode("sig").alias("c")).agg(F.expr(f"approx_top_k(c, {frequent}, {16 * frequent})").alias("t")).first()["t"]
    signed = _signed(own).withColumn("digest", _digest(F.col("sig")))
    named = signed.select("doc_id", "digest", "sig")
    keyed = keys(named.select(F.col("doc_id").alias("class_id"), "sig"), [r["item"] for r in top], least)
    rows = written(named.select("doc_id", "digest"), "spotsigs-digests")
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), parts(F.col("doc_id")))
    many = salted(rows, classes.filter("copies > 1"), "digest", F.col("doc_id"))
    later = many.filter("doc_id <> class_id").select(F.col("doc_id").alias("class_id"))
    # Only classes meet: of equal signatures the rows of all but the first go.
    keyed = written(keyed.join(later, "class_id", "left_anti").distinct(), "spotsigs-keys")
    some = keyed.groupBy("key").agg(F.min(F.struct("class_id", "n")).alias("low"), F.count("*").alias("df"), parts(F.col("class_id"))).filter("df > 1")
    some = some.select("key", F.col("low.class_id").alias("b"), F.col("low.n").alias("m"), "_parts")
    met = written(salted(keyed, some, "key", F.col("class_id")), "spotsigs-met")
    star = met.filter(F.col("class_id") > F.col("b")).filter(fits(least)).select(F.col("class_id").alias("a"), "b").distinct()
    edges = written(confirmed(star, own, least), "spotsigs-links")
    found = components(edges)
    # The rest: keys that still hold several components.
    rows_c = met.select("key", "class_id", "n").join(found.withColumnRenamed("doc", "class_id"), "class_id", "left").withColumn("comp", F.coalesce("comp", "class_id"))
    per = rows_c.groupBy("key", "comp").agg(F.count("*").alias("k"), parts(F.col("class_id")))
    main = per.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.bit_or("_parts").alias("_parts")).filter("comps > 1")
    left = written(salted(rows_c, main.select("key", F.col("top.comp").alias("main"), "_parts"), "key", F.col("class_id")), "spotsigs-left")
    outer = left.filter("comp <> main").select("key", F.col("class_id").alias("a"), "n", F.col("comp").alias("comp_a"))
    inner = left.select("key", F.col("class_id").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"))
    rest = outer.join(inner, "key").filter((F.col("comp_a") != F.col("comp_b")) & fits(least)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more = written(confirmed(written(rest, "spotsigs-rest"), own, least), "spotsigs-links")
    if not more.isEmpty():
        found = components(edges.unionByName(more))
    members = salted(rows, classes, "digest", F.col("doc_id")).select("doc_id", "class_id", "copies")
    whole = members.join(found.withColumnRenamed("doc", "class_id"), "class_id", "left").withColumn("group_id", F.coalesce("comp", "class_id"))
    told = whole.filter((F.col("copies") > 1) | (F.col("group_id") != F.col("class_id")))
    return written(told.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id")), "spotsigs-groups")
