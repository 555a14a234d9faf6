"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

All of it is one chain of DataFrame expressions over a row; nothing is shuffled.  For each kind the text is cut by the
pattern and the matches are taken from it; the lengths of cuts and matches, summed up, give the positions in code
points.  The patterns have no nested repetition, and a pattern cannot start inside a run that has already failed, so a
text of any length takes a time in proportion to its length.

Base kinds (always reported when their check holds): email; ip (each part at most 255); card (12 to 19 digits and
Luhn); phone (9 to 15 digits).  The method adds iban (mod 97), ssn and secret: they have a base score, raised by a
context word in the 40 characters before them or the 20 after (no further than the kind's match before or after), and
are reported from `threshold` on.  Kinds may overlap; within a
kind spans are leftmost and do not.

Null text counts as empty and has no spans.  Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settled, text_col


@dataclass(frozen=True)
class Kind:
    """How a kind is proposed, and its score without and with a context word.

    Only texts in which the hint matches are searched, so whatever can be reported must imply it; the context is looked
    for in lower-cased text."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    lift: float = 0.3


# The kinds, in the order in which spans of one start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[0-9 -](?<![ -][ -])){11,}(?<=[0-9])", r"[0-9][0-9 -]{10}", 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, "ssn|social|security"),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,128}(?![A-Za-z0-9_])", "(?iu)token|key|secret|passw", 0.4, "token|key|secret|passw"),
)
N_BASE = 4
THRESHOLD = 0.6
WINDOW = 40
AFTER = 20
_BLOCK = 256
_PIECE = 1024
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a text of digits passes Luhn."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = (n - i) % 2 == 1
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether an account number passes mod 97."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: Kind, found: Column) -> Column:
    """The check of a kind on what its pattern found."""
    if kind.name == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind.name == "card":
        d = digits_of(found)
        return F.when(F.length(d).between(12, 19), luhn_ok(d)).otherwise(False)
    if kind.name == "phone":
        return F.length(digits_of(found)).between(9, 15)
    if kind.name == "iban":
        return F.when(F.length(F.regexp_replace(found, " ", "")).between(15, 34), mod97_ok(found)).otherwise(False)
    return F.lit(True)


def _plus(a: Column, x: Column) -> Column:
    return a + x


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), _plus)


def _block_sums(steps: Column) -> Column:
    """Sums of each _BLOCK steps."""
    last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: _total(F.slice(steps, k * _BLOCK + 1, F.lit(_BLOCK))))


def _before(blocks: Column) -> Column:
    """Sums of the blocks before each block."""
    return F.transform(blocks, lambda _, k: _total(F.slice(blocks, F.lit(1), k)))


def _starts(gaps: Column, steps: Column, before: Column) -> Column:
    """Where each match starts: all steps (a cut and its match) before it, those of whole blocks summed already, and its own cut."""
    return F.flatten(
        F.transform(
            before,
            lambda b, k: F.transform(
                F.slice(steps, k * _BLOCK + 1, F.lit(_BLOCK)),
                lambda _, i: b + _total(F.slice(steps, k * _BLOCK + 1, i)) + F.get(gaps, k * _BLOCK + i),
            ),
        )
    )


def _span(no: int, k: Kind, gaps: Column, starts: Column) -> Callable[[Column, Column], Column]:
    """From a match and its number to its span and score; null where the check fails."""

    def span(x: Column, i: Column) -> Column:
        at = F.get(starts, i)
        around = F.concat_ws("\n", F.substring(F.get(gaps, i), -WINDOW, WINDOW), F.substring(F.get(gaps, i + 1), 1, AFTER))
        near = F.lower(around).rlike(k.context)
        score = F.lit(k.score) + F.when(near, F.lit(k.lift)).otherwise(F.lit(0.0))
        return F.when(
            confirmed(k, x),
            F.struct(at.alias("start"), F.lit(no).alias("kind_no"), (at + F.length(x)).alias("end"), F.lit(k.name).alias("kind"), F.least(F.round(score, 2), F.lit(1.0)).alias("score")),
        )

    return span


def spans(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `_spans`: the reported spans with their scores, by start and then by kind."""
    none = F.array().cast("array<string>")
    lens = lambda c: F.transform(c, lambda x: F.length(x))
    names = [k.name for k in KINDS]
    step = docs.withColumn("_t", text_col(text))
    for k in KINDS:
        hinted = F.col("_t").rlike(k.hint) if len(k.hint) > 1 else F.contains(F.col("_t"), F.lit(k.hint))
        step = step.withColumn(f"_f_{k.name}", F.when(hinted, F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0))).otherwise(none))
    step = settled(step, "_t", *[f"_f_{n}" for n in names])
    for k in KINDS:
        step = step.withColumn(f"_g_{k.name}", F.when(F.size(f"_f_{k.name}") > 0, F.split("_t", k.pattern, -1)).otherwise(none))
    step = settled(step, *[f"_g_{n}" for n in names])
    some = lambda n, c: F.when(F.size(f"_f_{n}") > 0, c).otherwise(F.array().cast("array<int>"))
    for n in names:
        step = step.withColumn(f"_a_{n}", some(n, lens(F.col(f"_g_{n}"))))
        step = step.withColumn(f"_b_{n}", some(n, F.zip_with(lens(F.slice(F.col(f"_g_{n}"), F.lit(1), F.size(f"_f_{n}"))), lens(F.col(f"_f_{n}")), _plus)))
    step = settled(step, *[f"_{x}_{n}" for n in names for x in "ab"])
    for n in names:
        step = step.withColumn(f"_c_{n}", some(n, _block_sums(F.col(f"_b_{n}"))))
    step = settled(step, *[f"_c_{n}" for n in names])
    for n in names:
        step = step.withColumn(f"_d_{n}", some(n, _before(F.col(f"_c_{n}"))))
    step = settled(step, *[f"_d_{n}" for n in names])
    for n in names:
        step = step.withColumn(f"_p_{n}", some(n, _starts(*[F.col(f"_{x}_{n}") for x in "abd"])))
    step = settled(step, *[f"_p_{n}" for n in names])
    for no, k in enumerate(KINDS):
        f, g, p = (F.col(f"_{x}_{k.name}") for x in "fgp")
        span = _span(no, k, g, p)
        ok = F.filter(F.transform(f, span), lambda s: s.isNotNull() & ((s["kind_no"] < N_BASE) | (s["score"] >= threshold)))
        step = step.withColumn(f"_s_{k.name}", F.when(F.size(f) > 0, ok).otherwise(F.array().cast(_SPAN)))
    every = F.sort_array(F.concat(*[F.col(f"_s_{n}") for n in names]))
    return settled(step.withColumn("_spans", every).drop("_t", *[f"_{x}_{n}" for n in names for x in "fgabcdps"]), "_spans")


def _listed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans and their scores."""
    got = spans(docs.select("doc_id", "text"))
    s = F.col("_spans")
    count = lambda no: F.size(F.filter(s, lambda x: x["kind_no"] == no)).cast("bigint")
    return got.select(
        "doc_id",
        *[count(no).alias(f"n_{KINDS[no].name}") for no in range(N_BASE)],
        F.sha2(_listed(F.filter(s, lambda x: x["kind_no"] < N_BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(s).alias("spans"),
        F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def _merged(spans_: Column, ends: Column, before: Column) -> Column:
    """Spans that overlap as one: where the first starts, where the last ends, and the first's kind.

    A span starts anew where no span before it reaches; `before` has how far those of whole blocks do."""

    def block(reach: Column, k: Column) -> Column:
        own = F.slice(spans_, k * _BLOCK + 1, F.lit(_BLOCK))
        far = lambda i: F.greatest(reach, F.coalesce(F.array_max(F.slice(ends, k * _BLOCK + 1, i)), F.lit(0)))
        return F.filter(F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), far(i).alias("far"))), lambda s: s["start"] >= s["far"])

    return F.flatten(F.transform(before, block))


def _redrawn(piece: Column, at: Column, found: Column) -> Column:
    """A piece of the text that starts at `at`, with tags for the merged spans that meet it."""
    upto = lambda i: F.when(i == 0, at).otherwise(F.greatest(F.get(found, i - 1)["end"], at))
    cut = lambda a, b: F.substring(piece, a - at + 1, F.greatest(b - a, F.lit(0)))
    parts = F.transform(found, lambda s, i: F.concat(cut(upto(i), s["start"]), F.when(s["start"] >= at, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")))
    last = F.greatest(F.element_at(found, -1)["end"], at)
    return F.when(F.size(found) == 0, piece).otherwise(F.concat(F.array_join(parts, ""), F.substring(piece, last - at + 1, F.lit(_PIECE))))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by its kind in angle brackets; n_chars follows the new text.

    Of spans that overlap, the one that starts first is named and the others only widen it.  The text is redrawn piece by
    piece, each from the spans that meet it, so the time does not grow with spans times length.  Null text stays null;
    repeated rows and rows without a doc_id are masked like all others."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = f"c{cols.index('text')}"
    s, some = F.col("_spans"), F.size("_spans") > 0
    n_blocks = lambda c: F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _BLOCK).cast("int"))
    step = settled(spans(own, at).withColumn("_e", F.when(some, F.transform(s, lambda x: x["end"]))), "_e")
    e = F.col("_e")
    step = settled(step.withColumn("_m", F.when(some, F.transform(n_blocks(e), lambda k: F.array_max(F.slice(e, k * _BLOCK + 1, F.lit(_BLOCK)))))), "_m")
    m = F.col("_m")
    reach = F.transform(m, lambda _, k: F.coalesce(F.array_max(F.slice(m, F.lit(1), k)), F.lit(0)))
    step = settled(step.withColumn("_r", reach), "_r")
    step = settled(step.withColumn("_n", _merged(s, e, F.col("_r"))), "_n")
    n = F.col("_n")
    merged = F.transform(n, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(n, i + 1)["far"], F.array_max(m)).alias("end"), x["kind"].alias("kind")))
    step = settled(step.withColumn("_j", merged), "_j")
    j = F.col("_j")
    blocks = F.transform(n_blocks(j), lambda k: F.struct(F.get(j, k * _BLOCK)["start"].alias("lo"), F.element_at(F.slice(j, k * _BLOCK + 1, F.lit(_BLOCK)), -1)["end"].alias("hi"), k.alias("k")))
    step = step.withColumn("_b", F.when(some, blocks)).withColumn("_t", F.when(some, F.regexp_extract_all(at, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    step = settled(step, "_b", "_t")
    meets = lambda x, k: (x["lo"] < (k + 1) * _PIECE) & (x["hi"] > k * _PIECE)
    inside = lambda x, k: F.filter(F.slice(j, x["k"] * _BLOCK + 1, F.lit(_BLOCK)), lambda y: (y["start"] < (k + 1) * _PIECE) & (y["end"] > k * _PIECE))
    found = F.transform("_t", lambda _, k: F.flatten(F.transform(F.filter("_b", lambda x: meets(x, k)), lambda x: inside(x, k))))
    step = settled(step.withColumn("_o", found), "_o")
    new = F.array_join(F.transform("_t", lambda x, k: _redrawn(x, k * _PIECE, F.get("_o", k))), "")
    done = settled(step.withColumn("_new", new), "_new")
    take = {"text": F.col("_new"), "n_chars": F.length("_new").cast("bigint")}
    return done.select(*[(F.when(some, take[c]).otherwise(F.col(f"c{i}")) if c in take else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])
