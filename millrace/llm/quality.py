"""Quality rules, line first: failing lines are removed, then documents that lose too much are rejected.

Every step is a DataFrame expression over one row, so a document never leaves its partition and no shuffle
happens.  A line is judged by the first rule that it fails:

* punctuation: marks make up over a quarter of its visible characters, or exclamation marks outnumber half its words;
* navigation: three or more `|` or `>` separators, or nothing but a menu word;
* boilerplate: a phrase of cookie banners, rights notices and script warnings.

Null text counts as empty: no words, nothing found, not kept.  Rows are judged one by one, so repeated rows get
equal verdicts and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settled, text_col, words_of

# The menu words and phrases that the line rules look for.
MENU = (
    "home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "back to top",
    "skip to content", "share", "tweet", "search", "contact us", "about us", "read more",
)
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of service",
    "terms of use", "enable javascript", "subscribe to our newsletter", "lorem ipsum", "click here",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules: shares in per cent."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_mark_pct: int = 25
    max_separators: int = 2
    min_left_pct: int = 70


MARKS = "#*$%&|<>{}[]=_~^\\"
_MARK_CLASS = r"[#*$%&|<>{}\[\]=_~^\\]"
_WHITE_CLASS = "[\t-\r ]+"


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def line_fault(line: Column, some_boilerplate: Column, rules: LineRules = LineRules()) -> Column:
    """The rule that a line fails (null: it passes; lines without a word pass).

    Counts are only made for lines that hold a mark or an exclamation mark at all, and phrases are only looked for in
    documents that hold one.
    """
    low = F.lower(F.trim(line))
    bare = F.length(_without(line, _WHITE_CLASS))
    marks = F.length(line) - F.length(_without(line, _MARK_CLASS + "+"))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!")))
    bars = F.length(line) - F.length(_without(line, "[|>]+"))
    n_words = F.size(F.split(F.trim(line), " +"))
    odd = F.when(marks * 100 > bare * rules.max_mark_pct, "punctuation").when((shouts > 0) & (shouts * 2 > n_words), "punctuation").when(bars > rules.max_separators, "navigation")
    marked = F.when(line.rlike("[!" + _MARK_CLASS[1:]), odd)
    return F.coalesce(marked, F.when(F.rtrim(low, F.lit(".!: ")).isin(*MENU), "navigation").when(some_boilerplate & low.rlike("|".join(BOILERPLATE)), "boilerplate"))


def measures(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with `_q`, a struct of counts and verdicts, and `_clean`, the text without its failing lines."""
    t = F.col("_t")
    step = docs.withColumn("_t", text_col(text))
    step = step.withColumn("_words", words_of(t)).withColumn("_lines", F.split(t, "\n", -1))
    low, some = F.lower(t), F.lit(False)
    for phrase in BOILERPLATE:
        some = some | F.contains(low, F.lit(phrase))
    step = settled(step.withColumn("_boiler", some), "_t", "_words", "_lines", "_boiler").withColumn("_n", F.size("_words"))
    words, n = F.col("_words"), F.col("_n")
    step = step.withColumn(
        "_h",
        F.when(
            n >= 3,
            F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    h = F.col("_h")
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_s")
    # Hashes that occur twice or more; few of them are looked up one by one, many by position in the sorted order.
    step = step.withColumn("_twice", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    step = step.withColumn(
        "_pairs",
        F.when(F.size("_twice") > 64, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    pairs = F.col("_pairs")
    at = (
        F.when(F.size("_twice") == 0, F.array().cast("array<int>"))
        .when(pairs.isNull(), F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i)), lambda i: i.isNotNull()))
        .otherwise(
            F.sort_array(
                F.transform(
                    F.filter(pairs, lambda x, k: ((k > 0) & (x["h"] == F.get(pairs, k - 1)["h"])) | (x["h"] == F.get(pairs, k + 1)["h"])),
                    lambda x: x["i"],
                )
            )
        )
    )
    step = step.withColumn("_at", at)
    pos = F.col("_at")
    covered = F.aggregate(
        F.transform(pos, lambda p, k: F.coalesce(F.least(F.get(pos, k + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    step = step.withColumn("_wordy", F.filter("_lines", lambda x: x.rlike("[^\t-\r ]"))).withColumn("_repeat", covered)
    judged = F.transform("_lines", lambda x: F.struct(x.alias("x"), F.coalesce(line_fault(x, F.col("_boiler"), rules), F.lit("")).alias("fault")))
    step = settled(step.withColumn("_judged", judged), "_judged", "_repeat", "_wordy", "_n")
    step = step.withColumn("_clean", F.array_join(F.transform(F.filter("_judged", lambda j: j["fault"] == ""), lambda j: j["x"]), "\n"))
    count = lambda rule: F.size(F.filter("_judged", lambda j: j["fault"] == rule)).cast("bigint")
    chars = F.length(F.array_join("_words", "")).cast("bigint")
    whole = ~F.exists("_judged", lambda j: j["fault"] != "")
    left = F.when(whole, chars).otherwise(F.length(_without(F.col("_clean"), _WHITE_CLASS)).cast("bigint"))
    failed = (n < rules.min_words) | (F.col("_repeat") * 100 > n * rules.max_repeat_pct)
    out = F.struct(
        n.cast("bigint").alias("n_words"),
        chars.alias("word_chars"),
        (F.length(t) - F.length(_without(t, "[#*$%&|<>]+"))).cast("bigint").alias("n_symbols"),
        (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (left * 100 >= chars * rules.min_left_pct)).alias("kept"),
        left.alias("clean_chars"),
        count("punctuation").alias("n_punctuation_lines"),
        count("navigation").alias("n_navigation_lines"),
        count("boilerplate").alias("n_boilerplate_lines"),
    )
    return settled(step.withColumn("_q", out), "_q", "_clean")


def quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    return measures(docs.select("doc_id", "text"), "text", rules).select("doc_id", "_q.*")


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed; n_chars, where there, follows the new text."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = cols.index("text")
    done = measures(own, f"c{at}", rules).filter("_q.kept")
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("bigint")}
    return done.select(*[(new[c] if c in new else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])


def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_R = LineRules()
_SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\t-\\r ]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '[\\t-\\r ]*')) AS wordy FROM d),
n AS (SELECT *, len(ws) AS n_words FROM w),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT rid, ws, unnest(range(1, n_words - 1)) AS i FROM n WHERE n_words >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS c FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, x, length(translate(x, {_SQL_WHITE}, '')) AS bare, lower(trim(x, ' ')) AS low,
  length(translate(translate(x, '{MARKS}', ''), {_SQL_WHITE}, '')) AS unmarked,
  length(x) - length(replace(x, '!', '')) AS shouts, length(x) - length(translate(x, '|>', '')) AS bars,
  len(regexp_split_to_array(trim(x, ' '), ' +')) AS nw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT rid, bare, CASE WHEN bare = 0 THEN ''
  WHEN (bare - unmarked) * 100 > bare * {_R.max_mark_pct} OR (shouts > 0 AND shouts * 2 > nw) THEN 'p'
  WHEN bars > {_R.max_separators} OR rtrim(low, '.!: ') IN ({_sql_list(MENU)}) THEN 'n'
  WHEN regexp_matches(low, '{"|".join(BOILERPLATE)}') THEN 'b' ELSE '' END AS fault FROM lines),
a AS (SELECT rid, sum(CASE WHEN fault = '' THEN bare ELSE 0 END)::BIGINT AS clean_chars, sum(bare)::BIGINT AS word_chars,
  count(*) FILTER (fault = 'p') AS n_punctuation_lines, count(*) FILTER (fault = 'n') AS n_navigation_lines,
  count(*) FILTER (fault = 'b') AS n_boilerplate_lines FROM f GROUP BY rid),
z AS (SELECT doc_id, n_words, word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(wordy) - len(list_distinct(wordy)) AS n_dup_lines, coalesce(cov.c, 0) AS n_repeat_words, clean_chars,
  n_punctuation_lines, n_navigation_lines, n_boilerplate_lines
  FROM n JOIN a USING (rid) LEFT JOIN cov USING (rid))
SELECT *, n_words < {_R.min_words} OR n_repeat_words * 100 > n_words * {_R.max_repeat_pct} AS base_failed,
  NOT (n_words < {_R.min_words} OR n_repeat_words * 100 > n_words * {_R.max_repeat_pct})
  AND clean_chars * 100 >= word_chars * {_R.min_left_pct} AS kept FROM z
"""
