"""Column expressions over loosely typed fields: numbers, times, names, redaction, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"


def field(name: str, typed: set[str], bag: str = "attributes") -> Column:
    """A typed column where there is one, else the key of the bag (a map); a missing key is null."""
    return F.col(name) if name in typed else F.try_element_at(F.col(bag), F.lit(name))


def json_field(bag: str, key: str) -> Column:
    """The key of a JSON text as text; null where text or key is missing or broken."""
    return F.get_json_object(F.col(bag), f"$.{key}")


def number_or_null(c: Column, kind: str = "decimal(30,6)") -> Column:
    """Trimmed text as a number; what does not look like one is null, never zero."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast(kind))


def number_of(types: dict[str, str], name: str, kind: str = "decimal(30,6)") -> Column:
    """A column as a number: a numeric column as it is (NaN and infinity are null), any other by its text."""
    t = types.get(name, "string")
    plain = t.startswith("decimal") or t in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return F.col(name).try_cast(kind) if plain else number_or_null(F.col(name), kind)


def dimension(c: Column) -> Column:
    """A group value: trimmed; empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def identity(c: Column) -> Column:
    """One spelling for whole numbers written as text or number, for counting distinct values."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(t, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(F.nullif(t, F.lit("")))


def quantity_class(method: Column, qty: Column, picking: tuple[str, ...]) -> Column:
    """pick, attempt (zero), correction (below zero), non_quantity (another method) or unusable (no number)."""
    return (
        F.when(~F.coalesce(method.isin(*picking), F.lit(False)), "non_quantity")
        .when(qty.isNull(), "unusable")
        .when(qty > 0, "pick")
        .when(qty == 0, "attempt")
        .otherwise("correction")
    )


# How the names of secrets end, and what stands for a value.
SECRET_ENDS = ("credentials", "password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey")
REDACTED = "<redacted>"
#: Levels of objects and lists within a secret's value.
NESTED = 4


def secret_patterns(only_once: bool = True) -> tuple[tuple[str, str], ...]:
    """(pattern, what comes in its place): how pairs of a secret's name and its value are written, from what stands
    around the name and what a value may be: JSON, URL-encoded JSON, and plain text or a form; then logins and tokens
    that need no name.  only_once: by expressions that never go back over a value, and that pass over what is redacted
    (other engines' expressions cannot say either)."""
    hold = "+" if only_once else ""
    name = rf"[\w.-]*(?:{'|'.join(SECRET_ENDS)})"
    edge, fresh = (r"(?<![\w.%-])", f"(?!{REDACTED})") if only_once else (r"\b", "")
    text = rf'"[^"\\]*{hold}(?:\\.[^"\\]*{hold})*{hold}"'
    value = text
    for _ in range(NESTED):  # an object or a list: what lies between, texts, and the level below
        value = rf'[{{\[][^{{}}\[\]"]*{hold}(?:(?:{text}|{value})[^{{}}\[\]"]*{hold})*{hold}[}}\]]'
    json = rf"(?:{text}|{value}|[^\s,;{{}}\[\]\"']+)"
    quoted = r"\"[^\"]*\"|'[^']*'"
    return (
        (rf'(?i)("{name}"\s*:\s*){json}', f'$1"{REDACTED}"'),
        (rf"(?i)(%22{name}%22%3A)(?:%22.*?%22|%7B.*?%7D|[^%&\s\"']+)", f"$1%22{REDACTED}%22"),
        (rf"(?i){edge}({name}=){fresh}(?:{quoted}|[^&\s\"'<>]+)", f"$1{REDACTED}"),
        (rf"(?i){edge}({name}\s*[=:]\s*){fresh}(?:{quoted}|[^\s,;&\"'<>{{}}\[\]]+)", f"$1{REDACTED}"),
        (r"(?i)(\bbearer\s+)[\w.~+/=-]+", f"$1{REDACTED}"),
        (r"(?i)(\bbasic\s+)[A-Za-z0-9+/=]{8,}", f"$1{REDACTED}"),
        (r"(?i)([a-z][a-z0-9+.-]*://[^\s:/@]+:)" + (f"(?!{REDACTED}@)" if only_once else "") + r"[^\s@/]+(@)", f"$1{REDACTED}$2"),
        (r"(\bAKIA)[0-9A-Z]{16}\b", REDACTED),
        (r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", REDACTED),
    )


SENSITIVE = "(?i)(password|passwd|pwd|secret|token|api[_-]?key|credential|authorization|cookie|session)"


def redact(c: Column) -> Column:
    """Text without secrets; redacting twice changes nothing."""
    for pattern, to in secret_patterns():
        c = F.regexp_replace(c, pattern, to)
    return c


def is_sensitive(name: Column) -> Column:
    """Whether a field name is shaped like a credential; such names are never approved on their own."""
    return name.rlike(SENSITIVE)


def drop_sensitive(bag: Column) -> Column:
    return F.map_filter(bag, lambda k, _: ~is_sensitive(k))


def canonical(c: Column, kind: str) -> Column:
    """One spelling for equal values: plain decimals, UTC instants, trimmed text."""
    if kind == "number":
        return plain_number(c.cast("decimal(30,6)"))
    if kind == "time":
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if kind == "map":
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return c.cast("string")


def fingerprint(**cols: tuple[Column, str]) -> Column:
    """A digest of named values; 10 and 10.0 agree, a null differs from an empty text."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit("v"), canonical(c, kind)), F.lit("n"))) for name, (c, kind) in sorted(cols.items())]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def plain_number(c: Column) -> Column:
    """A decimal as text, without an exponent and without idle zeros."""
    t = c.cast("string")
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)


def cut_label(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def excerpt(c: Column, head: int, tail: int) -> Column:
    """The start and the end of a long text."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(" ... "), F.right(c, F.lit(tail))))


def url_query(url: Column) -> Column:
    """The query of a URL as a map of decoded values."""
    q = F.try_parse_url(url, F.lit("QUERY"))
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def last_segment(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1)


def json_or_raw(c: Column) -> Column:
    """JSON text as a map of its fields; other text under the key `raw`."""
    m = F.from_json(c, "map<string,string>")
    return F.when(c.isNull(), F.lit(None)).when(m.isNull() | F.array_contains(F.map_keys(m), "_corrupt_record"), F.create_map(F.lit("raw"), c)).otherwise(m)


def kv_block(c: Column) -> Column:
    """Lines `KEY : VALUE` or `KEY = VALUE` as a map; of equal keys the last counts."""
    line = F.lit(r"(?m)^[ \t]*([A-Za-z0-9_]+)[ \t]*[:=][ \t]*(.*?)[ \t]*$")
    pairs = F.arrays_zip(F.regexp_extract_all(c, line, F.lit(1)).alias("key"), F.regexp_extract_all(c, line, F.lit(2)).alias("value"))
    # Sorted by key and place, a pair counts if the next one has another key: no pair is held against all others.
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    kept = F.filter(placed, lambda p, i: ~p["key"].eqNullSafe(F.get(placed, i + 1)["key"]))
    in_order = F.array_sort(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.map_from_entries(F.transform(in_order, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))


def record_blocks(c: Column) -> Column:
    """The blocks after `Record: n` lines, each as a map."""
    parts = F.split(c, r"(?m)^\s*Record\s*:\s*[0-9]+\s*$")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), kv_block)


def promote(bag: Column, names: list[str]) -> Column:
    """The first non-empty value among names, whatever their case."""
    low = F.transform_keys(bag, lambda k, _: F.lower(k))
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(n.lower()))), F.lit("")) for n in names])


def local_time(ts: Column, tz: Column | str) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), tz)


def local_day(ts: Column, tz: Column | str) -> Column:
    """The calendar day of an instant in a zone."""
    return F.to_date(local_time(ts, tz))


def local_midnight(day: Column, tz: Column | str) -> Column:
    """The instant at which a local day starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def departure_at(date: Column, time: Column, tz: str) -> Column:
    """yyyymmdd and hmm digits of a local clock as an instant; null where they are no time."""
    d, t = F.trim(date.cast("string")), F.lpad(F.trim(time.cast("string")), 4, "0")
    ok = d.rlike("^[0-9]{8}$") & t.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    return F.when(ok, F.to_utc_timestamp(F.try_to_timestamp(F.concat(d, t), F.lit("yyyyMMddHHmm")), tz))


def parse_local(text: Column, tz: str) -> Column:
    """Time text without a zone, read on the tenant's clock."""
    return F.when(F.trim(text).rlike(TIME), F.to_utc_timestamp(F.trim(text).try_cast("timestamp"), tz))


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds, to the microsecond."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1_000_000.0)


def package_pairs(c: Column) -> Column:
    """JSON text of deliveries and packages as an array of structs."""
    return F.from_json(c, "array<struct<DeliveryNumber:string,PackageNumber:string>>")


def outcome(expected: Column, picked: Column) -> Column:
    """exact, over, zeroPick or partial; null when either is missing."""
    return F.when(expected.isNull() | picked.isNull(), F.lit(None).cast("string")).when(picked == expected, "exact").when(picked > expected, "over").when(picked == 0, "zeroPick").when(picked < expected, "partial")


def count_variance(counted: Column, balance: Column, units: float = 2, share: float = 0.1) -> Column:
    """gap, its share of the balance, and whether both thresholds are met."""
    gap = counted - balance
    part = F.when(balance != 0, F.abs(gap) / F.abs(balance))
    return F.struct(gap.alias("gap"), part.alias("share"), ((F.abs(gap) >= units) & (F.coalesce(part, F.lit(1.0)) >= share)).alias("flagged"))


# Words that never make a keyword.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")


def keywords(text: Column) -> Column:
    """All-capital words, capitalised words and dotted terms of a query, lower-cased, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+|[A-Z][A-Za-z0-9]+)\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*STOP) & (F.length(w) > 1)))
