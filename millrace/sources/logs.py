"""Log text to entries, entries to transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.stitching import stitch as stitch

# The shapes of an entry's start, its header, and what its message says.
STARTS = r"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} )"
OPENS = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} "
HEADER = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \((.*?)\) \[([^\]]*)\] (\w+)\s+(\S+) (\S+) - (.*)$"
BRACKET = r"(?s)^(REQUEST BODY|REQUEST|RESPONSE)(?: \(ReqID = ([^)]*)\))?(?: -)?\s*:\s?(.*)$"
RESULT = r"(?s)MI Program:\s*(\S+)\s+Transaction:\s*(\S+)\s+Result:\s*(.*)$"
CALL = r"MI Program:\s*(\S+)\s+Transaction:\s*(\S+)"
CALL_METHOD, RESULT_METHOD = "LogAPICall", "LogAPIResult"
SQL_TEXT = "Stored Procedure Executed is"
NULL_USERS = ("", "(null)", "null")


def split_entries(files: DataFrame, text: str = "value", source: str = "source_file") -> DataFrame:
    """source, nr, line_number, raw of each entry: a line that starts with a time opens one, other lines continue it,
    and what stands before the first is dropped."""
    t = F.regexp_replace(F.col(text), "\r\n?|\u0085| | ", "\n")
    parts = files.select(F.col(source).alias("source_file"), F.posexplode(F.split(t, STARTS)).alias("nr", "raw"))
    w = Window.partitionBy("source_file").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"))) + 1
    at = parts.withColumn("line_number", F.coalesce(F.sum(lines).over(w), F.lit(0)) + 1)
    return at.filter(F.col("raw").rlike(OPENS))


def read_log_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of log files below a path, which are cut into ranges like any other text: no file meets in one row or task."""
    at = F.col("_metadata")
    lines = spark.read.text(path).select(at["file_path"].alias("source_file"), at["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("pos"), "value")
    return entries_of_lines(lines)


def entries_of_lines(lines: DataFrame) -> DataFrame:
    """source_file, line_number, raw of each entry of lines (value) that are ordered by range of a file (part) and inside it (pos).

    Entries are told apart inside each range.  What stands in a range before its first header belongs to the last entry of the
    nearest earlier range that has a header; counts of lines and headers by range, summed over a file's ranges, number the lines.
    Only these pieces move between ranges.  A null line is an empty one; an entry must fit a row (2 GB)."""
    cut = F.posexplode(F.split(F.coalesce("value", F.lit("")), "[\u0085\u2028\u2029]")).alias("sub", "line")
    cut_lines = lines.select("source_file", "part", "pos", cut).withColumn("opens", F.col("line").rlike(OPENS).cast("long"))
    inside = Window.partitionBy("source_file", "part").orderBy("pos", "sub")
    placed = cut_lines.select("source_file", "part", F.row_number().over(inside).alias("n"), F.sum("opens").over(inside).alias("k"), "line")
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut_lines.groupBy("source_file", "part").agg(F.count("*").alias("lines"), F.sum("opens").alias("heads"))
    ranges = ranges.select(
        "source_file", "part", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"),
        F.last(F.when(F.col("heads") > 0, F.struct("part", "heads")), ignorenulls=True).over(earlier).alias("owner"),
    )
    joined = lambda of, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of))), lambda x: x[of]), "\n")
    pieces = placed.groupBy("source_file", "part", "k").agg(F.min("n").alias("n"), joined("line", "n").alias("raw")).join(ranges, ["source_file", "part"])
    tails = pieces.filter("k = 0 AND owner IS NOT NULL").groupBy(F.col("source_file").alias("_file"), F.col("owner.part").alias("_part"))
    tails = tails.agg(F.max("owner.heads").alias("_last"), joined("raw", "part").alias("tail"))
    # A range's entries are numbered from 1 on, so that only its last one reaches the number of its headers.
    own = (F.col("source_file") == F.col("_file")) & (F.col("part") == F.col("_part")) & (F.col("k") >= F.col("_last"))
    return pieces.filter("k > 0").join(tails, own, "left").select("source_file", (F.col("before") + F.col("n")).alias("line_number"), F.concat_ws("\n", "raw", "tail").alias("raw"))


def parse_header(entries: DataFrame) -> DataFrame:
    """entries with at, user_ctx, thread, level, logger, method, message (its first line) and body (the lines behind it)."""
    part = lambda k: F.regexp_extract("raw", HEADER, k)
    said = F.split(part(7), "\n", 2)
    user = F.trim(part(2))
    return entries.select(
        "*",
        F.try_to_timestamp(F.replace(F.nullif(part(1), F.lit("")), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("at"),
        F.when(~F.lower(user).isin(*NULL_USERS), user).alias("user_ctx"),
        part(3).alias("thread"), part(4).alias("level"), part(5).alias("logger"), part(6).alias("method"), F.trim(F.get(said, F.lit(0))).alias("message"), F.coalesce(F.get(said, F.lit(1)), F.lit("")).alias("body"),
    )


def classify_entry(entries: DataFrame) -> DataFrame:
    """entries with entry_type, request_id, result_status and call (program and transaction); an ERROR level comes before
    all else, then the message's bracket, then the method that logs calls and results, then stored procedures."""
    kind = F.regexp_extract("message", BRACKET, 1)
    stamp = F.coalesce(F.nullif(F.regexp_extract("message", BRACKET, 2), F.lit("")), F.nullif(F.regexp_extract("message", r"^\(ReqID = ([^)]*)\)", 1), F.lit("")))
    result = F.col("method") == RESULT_METHOD
    named = F.when(F.col("method").isin(CALL_METHOD, RESULT_METHOD) & F.col("message").rlike(CALL), F.concat_ws(".", F.regexp_extract("message", CALL, 1), F.regexp_extract("message", CALL, 2)))
    type_ = (
        F.when(F.col("level") == "ERROR", "error")
        .when(kind == "REQUEST", "request").when(kind == "REQUEST BODY", "request_body").when(kind == "RESPONSE", "response")
        .when(F.col("method") == CALL_METHOD, "call").when(result, "result").when(F.contains("message", F.lit(SQL_TEXT)), "sql").otherwise("info")
    )
    status = F.when(F.col("level") == "ERROR", F.trim("message")).when(result, F.nullif(F.trim(F.regexp_extract("message", RESULT, 3)), F.lit("")))
    return entries.select("*", type_.alias("entry_type"), stamp.alias("request_id"), status.alias("result_status"), named.alias("call"))


def reclassify(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries whose kind changes under the parser of today; the range of time that they touch)."""
    now = classify_entry(stored.withColumnRenamed("entry_type", "old_type").drop("request_id", "result_status", "call"))
    changed = now.filter(~F.col("old_type").eqNullSafe(F.col("entry_type")))
    return changed, changed.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


def stitch_stamped(entries: DataFrame) -> DataFrame:
    """The same for logs in which every line carries a request id: no group meets in Python."""
    w = Window.partitionBy("server", "request_id").orderBy(F.col("at").asc_nulls_last(), "row_id")
    return entries.select("server", "row_id", F.concat_ws(":", "server", "request_id").alias("txn"), F.row_number().over(w).alias("seq"))


def summarise(lines: DataFrame) -> DataFrame:
    """A transaction's row from its lines: times, counts, status error > incomplete > soft > success."""
    soft = F.coalesce(((F.col("entry_type") == "result") & (F.col("result_status") != "OK")) | (F.col("level") == "WARN"), F.lit(False))
    g = lines.groupBy("txn").agg(
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("lines"), F.count_if(F.col("entry_type") == "error").alias("errors"),
        F.count_if(F.col("entry_type") == "response").alias("responses"), F.count_if(soft).alias("softs"),
    )
    status = F.when(F.col("errors") > 0, "error").when(F.col("responses") == 0, "incomplete").when(F.col("softs") > 0, "soft").otherwise("success")
    ms = F.unix_millis("ended_at") - F.unix_millis("started_at")
    return g.withColumn("duration_ms", ms).withColumn("status", status)


def seal(txns: DataFrame, by: list[str], seal_s: int = 900, abandon_s: int = 3600) -> DataFrame:
    """txns with sealed, against the newest time of the data themselves: terminal ones after seal_s, others after abandon_s."""
    newest = txns.groupBy(*by).agg(F.max("ended_at").alias("_now"))
    quiet = F.unix_timestamp("_now") - F.unix_timestamp("ended_at")
    sealed = F.when(F.col("status") == "incomplete", quiet >= abandon_s).otherwise(quiet >= seal_s)
    return txns.join(newest, by).withColumn("sealed", F.coalesce(sealed, F.lit(False)).cast("int")).drop("_now")


def as_log(at: Column, user: Column, thread: Column, level: Column, message: Column, method: Column | None = None) -> Column:
    """One entry as log text."""
    by = F.concat(F.lit(" app.Service "), F.lit("Run") if method is None else method, F.lit(" - "))
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ("), F.coalesce(user, F.lit("(null)")), F.lit(") ["), thread, F.lit("] "), level, by, message)
