"""Queries of logs, transactions, documents, search and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields as ff
from millrace.operators import docs as dc
from millrace.operators import listing, search
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import logs, shared


def _log_files(spark: SparkSession, d: str) -> DataFrame:
    """events as log text, a file per user group and hour, with continuation lines and lines before the first entry; every
    kind of entry occurs."""
    f = facts(spark, d)
    user = F.when(F.col("row_id") % 4 != 0, F.concat(F.lit("U"), F.col("user_id")))
    k = F.col("row_id") % 11
    said = (
        F.when(k == 3, F.concat(F.lit("MI Program: P"), F.col("user_id") % 5, F.lit("  Transaction: T1  NumberOfRecs: 2")))
        .when(k == 4, F.concat(F.lit("(ReqID = "), F.col("row_id"), F.lit("): MI Program: P1  Transaction: T1     Result: "), F.when(F.col("row_id") % 2 == 0, "OK").otherwise("no record")))
        .when(k == 5, "Stored Procedure Executed is").when(k == 6, "REQUEST BODY: {}")
    )
    said = F.when(said.isNotNull(), said).when(F.col("method") == "click", F.concat(F.lit("REQUEST (ReqID = "), F.col("row_id"), F.lit(") - : http://h/x"))).when(F.col("method") == "purchase", "RESPONSE: done").otherwise(F.concat(F.lit("step "), F.col("method")))
    level = F.when(F.col("method") == "error", "ERROR").otherwise("INFO")
    more = F.when(F.col("row_id") % 5 == 0, "\n   KEY : 1\n  tail").otherwise("")
    by = F.when(k == 3, logs.CALL_METHOD).when(k == 4, logs.RESULT_METHOD).otherwise("Run")
    line = F.concat(logs.as_log(F.col("event_time"), user, (F.col("user_id") % 3).cast("string"), level, said, by), more)
    name = F.concat_ws("-", F.col("user_id") % 8, F.date_format("event_time", "yyyyMMddHH"))
    g = f.groupBy(name.alias("source_file")).agg(F.array_sort(F.collect_list(F.struct("event_time", "row_id", line.alias("line")))).alias("l"))
    return g.select("source_file", F.concat(F.lit("before\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return logs.classify_entry(logs.parse_header(logs.split_entries(_log_files(spark, d))))


@query(
    "log_entries",
    """WITH r AS (SELECT *, (user_id % 8) || '-' || strftime(ts, '%Y%m%d%H') AS source_file, event_id % 11 AS k, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 1 END AS lines FROM events)
SELECT source_file, (2 + coalesce(sum(lines) OVER (PARTITION BY source_file ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line_number, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at,
CASE WHEN event_id % 4 <> 0 THEN 'U' || user_id END AS user_ctx, (user_id % 3)::VARCHAR AS thread,
CASE WHEN event_type = 'error' THEN 'error' WHEN k = 3 THEN 'call' WHEN k = 4 THEN 'result' WHEN k = 5 THEN 'sql' WHEN k = 6 THEN 'request_body' WHEN event_type = 'click' THEN 'request' WHEN event_type = 'purchase' THEN 'response' ELSE 'info' END AS entry_type,
CASE WHEN k = 4 OR (event_type = 'click' AND k NOT IN (3, 5, 6)) THEN event_id::VARCHAR END AS request_id,
CASE WHEN event_type = 'error' THEN CASE k WHEN 3 THEN 'MI Program: P' || user_id % 5 || '  Transaction: T1  NumberOfRecs: 2' WHEN 4 THEN '(ReqID = ' || event_id || '): MI Program: P1  Transaction: T1     Result: ' || CASE WHEN event_id % 2 = 0 THEN 'OK' ELSE 'no record' END
  WHEN 5 THEN 'Stored Procedure Executed is' WHEN 6 THEN 'REQUEST BODY: {}' ELSE 'step error' END WHEN k = 4 THEN CASE WHEN event_id % 2 = 0 THEN 'OK' ELSE 'no record' END END AS result_status,
CASE WHEN k = 3 THEN 'P' || user_id % 5 || '.T1' WHEN k = 4 THEN 'P1.T1' END AS call, CASE WHEN event_id % 5 = 0 THEN '   KEY : 1' || chr(10) || '  tail' ELSE '' END AS body FROM r""",
)
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("source_file", "line_number", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "user_ctx", "thread", "entry_type", "request_id", "result_status", "call", "body")


@query(
    "log_file_entries",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at, event_type AS method, CASE WHEN event_id % 3 = 0 THEN 'props' || chr(10) || chr(10) || coalesce(props, '') ELSE '' END AS body, 1 AS n FROM events""",
)
def log_file_entries(spark: SparkSession, d: str) -> DataFrame:
    """events written as log files in order of time and read back by ranges."""
    f = facts(spark, d)
    text = logs.as_log(F.col("event_time"), F.lit("U"), F.lit("1"), F.lit("INFO"), F.col("row_id").cast("string"), F.col("method"))
    more = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("\nprops\n\n"), F.coalesce("props", F.lit("")))).otherwise("")
    path = shared.shared_dir(spark, "logs")
    f.select(F.concat(text, more).alias("value"), "event_time").repartitionByRange("event_time").sortWithinPartitions("event_time").select("value").write.text(path)
    e = logs.parse_header(logs.read_log_entries(spark, path))
    got = e.groupBy(F.col("message").cast("long").alias("event_id"), "at", "method", "body").agg(F.count("*").cast("int").alias("n"))
    return got.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("stitched_transactions")
def stitched_transactions(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select(F.col("source_file").alias("server"), F.col("line_number").alias("row_id"), "at", "thread", "user_ctx", "entry_type", "request_id", "result_status", "level")
    got = logs.stitch(e).join(e.select("server", "row_id", "at", "entry_type", "result_status", "level"), ["server", "row_id"])
    return logs.summarise(got)


@query(
    "stamped_transactions",
    """WITH c AS (SELECT conv_id, turn, role, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS seen FROM conversations)
SELECT 's:' || conv_id AS txn, count(*) AS lines, CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'incomplete' WHEN count(*) FILTER (role = 'system') > 0 THEN 'soft' ELSE 'success' END AS status, (epoch_ms(max(seen)) - epoch_ms(min(seen)))::BIGINT AS duration_ms FROM c GROUP BY 1""".replace("GROUP BY 1", "GROUP BY conv_id"),
)
def stamped_transactions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 60 + F.col("turn"))
    e = c.select(F.lit("s").alias("server"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), at.alias("at"), F.col("conv_id").cast("string").alias("request_id"),
                 F.when(F.col("role") == "assistant", "response").otherwise("info").alias("entry_type"), F.lit(None).cast("string").alias("result_status"), F.when(F.col("role") == "system", "WARN").otherwise("INFO").alias("level"))
    got = logs.stitch_stamped(e).join(e.drop("server"), "row_id")
    return logs.summarise(got).select("txn", "lines", "status", "duration_ms")


@query(
    "sealed_transactions",
    """WITH t AS (SELECT user_id, date_trunc('hour', ts) AS h, max(ts) AS ended, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'success' ELSE 'incomplete' END AS status FROM events GROUP BY 1, 2),
n AS (SELECT *, epoch(date_trunc('second', max(ended) OVER (PARTITION BY user_id))) - epoch(date_trunc('second', ended)) AS quiet FROM t)
SELECT user_id, strftime(h, '%Y-%m-%d %H') AS hour, (quiet >= CASE WHEN status = 'incomplete' THEN 3600 ELSE 900 END)::INT AS sealed FROM n""",
)
def sealed_transactions(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d).groupBy("user_id", F.date_format("event_time", "yyyy-MM-dd HH").alias("hour")).agg(F.max("event_time").alias("ended_at"), F.when(F.count_if(F.col("method") == "purchase") > 0, "success").otherwise("incomplete").alias("status"))
    return logs.seal(t, ["user_id"]).select("user_id", "hour", "sealed")


@query("expired_partitions", "WITH p AS (SELECT DISTINCT ts::DATE AS part FROM events) SELECT strftime(part, '%Y-%m-%d') AS part FROM p WHERE part + 1 <= DATE '2024-01-21' AND NOT (TIMESTAMP '2024-01-05 10:00:00' < part + 1 AND TIMESTAMP '2024-01-07 01:00:00' >= part)")
def expired_partitions(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("event_time")
    parts = facts(spark, d).select(day.alias("part"), F.date_add(day, 1).alias("part_end")).distinct()
    holds = spark.range(1).select(F.lit("2024-01-05 10:00:00").cast("timestamp").alias("lo"), F.lit("2024-01-07 01:00:00").cast("timestamp").alias("hi"))
    return shared.expired_partitions(parts, holds, F.lit("2024-01-31").cast("timestamp"), 10).select(F.date_format("part", "yyyy-MM-dd").alias("part"))


@query("partitioned_write", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS part, count(*) AS n FROM events GROUP BY 1")
def partitioned_write(spark: SparkSession, d: str) -> DataFrame:
    """Written twice; the second write overwrites only the weeks that it holds."""
    path, f = shared.shared_dir(spark, "partitioned"), facts(spark, d)
    shared.write_partitioned(f, "event_time", "week", path)
    shared.write_partitioned(f.filter("event_time >= TIMESTAMP '2024-01-15'"), "event_time", "week", path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("string").alias("part")).agg(F.count("*").alias("n"))


@query("min_live_position", "SELECT min(o_orderkey) AS position, count(*) AS live FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def min_live_position(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d).select(F.col("o_orderkey").alias("position"), F.col("at").alias("updated_at"))
    now = F.lit("2001-12-31").cast("timestamp")
    return shared.min_live_position(c, now, 364 * 86400)


@query("purge_range", "SELECT event_type AS method, count(*) AS n FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND user_id < 50) GROUP BY 1")
def purge_range(spark: SparkSession, d: str) -> DataFrame:
    gone = F.expr("event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12' AND user_id < 50")
    return shared.purge(facts(spark, d), gone).groupBy("method").agg(F.count("*").alias("n"))


@query("url_fields", "SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '([^/]*)$', 1) AS last FROM pages")
def url_fields(spark: SparkSession, d: str) -> DataFrame:
    q = ff.url_query(F.col("url"))
    get = lambda k: F.coalesce(F.try_element_at(q, F.lit(k)), F.lit(""))
    return table(spark, d, "pages").select("page_id", get("page").alias("page"), get("ref").alias("ref"), ff.last_segment(F.col("url")).alias("last"))


@query("json_or_raw", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props->>'$.k' END AS k, CASE WHEN event_id % 2 = 1 THEN event_type END AS raw FROM events")
def json_or_raw(spark: SparkSession, d: str) -> DataFrame:
    m = ff.json_or_raw(F.when(F.col("row_id") % 2 == 0, F.col("props")).otherwise(F.col("method")))
    return facts(spark, d).select(F.col("row_id").alias("event_id"), F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("raw")).alias("raw"))


def _redacted_sql() -> str:
    """The redaction by DuckDB's expressions, which do not look around: a name starts at a word's edge there."""
    sql = "text"
    for pattern, to in ff.secret_patterns(only_once=False):
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, pattern.replace("'", "''"), to.replace("$", "\\"))
    return sql


@query(
    "redacted_texts",
    f"WITH r AS (SELECT doc_id, {_redacted_sql()} AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM r",
)
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", ff.redact(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(F.encode("t", "utf-8")).alias("digest"))


@query("quantity_classes", "SELECT CASE WHEN l_returnflag <> 'N' THEN 'non_quantity' WHEN l_quantity - 20 > 0 THEN 'pick' WHEN l_quantity - 20 = 0 THEN 'attempt' ELSE 'correction' END AS class, count(*) AS n FROM lineitem GROUP BY 1")
def quantity_classes(spark: SparkSession, d: str) -> DataFrame:
    c = ff.quantity_class(F.col("l_returnflag"), F.col("quantity") - 20, ("N",))
    return calls(spark, d).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(
    "normalised_facts",
    "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no number' WHEN o_totalprice < 20000 THEN 'too small' WHEN o_orderstatus = 'P' THEN 'pending' END AS reason FROM orders",
)
def normalised_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts (without a reason) and quarantine of one plan."""
    reasons = {"no number": F.col("total").isNull(), "too small": F.col("total") < 20000, "pending": F.col("o_orderstatus") == "P"}
    facts_, issues = listing.normalise(orders(spark, d), reasons, "o_orderkey")
    return facts_.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(issues)


@query("capped_names", "SELECT p_partkey, left(p_name, 8) AS p_name, left(p_brand, 3) AS p_brand, (length(p_name) > 8)::INT + (length(p_brand) > 3)::INT AS n_cut FROM part")
def capped_names(spark: SparkSession, d: str) -> DataFrame:
    return listing.cap_length(table(spark, d, "part"), {"p_name": 8, "p_brand": 3}).select("p_partkey", "p_name", "p_brand", "n_cut")


@query("excerpts", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 40) || ' ... ' || right(text, 20) END AS excerpt FROM documents")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ff.excerpt(F.col("text"), 40, 20).alias("excerpt"))


@query("page_documents", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>'))::INT AS n_headings FROM pages")
def page_documents(spark: SparkSession, d: str) -> DataFrame:
    return dc.read_documents(table(spark, d, "pages")).select("page_id", "title", "n_headings")


@query(
    "documents_by_type",
    """SELECT 'p' || page_id AS id, 'html' AS kind, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>'))::INT AS n_headings FROM pages
UNION ALL SELECT 'd' || doc_id, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' END, CASE WHEN doc_id % 3 = 0 THEN nullif(regexp_extract(text, '(?m)^(#{1,6})[ \\t]+(.+?)[ \\t]*$', 2), '') END,
CASE WHEN doc_id % 3 = 0 THEN len(regexp_extract_all(text, '(?m)^(#{1,6})[ \\t]+(.+?)[ \\t]*$'))::INT ELSE 0 END FROM documents""",
)
def documents_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Pages, marked-up and plain texts, and files of a type that is not read, in one form."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("doc_id"), F.lit("text/html; charset=utf-8").alias("mime"), F.col("html").alias("content"))
    mime = F.element_at(F.array(F.lit("text/markdown"), F.lit("TEXT/PLAIN"), F.lit("application/pdf")), (F.col("doc_id") % 3 + 1).cast("int"))
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), mime.alias("mime"), F.col("text").alias("content"))
    return dc.uniform(pages.unionByName(texts)).select(F.col("doc_id").alias("id"), "kind", "title", F.size("headings").alias("n_headings"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """pages as marked-up text: each heading tag as a line of marks."""
    head = F.regexp_replace(F.col("html"), r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", "\n<p>H$1 $2</p>\n")
    t = dc.html_text(head)
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?m)^H{n} ", "#" * n + " ")
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), t.alias("text"))


@query("page_sections")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return dc.sections(_marked(spark, d))


@query("page_chunks")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    secs = dc.sections(_marked(spark, d))
    return dc.embed_rows(dc.smallest(dc.chunk(secs, most_tokens=128, overlap_tokens=16)), secs, "doc_id")


@query("merged_chunks")
def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dc.merge_small(dc.smallest(dc.chunk(dc.sections(_marked(spark, d)), most_tokens=64, overlap_tokens=0)), "doc_id")


_SCORES = ", ".join(f"({' + '.join(f'''contains(lower(text), '{w}')::INT''' for w in ws)}) AS s_{k}" for k, ws in dc.PROFILES.items())
_BEST = "greatest(" + ", ".join(f"s_{k}" for k in dc.PROFILES) + ")"


@query("document_profiles", f"WITH s AS (SELECT doc_id, {_SCORES} FROM documents) SELECT doc_id, CASE WHEN {_BEST} < 1 THEN 'other' {' '.join(f'''WHEN s_{k} = {_BEST} THEN '{k}' ''' for k in dc.PROFILES)} END AS profile, {_BEST} AS score FROM s")
def document_profiles(spark: SparkSession, d: str) -> DataFrame:
    return dc.profile(table(spark, d, "documents"), least=1)


_COSINE = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), "embedding", "label")


@query("nearest_vectors", f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank FROM r WHERE rank <= 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(*_vectors(spark, d), 10).select("query_id", "id", "rank")


@query("hybrid_search", f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COSINE} AS score FROM embeddings q, embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE q.vec_id % 100 = 0 AND list_contains(regexp_split_to_array(lower(d.text), '[^\\p{{L}}\\p{{N}}]+'), 'the')), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank FROM r WHERE rank <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.hybrid(q, v.join(texts, "id"), 5, ["The"]).select("query_id", "id", "rank")


_STOPS = ", ".join(f"'{w}'" for w in ff.STOP)


@query(
    "keyword_hits",
    f"""WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-Za-z0-9]+(?:\\.[A-Za-z0-9]+)+|[A-Z][A-Za-z0-9]+)\\b', 1), lambda w: lower(w)), lambda w: w NOT IN ({_STOPS}) AND length(w) > 1)) AS words FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(list_filter(flatten(list_transform(words, lambda w: regexp_split_to_array(w, '[^\\p{{L}}\\p{{N}}]+'))), lambda w: w <> '')) AS words FROM k),
d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS tokens FROM documents)
SELECT conv_id, turn, count(*) AS hits, min(doc_id) AS first_hit FROM t JOIN d ON len(words) > 0 AND list_has_all(tokens, words) GROUP BY conv_id, turn""",
)
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation as a query with its own keywords: the documents that hold them all."""
    q = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), ff.keywords(F.col("text")).alias("words"))
    hits = search.count_holding_all(q, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return hits.select("query_id.*", "hits", "first_hit")


@query("query_keywords")
def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(ff.keywords(F.col("text")), " ").alias("words"))


@query("exploded_lines", "SELECT doc_id, count(*) AS records FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 1")
def exploded_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("record_index", "line")).filter("line <> ''")
    return rows.groupBy("doc_id").agg(F.count("*").alias("records"))
