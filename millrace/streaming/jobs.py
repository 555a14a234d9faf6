"""Streaming forms: incremental reads, sealing, digests, rules, caps, late data and watches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.fields import redact
from millrace.operators import diff
from millrace.sources.shared import shared_dir
from millrace.sources.tables import packed, unpacked
from millrace.sources.versioned import Buckets


#: Streams keep their state in RocksDB: maps and timers need it, and it may pass the executors' memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, path: str, at: str, columns: dict[str, Column], per_trigger: int | None = None) -> DataFrame:
    """A table, a file or a folder of part files, as a stream; `at` becomes an instant.

    Parts need not be in the order of time: without per_trigger all that are there come in one batch, so that no
    watermark moves between them."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true")
    raw = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)
    return raw.select(F.col(at).cast("timestamp").alias("at"), *[c.alias(n) for n, c in columns.items()])


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table in the shared folder, and read it."""
    stream.sparkSession.conf.set(*STATE_STORE)
    spark, root = stream.sparkSession, shared_dir(stream.sparkSession, purpose)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def run_batches(stream: DataFrame, purpose: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run each micro-batch through a function."""
    root = shared_dir(stream.sparkSession, purpose)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


_CAPPED = "at timestamp, key bigint, title string, kind string, held bigint"


class HourlyCap(StatefulProcessor):
    """Of each clock hour of a group the first `cap` findings are sent, the others held; the first one held gives a notice, and when
    the watermark has passed the hour, one summary tells how many were held.  A key is a group's hour: its state goes with the
    summary, and of its findings of a batch only the first ones are held while they are read."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "sent bigint, held bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, held = self.told.get() if self.told.exists() else (0, 0)
        room = max(0, self.cap - sent)
        first, n = None, 0
        for f in rows:
            first = (f if first is None else pd.concat([first, f])).sort_values(["at", "key"], kind="stable").head(room + 1)
            n += len(f)
        if not n:
            return
        if not sent + held:
            self.handle.registerTimer((int(key[1]) + 1) * 3_600_000)
        out = [(r.at, r.key, r.title, "sent", 0) for r in first.head(room).itertuples(index=False)]
        over = n - min(room, n)
        if over and not held:
            out.append((first.iloc[room]["at"], None, key[0], "notice", 0))
        self.told.update((sent + min(room, n), held + over))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            _, held = self.told.get()
            self.told.clear()
            if held:
                yield self._frame([(pd.Timestamp((int(key[1]) + 1) * 3600, unit="s"), None, key[0], "summary", held)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["at", "key", "title", "kind", "held"]).astype({"key": "Int64", "held": "int64"})

    def close(self) -> None:
        pass


def capped(stream: DataFrame, group: str, cap: int, lag: str = "2 hours") -> DataFrame:
    """Findings (at, key, title, group) as what is told: sent, notice (title: the group) and summary (held: how many).  A finding that comes
    after its hour's summary, lag behind the newest one, is not told."""
    rows = stream.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), "at", F.col("key").cast("bigint").alias("key"), F.col("title").cast("string").alias("title")).filter("at IS NOT NULL")
    rows = rows.withColumn("hour", F.floor(F.unix_micros("at") / 3_600_000_000))
    return rows.withWatermark("at", lag).groupBy("group", "hour").transformWithStateInPandas(HourlyCap(cap), _CAPPED, "Append", "EventTime")


def late_buckets(stream: DataFrame, buckets: Buckets, keys: list[str], digest_col: str) -> DataFrame:
    """What each batch of late rows changes in a table of buckets (its columns and action): a batch reads and replaces the buckets that
    its rows lie in, and no others.  Version 0 is the table as it was, version n + 1 what batch n leaves."""
    spark = stream.sparkSession
    run_batches(stream, "late-state", lambda batch, n: buckets.merge(batch, keys, digest_col, n + 1, n) and None)
    return spark.read.schema(f"{buckets.schema}, action string").option("recursiveFileLookup", "true").parquet(f"{buckets.root}/changes")


def incremental(stream: DataFrame, lag: str, keys: list[str]) -> DataFrame:
    """New rows once each: duplicates within the lag of the watermark are dropped; source offsets are the cursor."""
    return stream.withWatermark("at", lag).dropDuplicatesWithinWatermark(keys)


def digest(stream: DataFrame, width: str, lag: str = "10 minutes") -> DataFrame:
    """Rows per complete tumbling window and method, emitted when the watermark has passed the window."""
    g = stream.withWatermark("at", lag).groupBy(F.window("at", width), "method").agg(F.count("*").alias("n"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "method", "n")


def leading(digests: DataFrame, k: int = 5) -> DataFrame:
    """The k leading methods of each window of a digest, with the window's total."""
    w = Window.partitionBy("window_start")
    rank = F.row_number().over(w.orderBy(F.desc("n"), "method"))
    return digests.withColumn("total", F.sum("n").over(w)).withColumn("rank", rank).filter(F.col("rank") <= k)


def alertable(status: Column, sealed: Column, only_sealed: bool = False) -> Column:
    """Whether a transaction's status can be trusted: a sealed one's can; of those that may still change all but an incomplete one's,
    or none (only_sealed).  A row without a status is never alerted on."""
    settled = F.lit(False) if only_sealed else status != "incomplete"
    return F.coalesce(status.isNotNull() & (F.coalesce(sealed.cast("boolean"), F.lit(False)) | settled), F.lit(False))


def match_rules(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that a rule names: rule, key, title.  A rule has a name, and methods, statuses or a pattern, or several of them; a rule with
    statuses matches only rows (with status and sealed) that are `alertable`."""
    hits = []
    for r in rules:
        ok = F.lit(True)
        if r.get("statuses"):
            ok = ok & F.col("status").isin(*r["statuses"]) & alertable(F.col("status"), F.col("sealed"), r.get("only_sealed", False))
        if r.get("methods"):
            ok = ok & F.col("method").isin(*r["methods"])
        if r.get("pattern"):
            ok = ok & F.col("text").rlike(r["pattern"])
        key = F.concat_ws(":", F.lit(r["name"]), F.col("row_id").cast("string"))
        hits.append(F.when(ok, F.struct(F.lit(r["name"]).alias("rule"), key.alias("key"), redact(F.col("text")).alias("title"))))
    return stream.select("at", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("at", "h.*")


def hourly_cap(batch: DataFrame, group: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(findings within their group's cap of the hour, one summary of the rest)."""
    return diff.burst_cap(batch, group, "at", "key", 3600, cap, "title")


def process_late(batch: DataFrame, stored: DataFrame, keys: list[str], digest_col: str, pad_s: int, gap_s: int) -> tuple[DataFrame, DataFrame]:
    """(dirty ranges that a batch opens, padded and joined; what changes: inserts and updates only)."""
    secs = batch.select((F.unix_timestamp("at") - pad_s).alias("lo"), (F.unix_timestamp("at") + pad_s).alias("hi"))
    ranges = diff.coalesce_even_ranges(secs.distinct(), gap_s, 2 * pad_s)
    touched = stored.join(batch.select(*keys).distinct(), keys, "left_semi")
    return ranges, diff.range_diff(touched, batch, keys, digest_col).filter("action IN ('insert', 'update')")


_WATCH = "watch string, at timestamp, level double, status string"


def watches(stream: DataFrame, raise_at: float, clear_at: float, settle: int = 1, settle_s: float = 0, lag: str = "1 hour") -> DataFrame:
    """Status changes of watches (watch, at, level): up at once, down after `settle` readings in a row below the lower level of which the
    first is settle_s seconds old; a reading that is not below it starts anew.

    A batch's readings of one watch come in several frames and are put in order together, so one watch's readings of
    a batch must fit a worker."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, low, since = state.get if state.exists else ("ok", 0, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples(index=False):
            now = r.at.value // 1000
            since = now if r.level >= clear_at or not low else since
            low = low + 1 if r.level < clear_at else 0
            new = "alert" if r.level >= raise_at else "ok" if low >= settle and now - since >= settle_s * 1e6 else status
            if new != status:
                out.append((key[0], r.at, r.level, new))
            status = new
        state.update((status, low, since))
        if out:
            yield pd.DataFrame(out, columns=["watch", "at", "level", "status"])

    return stream.withWatermark("at", lag).groupBy("watch").applyInPandasWithState(step, _WATCH, "status string, low int, since bigint", "append", GroupStateTimeout.NoTimeout)


def seal_stream(stream: DataFrame, quiet: str, lag: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a quiet stretch, sealed by the data's own watermark."""
    g = stream.withWatermark("at", lag).groupBy(F.session_window("at", quiet), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


#: Transactions are dealt out to so many keys of state.
SHARDS = 512


class Sealer(StatefulProcessor):
    """Line counts and ends of the transactions of one shard; one is sealed once the watermark is seal_s past its end if it has ended (a
    response or an error), else abandon_s.  A line that comes first puts the seal off; one that comes after it opens the transaction anew.

    Transactions are many and small, so a shard's are held, put together and sealed as tables.  What a batch brings is one table more in the
    state, read again only when the timer of the shard's next seal is due."""

    def __init__(self, seal_s: int, abandon_s: int) -> None:
        self.seal, self.abandon = seal_s * 1000, abandon_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")

    @staticmethod
    def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby("txn", sort=False, as_index=False).agg({"first": "min", "last": "max", "n": "sum", "ended": "max", "floor": "max"})

    def _due(self, f: pd.DataFrame) -> pd.Series:
        return (-(-f["last"] // 1000) + self.abandon - f["ended"] * (self.abandon - self.seal)).clip(lower=f["floor"])

    def _wake(self, due: int) -> None:
        """A timer at due, unless there is an earlier one."""
        at = self.timer.get()[0] if self.timer.exists() else None
        if at is None or due < at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, floor = [], timerValues.getCurrentWatermarkInMs() + 1
        for f in rows:
            at = f["at"].astype("datetime64[us]").astype("int64")
            parts.append(self._merged([pd.DataFrame({"txn": f["txn"], "first": at, "last": at, "n": 1, "ended": f["ends"].astype("int64"), "floor": floor})]))
        if parts:
            new = self._merged(parts)
            self.parts.appendValue((packed(pa.Table.from_pandas(new, preserve_index=False)),))
            # What the state holds may seal a transaction later than its new lines do, but never earlier than both.
            self._wake(int(self._due(new).min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [unpacked(b).to_pandas() for (b,) in self.parts.get()]
        self.timer.clear()
        self.parts.clear()
        if not parts:
            return
        f = self._merged(parts)
        due = self._due(f)
        ready = due <= timerValues.getCurrentWatermarkInMs()
        if not ready.all():
            self.parts.appendValue((packed(pa.Table.from_pandas(f[~ready], preserve_index=False)),))
            self._wake(int(due[~ready].min()))
        if ready.any():
            f = f[ready]
            yield pd.DataFrame({"txn": f["txn"], "started_at": pd.to_datetime(f["first"], unit="us"), "ended_at": pd.to_datetime(f["last"], unit="us"), "n": f["n"], "ended": f["ended"] > 0})

    def close(self) -> None:
        pass


def seal_transactions(stream: DataFrame, seal_s: int = 900, abandon_s: int = 3600, lag: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """Transactions (txn, at, ends) as they are sealed by the data's own watermark: terminal ones after seal_s, others after abandon_s."""
    shard = F.pmod(F.xxhash64("txn"), F.lit(shards)).cast("int").alias("shard")
    rows = stream.filter("txn IS NOT NULL AND at IS NOT NULL").select(shard, F.col("txn").cast("string").alias("txn"), "at", F.coalesce(F.col("ends"), F.lit(False)).alias("ends"))
    return rows.withWatermark("at", lag).groupBy("shard").transformWithStateInPandas(Sealer(seal_s, abandon_s), "txn string, started_at timestamp, ended_at timestamp, n bigint, ended boolean", "Append", "EventTime")
