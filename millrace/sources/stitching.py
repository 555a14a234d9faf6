"""Interleaved log lines to transactions: a machine over lines in order, dealt out by users, and the same as a stream.

Rules, within one server:

- a line with a request id belongs to that id; it takes its user's stream on its thread, too;
- a line with a user belongs to that user's stream on its thread, and makes the thread that user's;
- a line without either belongs to the stream that its thread belongs to, if that is open, else to the thread's own;
- a request starts a new transaction where the stream has one already;
- a response with a user closes that user's transaction that was heard from last (of equally late ones the oldest), any
  other response the one it belongs to; work within LATE_US of the close still joins;
- a transaction that was not heard from for GAP_US is given up; a line without a time comes last and joins what is open.

So users touch each other only by request ids and by the order in which they hold a thread.  `stitch` finds for each
line the user or id that its thread belongs to (`sweep.fill_forward`), puts the lines of one user (or of users who share
ids) into units, cuts these at silences, and sweeps each stretch of a unit by itself.  Lines that no open stream of their
unit takes are swept in a second pass by threads.  A busy server is as many units as it has users, and one hot user's
stretch is swept in batches: only its open streams are held.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.sweep import fill_forward, micros, stretches, with_slice
from millrace.sources.shared import shared_dir
from millrace.sources.tables import packed, unpacked

GAP_US, LATE_US = 300_000_000, 250_000
COLUMNS = ["server", "row_id", "at", "thread", "user_ctx", "entry_type", "request_id"]
LINES = "server string, row_id bigint, txn string, seq int"


class Txn:
    """An open or lately closed transaction."""

    __slots__ = ("id", "nr", "last", "n", "request", "open", "end", "keys", "rid")

    def __init__(self, id_: str, nr: int, rid: str | None) -> None:
        self.id, self.nr, self.rid = id_, nr, rid
        self.last: int | None = None
        self.n, self.request, self.open, self.end = 0, False, True, None
        self.keys: set[tuple] = set()


class Streams:
    """The open streams of a server, or of one unit of it.  Every line is taken in a time that does not grow with the streams: they are
    found by key, by request id, and by user in the order in which they were heard from."""

    def __init__(self, whole: bool = True) -> None:
        self.whole = whole
        self.open: dict[tuple, Txn] = {}
        self.stamped: dict[str, Txn] = {}
        self.current: dict[str, tuple] = {}
        self.closed: OrderedDict[tuple, Txn] = OrderedDict()
        self.heard: OrderedDict[int, Txn] = OrderedDict()
        self.of_user: dict[str, OrderedDict[int, Txn]] = {}
        self.next = 0
        self.given_up: list[Txn] = []

    def _leave(self, x: Txn, key: tuple) -> None:
        x.keys.discard(key)
        mine = self.of_user.get(key[1])
        if mine is not None and not any(k[1] == key[1] for k in x.keys):
            mine.pop(x.nr, None)
            if not mine:
                del self.of_user[key[1]]

    def _hold(self, x: Txn, key: tuple) -> None:
        old = self.open.get(key)
        if old is not None and old is not x:
            self._leave(old, key)
            if not old.keys and old.rid is None:
                self.heard.pop(old.nr, None)
                self.given_up.append(old)
        self.open[key] = x
        x.keys.add(key)

    def _close(self, x: Txn) -> None:
        for key in list(x.keys):
            del self.open[key]
            self._leave(x, key)
            if x.end is not None:
                self.closed[key] = x
                self.closed.move_to_end(key)
        if x.rid is not None and self.stamped.get(x.rid) is x:
            del self.stamped[x.rid]
        self.heard.pop(x.nr, None)

    def evict(self, t: int) -> None:
        """Give up what was last heard from more than GAP_US before t."""
        while self.heard and (x := next(iter(self.heard.values()))).last < t - GAP_US:
            self._close(x)
            self.given_up.append(x)
        while self.closed and next(iter(self.closed.values())).end < t - LATE_US:
            self.closed.popitem(last=False)

    def take(self, server: str, row_id: int, t: int | None, thread: str | None, user: str | None, kind: str, rid: str | None) -> Txn | None:
        """The transaction that the line joins or opens; None if none of this unit takes a line without a user or id."""
        if t is not None:
            self.evict(t)
        key: tuple = (thread, user) if user is not None or rid is None else (thread, "", rid)
        if rid is not None:
            x = self.stamped.get(rid)
        elif user is None:
            key = self.current.get(thread, key)
            x = self.open.get(key)
            if x is None and key != (thread, None):
                if not self.whole:
                    self.current.pop(thread, None)
                    return None
                key = (thread, None)
                x = self.open.get(key)
            elif x is None and not self.whole:
                return None
        elif kind == "response":
            x = None
            for y in reversed(self.of_user.get(user, {}).values()):
                if x is not None and y.last != x.last:
                    break
                x = y if x is None or y.nr < x.nr else x
        else:
            x = self.open.get(key)
        if x is not None and kind == "request" and x.request and rid is None:
            x = None
        if x is None and kind not in ("request", "response") and t is not None and (late := self.closed.get(key)) is not None and t - late.end <= LATE_US:
            x = late
        if x is None:
            x = Txn(f"{server}:{row_id}", self.next, rid)
            self.next += 1
            if rid is not None:
                self.stamped[rid] = x
        self.current[thread] = key
        x.n += 1
        x.request |= kind == "request"
        if t is not None or x.last is None:
            x.last = t if t is not None else 1 << 62
        if x.open:
            if not (kind == "response" and x.keys):
                self._hold(x, key)
            self.heard[x.nr] = x
            self.heard.move_to_end(x.nr)
            for k in x.keys:
                if k[1]:
                    mine = self.of_user.setdefault(k[1], OrderedDict())
                    mine[x.nr] = x
                    mine.move_to_end(x.nr)
            if kind == "response":
                x.open, x.end = False, t if t is not None else 1 << 62
                self._close(x)
        return x


def _swept(rows: DataFrame, unit: list[str], whole: bool) -> DataFrame:
    """(server, row_id, txn, seq) of the lines of each unit, in order; txn is null where no stream of the unit takes the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, now = Streams(whole), None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            txn, seq = [], []
            for server, row_id, t, thread, user, kind, rid, *key in zip(*cols):
                if key != now:
                    streams, now = Streams(whole), key
                x = streams.take(server, row_id, t, thread, user, kind, rid)
                streams.given_up.clear()
                txn.append(None if x is None else x.id)
                seq.append(None if x is None else x.n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(txn, pa.string()), pa.array(seq, pa.int32())], names=["server", "row_id", "txn", "seq"])

    dealt = rows.repartition(*unit).sortWithinPartitions(*unit, F.col("t").asc_nulls_last(), "row_id")
    own = [c for c in unit if c != "server"]
    return dealt.select("server", "row_id", "t", "thread", "user_ctx", "entry_type", "request_id", "server", *own).toDF(*["server", "row_id", "t", "thread", "user_ctx", "entry_type", "request_id", "_server", *own]).mapInArrow(run, LINES)


def _labels(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(server, request_id, label) of ids, and (server, user_ctx, label) of users who share ids with others, if any do."""
    ids = lines.filter("request_id IS NOT NULL").groupBy("server", "request_id").agg(F.min("user_ctx").alias("label"), F.max("user_ctx").alias("other"))
    named = F.coalesce(F.concat(F.lit("u:"), "label"), F.concat(F.lit("r:"), "request_id"))
    if ids.filter("label <> other").isEmpty():
        return ids.select("server", "request_id", named.alias("label")), None
    shared = ids.filter("label <> other").select("server", "request_id").join(lines, ["server", "request_id"]).filter("user_ctx IS NOT NULL")
    edges = _written(shared.select("server", "request_id", "user_ctx").distinct(), "shared-ids")
    known = edges.select("server", "user_ctx", F.col("user_ctx").alias("label")).distinct()
    while True:  # as many rounds as users are linked in a chain
        least = edges.join(known, ["server", "user_ctx"]).groupBy("server", "request_id").agg(F.min("label").alias("label"))
        after = _written(edges.join(least, ["server", "request_id"]).groupBy("server", "user_ctx").agg(F.min("label").alias("label")), "labels")
        if after.join(known, ["server", "user_ctx", "label"], "left_anti").isEmpty():
            break
        known = after
    merged = ids.withColumn("user_ctx", F.col("label")).drop("label").join(known, ["server", "user_ctx"], "left")
    label = F.coalesce(F.concat(F.lit("u:"), F.coalesce("label", "user_ctx")), F.concat(F.lit("r:"), "request_id"))
    return merged.select("server", "request_id", label.alias("label")), known


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stitch(entries: DataFrame, slice_s: int = 3600) -> DataFrame:
    """server, row_id, txn, seq from entries (server, row_id, at, thread, user_ctx, entry_type, request_id); (server, row_id) names a
    line.  Null servers and threads are one server and one thread."""
    lines = entries.select(F.coalesce("server", F.lit("")).alias("server"), "row_id", micros(F.col("at")).alias("t"), F.coalesce("thread", F.lit("")).alias("thread"), "user_ctx", "entry_type", "request_id")
    ids, users = _labels(lines)
    of_user: Column = F.concat(F.lit("u:"), "user_ctx")
    rows = lines.join(ids, ["server", "request_id"], "left")
    if users is not None:
        rows = rows.join(users.select("server", "user_ctx", F.col("label").alias("_with")), ["server", "user_ctx"], "left")
        of_user = F.concat(F.lit("u:"), F.coalesce("_with", "user_ctx"))
    # Sweeps read their input more than once, so each is a written table.
    cols = ["server", "row_id", "t", "thread", "user_ctx", "entry_type", "request_id"]
    rows = _written(with_slice(rows.select(*cols, F.coalesce("label", of_user).alias("_own")), "t", slice_s), "lines")
    held = _written(fill_forward(rows, ["server", "thread"], ["t", "row_id"], F.col("_own"), "unit").drop("_own"), "owned")
    some = stretches(held.filter("unit IS NOT NULL"), ["server", "unit"], "t", "row_id", GAP_US, "since")
    first = _written(_swept(some.select(*cols, "unit", "since"), ["server", "unit", "since"], False), "stitched")
    left = held.join(first.filter("txn IS NULL").select("server", "row_id"), ["server", "row_id"], "left_semi").select(*cols, "_slice")
    alone = _written(left.unionByName(held.filter("unit IS NULL").select(*cols, "_slice")), "alone")
    alone = stretches(alone, ["server", "thread"], "t", "row_id", GAP_US, "since")
    second = _swept(alone.select(*cols, F.col("thread").alias("unit"), "since"), ["server", "unit", "since"], True)
    return first.filter("txn IS NOT NULL").unionByName(second)


def stitch_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lines of one server, in order, in one pass."""
    pdf = pdf.sort_values(["at", "row_id"], na_position="last")
    streams, out = Streams(), []
    text = lambda v: v if isinstance(v, str) else None
    for r in pdf.itertuples(index=False):
        t = None if pd.isna(r.at) else r.at.value // 1000
        x = streams.take(r.server, r.row_id, t, r.thread, text(r.user_ctx), r.entry_type, text(r.request_id))
        streams.given_up.clear()
        out.append((r.server, r.row_id, x.id, x.n))
    return pd.DataFrame(out, columns=["server", "row_id", "txn", "seq"])


#: What the stream tells: a line's transaction, or (row_id null) the end of one, by a response or by silence.
STREAMED = "server string, row_id bigint, txn string, seq int, ended string"
_WAITING = pa.schema([("row_id", pa.int64()), ("t", pa.int64()), *((c, pa.string()) for c in ("thread", "user_ctx", "entry_type", "request_id"))])
#: Lines wait in tables of a slice of time each, which are cut from so many lines at once.
SLICE_US, CUT = 3_600_000_000, 500_000
_OPEN = "nr bigint, last bigint, n int, request boolean, rid string, keys array<array<string>>"


class Stitcher(StatefulProcessor):
    """Lines of a server wait until the watermark has passed them, so the order of files does not count; then they are swept in order,
    one slice of time after the other.  Waiting lines are held as tables: a list of single lines is read anew with each that is
    added.  The state has the waiting lines, one entry for each open stream, and the threads' owners; a timer gives up a stream that is not
    heard from for GAP_US, whether or not another line comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint, nr bigint", "rows binary")
        self.cuts = handle.getValueState("cuts", "nr bigint")
        self.streams = handle.getMapState("streams", "txn string", _OPEN)
        self.late = handle.getMapState("late", "txn string", "end bigint, n int, keys array<array<string>>")
        self.owners = handle.getMapState("owners", "thread string", "key array<string>")

    def _load(self) -> Streams:
        s = Streams()
        key = lambda k: tuple(v if v != "\0" else None for v in k)
        for (txn,), (nr, last, n, request, rid, keys) in sorted(self.streams.iterator(), key=lambda e: (e[1][1], e[1][0])):
            x = Txn(txn, nr, rid)
            x.last, x.n, x.request = last, n, request
            s.heard[nr] = x
            if rid is not None:
                s.stamped[rid] = x
            for k in map(key, keys):
                s.open[k] = x
                x.keys.add(k)
                if k[1]:
                    s.of_user.setdefault(k[1], OrderedDict())[nr] = x
            s.next = max(s.next, nr + 1)
        for (txn,), (end, n, keys) in sorted(self.late.iterator(), key=lambda e: e[1][0]):
            x = Txn(txn, -1, None)
            x.open, x.end, x.n, x.last = False, end, n, end
            for k in map(key, keys):
                s.closed[k] = x
        for (thread,), (k,) in self.owners.iterator():
            s.current[thread] = key(k)
        return s

    def _store(self, s: Streams) -> None:
        plain = lambda k: [v if v is not None else "\0" for v in k]
        now = {x.id: (x.nr, x.last, x.n, x.request, x.rid, sorted(map(plain, x.keys))) for x in s.heard.values()}
        for (txn,), _ in list(self.streams.iterator()):
            if txn not in now:
                self.streams.removeKey((txn,))
        for txn, row in now.items():
            self.streams.updateValue((txn,), row)
        late: dict[str, tuple[Txn, list]] = {}
        for k, x in s.closed.items():
            late.setdefault(x.id, (x, []))[1].append(plain(k))
        self.late.clear()
        for txn, (x, keys) in late.items():
            self.late.updateValue((txn,), (x.end, x.n, keys))
        held = {k[0] for k in s.open}
        self.owners.clear()
        for thread, k in s.current.items():
            if thread in held:
                self.owners.updateValue((thread,), (plain(k),))

    def _wait(self, tables: list[pa.Table]) -> None:
        """The lines into the tables of their slices."""
        if not tables:
            return
        rows = pa.concat_tables(tables)
        slice_ = rows.column("t").to_numpy() // SLICE_US
        order = np.argsort(slice_, kind="stable")
        rows, slice_ = rows.take(pa.array(order)), slice_[order]
        nr = self.cuts.get()[0] if self.cuts.exists() else 0
        starts = np.flatnonzero(np.r_[True, slice_[1:] != slice_[:-1]]).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(slice_)]):
            self.waiting.updateValue((int(slice_[lo]), nr), (packed(rows.slice(lo, hi - lo).combine_chunks()),))
        self.cuts.update((nr + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        for f in rows:
            t = f["at"].astype("datetime64[us]").astype("int64")
            held.append(pa.Table.from_pandas(f.assign(t=t)[_WAITING.names], _WAITING, preserve_index=False))
            n += len(f)
            first = min([int(t.min()), *([] if first is None else [first])])
            if n >= CUT:
                self._wait(held)
                held, n = [], 0
        self._wait(held)
        if first is not None:
            # Not before the watermark has moved on: lines of this time may still come.
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    @staticmethod
    def _told(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["server", "row_id", "txn", "seq", "ended"]).astype({"row_id": "Int64", "seq": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        s, out, later = self._load(), [], []
        slices: dict[int, list[int]] = {}
        for slice_, nr in self.waiting.keys():
            slices.setdefault(slice_, []).append(nr)
        for slice_ in sorted(slices):
            if slice_ * SLICE_US >= now:
                later.append(slice_ * SLICE_US // 1000)
                continue
            entries = [(slice_, nr) for nr in sorted(slices[slice_])]
            rows = pa.concat_tables([unpacked(self.waiting.getValue(e)[0]) for e in entries])
            for e in entries:
                self.waiting.removeKey(e)
            if (slice_ + 1) * SLICE_US > now:
                wait = rows.filter(pc.greater_equal(rows.column("t"), now))
                rows = rows.filter(pc.less(rows.column("t"), now))
                if len(wait):
                    self._wait([wait])
                    later.append(pc.min(wait.column("t")).as_py() // 1000)
            rows = rows.sort_by([("t", "ascending"), ("row_id", "ascending")])
            for row_id, t, thread, user, kind, rid in zip(*(c.to_pylist() for c in rows.columns)):
                x = s.take(key[0], row_id, t, thread or "", user, kind, rid)
                out.append((key[0], row_id, x.id, x.n, None))
                if kind == "response":
                    out.append((key[0], None, x.id, x.n, "response"))
                if s.given_up:
                    out += [(key[0], None, y.id, y.n, "silence") for y in s.given_up]
                    s.given_up.clear()
            if len(out) >= 10_000:
                yield self._told(out)
                out = []
        s.evict(now)
        out += [(key[0], None, y.id, y.n, "silence") for y in s.given_up]
        s.given_up.clear()
        self._store(s)
        next_ = [t + 1 for t in later] + [x.last // 1000 + GAP_US // 1000 + 1 for x in s.heard.values()]
        if next_:
            self.handle.registerTimer(max(min(next_), now // 1000 + 1))
        if out:
            yield self._told(out)

    def close(self) -> None:
        pass


def stitch_stream(entries: DataFrame, lag: str = "10 minutes") -> DataFrame:
    """The same as a stream (STREAMED): lines are told once the watermark, lag behind the newest line, has passed them."""
    rows = entries.select(F.coalesce("server", F.lit("")).alias("server"), "row_id", "at", "thread", "user_ctx", "entry_type", "request_id")
    return rows.withWatermark("at", lag).groupBy("server").transformWithStateInPandas(Stitcher(), STREAMED, "Append", "EventTime")
