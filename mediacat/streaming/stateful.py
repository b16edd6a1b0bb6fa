"""Streams that keep state by key: batches of events, files that have stopped growing, and counts of what came too late.

Each works in event time: rows wait until the watermark has passed them and are then taken in order, so that a stream gives what the static operator
gives on the same log, however it is cut into micro-batches. State stores must be RocksDB (state_store()).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from mediacat.functions.text import event_key
from mediacat.streaming.watch import DROP_AFTER, WAIT, session_wait

BATCHES = "key string, start timestamp, chunk long, src_path string, event_type string, n long, last_seen timestamp"
QUIET = "key string, event_type string, src_path string, dest_path string, first_seen timestamp, last_seen timestamp, n long, ts timestamp"
STABLE = "path string, state string, at timestamp, size long, event_type string"


def state_store(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, as processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(t: datetime) -> int:
    """The first millisecond at or after t, which Spark gives without a zone, as UTC."""
    whole, rest = divmod((t - datetime(1970, 1, 1)) // timedelta(microseconds=1), 1000)
    return whole + bool(rest)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None) if ms > 0 else datetime(1970, 1, 1)


def _naive(t) -> datetime:
    return pd.Timestamp(t).to_pydatetime().replace(tzinfo=None)


class _InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark is past them, and then gives them to take() in time order.

    columns: the rows' columns behind ts, with their types. State beyond the waiting rows is what open() opens.
    """

    columns: dict[str, str]
    out: str

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["ts timestamp", *(f"{c} {t}" for c, t in self.columns.items())]))
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def take(self, key, ready: list[tuple], mark: int) -> tuple[list[tuple], datetime | None]:
        """(result rows, when the state must be looked at again)"""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            values = [frame[c] for c in self.columns]
            for i, t in enumerate(frame["ts"]):
                at = _naive(t)
                self.waiting.appendValue((at, *(None if pd.isna(v.iloc[i]) else v.iloc[i] for v in values)))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(max(_millis(first), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((_naive(w[0]), *w[1:]) for w in self.waiting.get()), key=lambda w: (w[0], *((x is not None, x if x is not None else 0) for x in w[1:])))
        ready = [r for r in rows if _millis(r[0]) <= mark]
        out, again = self.take(key, ready, mark)
        rest = rows[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        due = ([_millis(rest[0][0])] if rest else []) + ([_millis(again)] if again is not None else [])
        if due:
            self.handle.registerTimer(min(due))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.out.split(", ")])

    def close(self) -> None:
        pass


class _Batches(_InOrder):
    """A batch ends when the key has been idle, or is full."""

    columns = {"src_path": "string", "event_type": "string"}
    out = BATCHES

    def __init__(self, idle: timedelta, size: int, least_modified: int):
        self.idle, self.size, self.least_modified = idle, size, least_modified

    def open(self, handle) -> None:
        self.groups = handle.getListState("groups", "src_path string, event_type string, n long, last_seen timestamp")  # of the chunk being filled
        self.session = handle.getValueState("session", "start timestamp, last timestamp, chunk long, filled long")

    def take(self, key, ready: list[tuple], mark: int) -> tuple[list[tuple], datetime | None]:
        start, last, chunk, filled = self.session.get() if self.session.exists() else (None, None, 0, 0)
        start, last = (None if t is None else _naive(t) for t in (start, last))
        groups = {(g[0], g[1]): (g[2], _naive(g[3])) for g in self.groups.get()}
        out: list[tuple] = []

        def close() -> None:
            out.extend((key[0], start, chunk, path, kind, n, seen) for (path, kind), (n, seen) in groups.items() if kind != "modified" or n >= self.least_modified)
            groups.clear()

        for at, path, kind in ready:
            if start is None or at - last > self.idle:
                close()
                start, chunk, filled = at, 0, 0
            elif filled == self.size:
                close()
                chunk, filled = chunk + 1, 0
            n, seen = groups.get((path, kind), (0, at))
            groups[path, kind] = (n + 1, max(seen, at))
            filled, last = filled + 1, at
        if start is not None and _millis(last + self.idle) <= mark:  # what could still join the batch is late
            close()
            start = None
        kept = [(path, kind, n, seen) for (path, kind), (n, seen) in groups.items()]
        self.groups.put(kept) if kept else self.groups.clear()
        self.session.update((start, last, chunk, filled)) if start is not None else self.session.clear()
        return out, None if start is None else last + self.idle


class _Quiet(_InOrder):
    """A run of a key's events ends when nothing came for the wait of its type."""

    columns = {}
    out = QUIET

    def __init__(self, waits: dict[str, timedelta], otherwise: timedelta):
        self.waits, self.otherwise = waits, otherwise

    def open(self, handle) -> None:
        self.run = handle.getValueState("run", "first timestamp, last timestamp, n long")

    def take(self, key, ready: list[tuple], mark: int) -> tuple[list[tuple], datetime | None]:
        wait = self.waits.get(key[1], self.otherwise)
        first, last, n = self.run.get() if self.run.exists() else (None, None, 0)
        first, last = (None if t is None else _naive(t) for t in (first, last))
        out: list[tuple] = []
        for (at,) in ready:
            if first is not None and at - last > wait:
                out.append((*key, first, last, n, last + wait))
                first = None
            first, n = (at, 1) if first is None else (first, n + 1)
            last = at
        if first is not None and _millis(last + wait) <= mark:
            out.append((*key, first, last, n, last + wait))
            first = None
        self.run.update((first, last, n)) if first is not None else self.run.clear()
        return out, None if first is None else last + wait


class _Stable(_InOrder):
    """An event arms its path; the readings after it are watched until enough of them in a row have one size, or for too long."""

    columns = {"size": "long", "event_type": "string"}
    out = STABLE

    def __init__(self, required: int, wait: timedelta):
        self.required, self.wait = required, wait

    def open(self, handle) -> None:
        self.armed = handle.getValueState("armed", "since timestamp, size long, same int, event_type string")

    def take(self, key, ready: list[tuple], mark: int) -> tuple[list[tuple], datetime | None]:
        since, size, same, kind = self.armed.get() if self.armed.exists() else (None, None, 0, None)
        since = None if since is None else _naive(since)
        out: list[tuple] = []
        for at, now, event in ready:
            if since is not None and at - since > self.wait:
                out.append((key[0], "unstable", since + self.wait, size, kind))
                since = None
            if event is not None:
                if since is None:
                    since, size, same = at, None, 0
                kind = event
            elif since is not None:
                same, size = (same + 1, size) if now == size else (0, now)
                if same >= self.required:
                    out.append((key[0], "stable", at, size, kind))
                    since = None
        if since is not None and _millis(since + self.wait) <= mark:
            out.append((key[0], "unstable", since + self.wait, size, kind))
            since = None
        self.armed.update((since, size, same, kind)) if since is not None else self.armed.clear()
        return out, None if since is None else since + self.wait


def batch_events_stream(stream: DataFrame, key: str = "source", idle: str = "5 seconds", size: int = 100, least_modified: int = 3, delay: str = DROP_AFTER) -> DataFrame:
    """watch.batch_events() on a stream: the same rows, each once its batch is over. Rows later than the delay, or without a time, are dropped.

    A batch is over when the watermark is past its last event by the idle time, so the last ones of a log wait for later events.
    """
    rows = stream.where("ts is not null").select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "src_path", "event_type").withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Batches(pd.Timedelta(idle).to_pytimedelta(), size, least_modified), BATCHES, "append", "EventTime")


def debounce_stream(stream: DataFrame, base_ms: int = 2000, delay: str = DROP_AFTER) -> DataFrame:
    """watch.debounce() on a stream, with ts, the end of the quiet time. Every late row counts as dropped (LateRows), where a session window counts what it has merged."""
    rows = stream.where("ts is not null").withColumn("key", event_key(F.col("event_type"), F.col("src_path"), F.col("dest_path")))
    rows = rows.select("key", "event_type", "src_path", "dest_path", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    ms = lambda n: timedelta(milliseconds=n)
    quiet = _Quiet({k: ms(int(base_ms * w)) for k, w in WAIT.items()}, ms(base_ms))
    return rows.groupBy("key", "event_type", "src_path", "dest_path").transformWithStateInPandas(quiet, QUIET, "append", "EventTime")


def _quiet_times(stream: DataFrame, base_ms: int, delay: str) -> DataFrame:
    """watch.debounce() with ts, the end of each session: a time that the watermark knows, so that operators with state can follow."""
    rows = stream.withColumn("key", event_key(F.col("event_type"), F.col("src_path"), F.col("dest_path"))).withWatermark("ts", delay)
    keys = ("key", "event_type", "src_path", "dest_path")
    return rows.groupBy(*keys, F.session_window("ts", session_wait(base_ms))).agg(F.count("*").alias("n")).select(*keys, F.window_time("session_window").alias("ts"))


def settled_files(events: DataFrame, readings: DataFrame, base_ms: int = 2000, required: int = 3, max_wait: str = "30 seconds", delay: str = DROP_AFTER) -> DataFrame:
    """(path, state, at, size, event_type): the live chain from events to files that may be read.

    events and readings (path, ts, size) are streams. An event is debounced; a created or moved file is then watched: stable once `required` readings after the
    quiet time are each equal to the one before, unstable if that has not happened within max_wait. Other events are passed on as they are.
    State goes with the result, or at the end of the wait: readings of paths that no event asks for are not kept.
    """
    quiet = _quiet_times(events, base_ms, delay)
    path = F.when(F.col("event_type") == "moved", F.coalesce("dest_path", "src_path")).otherwise(F.col("src_path"))
    asks = quiet.select(path.alias("path"), "ts", F.lit(None).cast("long").alias("size"), "event_type")
    waits = F.col("event_type").isin("created", "moved")
    sizes = readings.select("path", F.col("ts").cast("timestamp").alias("ts"), "size", F.lit(None).cast("string").alias("event_type")).withWatermark("ts", delay)
    watched = asks.where(waits).unionByName(sizes).groupBy("path").transformWithStateInPandas(_Stable(required, pd.Timedelta(max_wait).to_pytimedelta()), STABLE, "append", "EventTime")
    others = asks.where(~waits).select("path", F.lit("passed").alias("state"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("size"), "event_type")
    return watched.unionByName(others)


class LateRows(StreamingQueryListener):
    """Counts, by query name or id, the rows that came in and those that the watermark dropped. spark.streams.addListener(LateRows()).

    A micro-batch that is run again after a failure counts once: counts are kept by batch.
    """

    def __init__(self):
        self._seen: dict[str, dict[int, tuple[int, int]]] = {}
        self._total: dict[str, list[int]] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.add(p.name or str(p.id), p.batchId, p.numInputRows, sum(o.numRowsDroppedByWatermark for o in p.stateOperators))

    def add(self, query: str, batch: int, received: int, dropped: int) -> None:
        with self._lock:
            seen, total = self._seen.setdefault(query, {}), self._total.setdefault(query, [0, 0])
            before = seen.get(batch, (0, 0))
            now = (max(before[0], received), max(before[1], dropped))
            total[0] += now[0] - before[0]
            total[1] += now[1] - before[1]
            seen[batch] = now
            while len(seen) > 100:  # batches come in order
                del seen[min(seen)]

    def counts(self, query: str) -> dict[str, int]:
        with self._lock:
            received, dropped = self._total.get(query, [0, 0])
        return {"received": received, "dropped": dropped}
