"""Streams with state against the static operators on the same log, over restarts, and with late rows."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediacat.operators import video
from mediacat.sources import library
from mediacat.streaming import stateful, watch

EVENTS = "source string, event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    stateful.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write(spark, rows, schema, path):
    """One file of the log; files are taken in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def run(stream, fn, checkpoint, name=None):
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fn)
    (w.queryName(name) if name else w).start().awaitTermination()


def at(seconds):
    return START + timedelta(seconds=seconds)


def a_log(rng, n):
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice([0.0, 0.01, 0.1, 1.0, 4.999, 5.0, 5.001, 9.0])
        out.append((rng.choice(["a", "a", "a", "b", None]), rng.choice(["created", "modified", "modified", "deleted"]), f"/w/{rng.randrange(4)}.jpg", None, False, at(t)))
    return out, t


def test_batches_of_a_stream_equal_the_static_ones(spark, tmp_path):
    rng = random.Random(5)
    rows, end = a_log(rng, 300)
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    got = []

    def take(b, _):
        got.extend(tuple(r) for r in b.collect())

    sets = [rows[i : i + 60] for i in range(0, 300, 60)]
    for i, part in enumerate(sets):  # out of order within the delay
        if i + 1 < len(sets) and len(part) > 5:
            sets[i + 1], sets[i] = part[-3:] + sets[i + 1], part[:-3]
    stream = lambda: stateful.batch_events_stream(library.event_stream(spark, log, EVENTS, max_files=1), size=20, least_modified=2, delay="120 seconds")
    for part in sets[:3]:
        rng.shuffle(part)
        write(spark, part, EVENTS, log)
    run(stream(), take, cp)
    for part in sets[3:]:  # started again, from its checkpoint
        write(spark, part, EVENTS, log)
    write(spark, [("a", "deleted", "/last", None, False, at(end + 10_000))], EVENTS, log)
    run(stream(), take, cp)
    write(spark, [("z", "deleted", "/last", None, False, at(end + 20_000))], EVENTS, log)
    run(stream(), take, cp)
    df = spark.createDataFrame([(r[0] or "none", *r[1:]) for r in rows], EVENTS)
    want = watch.batch_events(df, size=20, least_modified=2).select("source", "start", "chunk", "src_path", "event_type", "n", "last_seen")
    plain = Counter((None if r[0] == "none" else r[0], *r[1:]) for r in map(tuple, want.collect()))
    assert Counter(r for r in got if r[3] != "/last") == plain


def test_debounce_of_a_stream_equals_the_static_one(spark, tmp_path):
    rng = random.Random(8)
    rows, end = a_log(rng, 200)
    log = str(tmp_path / "log")
    for i in range(0, 200, 50):
        write(spark, rows[i : i + 50], EVENTS, log)
    for more in (1000, 2000):
        write(spark, [("a", "deleted", "/last", None, False, at(end + more))], EVENTS, log)
    got = []
    run(stateful.debounce_stream(library.event_stream(spark, log, EVENTS, max_files=1)), lambda b, _: got.extend(b.drop("ts").collect()), str(tmp_path / "cp"))
    want = watch.debounce(spark.createDataFrame(rows, EVENTS)).select("key", "event_type", "src_path", "dest_path", "first_seen", "last_seen", "n")
    assert Counter(tuple(r) for r in got if r.src_path != "/last") == Counter(map(tuple, want.collect()))


def test_late_rows_are_counted(spark, tmp_path):
    late = stateful.LateRows()
    spark.streams.addListener(late)
    log = str(tmp_path / "log")
    event = lambda i, t: ("a", "created", f"/w/{i}.jpg", None, False, at(t))
    write(spark, [event(i, i) for i in range(10)], EVENTS, log)
    write(spark, [event(10, 1000)], EVENTS, log)
    write(spark, [event(11, 1001)], EVENTS, log)  # from here on the watermark is at 1000 - 60
    write(spark, [event(20 + i, 5 + i) for i in range(7)] + [event(12, 1002)], EVENTS, log)
    write(spark, [event(5, 6), event(5, 6), event(13, 3000)], EVENTS, log)
    source = lambda: library.event_stream(spark, log, EVENTS, max_files=1)
    seen, quiet = [], []
    try:
        run(stateful.batch_events_stream(source(), delay="60 seconds"), lambda b, _: seen.extend(b.collect()), str(tmp_path / "cp1"), "batches")
        run(stateful.debounce_stream(source(), delay="60 seconds"), lambda b, _: quiet.extend(b.collect()), str(tmp_path / "cp2"), "debounced")
        for _ in range(50):
            if late.counts("debounced")["received"] == 23 and late.counts("batches")["received"] == 23:
                break
            time.sleep(0.1)
        assert late.counts("batches") == {"received": 23, "dropped": 9}
        assert late.counts("debounced") == {"received": 23, "dropped": 9}
        assert sum(r.n for r in seen) == sum(r.n for r in quiet) == 23 - 9 - 1  # the last event is still waited for
    finally:
        spark.streams.removeListener(late)
    late.add("again", 4, 10, 3)
    late.add("again", 4, 10, 3)
    assert late.counts("again") == {"received": 10, "dropped": 3}


READINGS = "path string, ts timestamp, size long"


def test_only_stable_files_reach_the_end_of_the_chain(spark, tmp_path):
    rows = {"e": [], "r": []}
    event = lambda kind, p, t, dest=None: rows["e"].append(("a", kind, p, dest, False, at(t)))
    event("created", "/grows", 0)
    event("created", "/still", 0)
    event("created", "/never", 0)
    event("created", "/unread", 0)
    event("moved", "/from", 1, "/to")
    event("deleted", "/gone", 2)
    event("created", "/still", 1)  # debounced with the first
    for k in range(60):
        t = 3.5 + 0.5 * k
        rows["r"] += [("/grows", at(t), min(k, 10)), ("/still", at(t), 7), ("/never", at(t), k), ("/to", at(t), 5), ("/nobody", at(t), 1)]
    logs = {k: str(tmp_path / k) for k in rows}
    write(spark, rows["e"], EVENTS, logs["e"])
    write(spark, rows["r"][:100], READINGS, logs["r"])
    got = []
    chain = lambda: stateful.settled_files(library.event_stream(spark, logs["e"], EVENTS), library.event_stream(spark, logs["r"], READINGS), delay="10 seconds")
    take = lambda b, _: got.extend(tuple(r) for r in b.collect())
    run(chain(), take, str(tmp_path / "cp"))
    write(spark, rows["r"][100:], READINGS, logs["r"])
    run(chain(), take, str(tmp_path / "cp"))
    for t in (5000, 6000, 7000):
        write(spark, [("a", "deleted", "/end", None, False, at(t))], EVENTS, logs["e"])
        write(spark, [("/end", at(t), 1)], READINGS, logs["r"])
        run(chain(), take, str(tmp_path / "cp"))
    got = sorted(r for r in got if r[0] != "/end")
    by = {r[0]: r for r in got}
    assert len(by) == len(got)
    assert {p: r[1] for p, r in by.items()} == {"/grows": "stable", "/still": "stable", "/never": "unstable", "/unread": "unstable", "/to": "stable", "/gone": "passed"}
    static = {r.path: r.stable_at for r in video.stable_files(spark.createDataFrame([r for r in rows["r"] if r[0] in ("/grows", "/still", "/to")], READINGS)).collect()}
    assert {p: by[p][2] for p in static} == static
    assert (by["/grows"][3], by["/to"][4]) == (10, "moved")
