"""Catalog versions, and a log of events that goes through to files, tasks and log rows."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediacat.functions.text import content_hash
from mediacat.sources import library
from mediacat.sources.versioned import Catalog, Conflict
from mediacat.streaming import watch

EVENTS = "event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp"
SETTINGS = "key string, value string, updated_at timestamp"


def settings(spark, values):
    return spark.createDataFrame([(k, v, None) for k, v in values.items()], SETTINGS)


def values(catalog, version=None):
    return {r.key: r.value for r in catalog.read("settings", version).collect()}


def size(base):
    return {os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


def test_versions(spark, tmp_path):
    base = str(tmp_path / "c")
    c = Catalog(spark, base, buckets=16)
    assert c.version() == -1 and c.read("settings").collect() == []
    first = {f"k{i}": "a" for i in range(200)}
    assert c.commit(upserts={"settings": settings(spark, first)}) == 0
    before = size(base)
    assert c.commit(upserts={"settings": settings(spark, {"k1": "b", "new": "n"})}, stream="s", batch=4) == 1
    written = {f.split("bucket=")[1].split("/")[0] for f in size(base) - before}
    assert len(written) <= 2  # only what the two keys touch
    assert values(c) == first | {"k1": "b", "new": "n"} and values(c, 0) == first
    assert c.commit(upserts={"settings": settings(spark, {"k1": "again"})}, stream="s", batch=4) == 1
    assert values(Catalog(spark, base)) == first | {"k1": "b", "new": "n"}
    # The new rows may be read from the table itself.
    c.commit(upserts={"settings": c.read("settings").withColumn("value", F.upper("value"))})
    assert set(values(c).values()) == {"A", "B", "N"}
    assert c.vacuum(keep=1) >= 2 and set(values(c).values()) == {"A", "B", "N"}
    assert len({f.split("/data/")[1].split("/")[0] for f in size(base)}) == 1


def test_a_commit_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "c"))
    c.commit(upserts={"settings": settings(spark, {"a": "1"})}, appends={"event_files": spark.createDataFrame([(1, 2, 3)], "event_id long, file_id long, sequence int")})

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", lost)
        with pytest.raises(RuntimeError):
            c.commit(upserts={"settings": settings(spark, {"a": "2"})}, stream="s", batch=0)
    assert values(c) == {"a": "1"} and c.version() == 0
    c.commit(upserts={"settings": settings(spark, {"a": "2"})}, stream="s", batch=0)
    assert values(c) == {"a": "2"} and c.read("event_files").count() == 1
    c.vacuum()
    assert values(c, 0) == {"a": "1"}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "c"))
    c.commit(upserts={"settings": settings(spark, {"a": "1"})})
    monkeypatch.setattr(c, "version", lambda: -1)  # it hasn't seen the other's version
    with pytest.raises(Conflict):
        c.commit(upserts={"settings": settings(spark, {"a": "2"})})
    assert values(Catalog(spark, str(tmp_path / "c"))) == {"a": "1"}


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def test_events_are_ingested(spark, tmp_path):
    lib, base, log = tmp_path / "lib", str(tmp_path / "catalog"), str(tmp_path / "log")
    lib.mkdir()
    path = lambda n: str(lib / n)
    for name, content in {"a.jpg": b"one", "copy of a.jpg": b"one", "b.nef": b"two", "c.jpg": b"three", "y.jpg": b"four"}.items():
        (lib / name).write_bytes(content)
    catalog = Catalog(spark, base)
    digest = lambda b: spark.range(1).select(content_hash(F.lit(b))).first()[0]
    old = spark.createDataFrame([(1, path("old.jpg"), digest(b"three"), 5), (2, path("b.nef"), "stale", 1)], "id long, file_path string, file_hash string, file_size long")
    rest = [c for c in catalog.read("files").dtypes if c[0] not in old.columns]
    catalog.commit(upserts={"files": old.selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in rest))})
    batches = [
        [("created", path("a.jpg"), None, 1), ("created", path("copy of a.jpg"), None, 2), ("created", path("missing.jpg"), None, 3), ("created", path("x.tmp"), None, 3)],
        [("created", path("c.jpg"), None, 4), ("modified", path("b.nef"), None, 5), ("moved", path("x.jpg"), path("y.jpg"), 6), ("deleted", path("old.jpg"), None, 7)],
    ]
    for rows in batches:
        spark.createDataFrame([(k, s, d, False, at(t)) for k, s, d, t in rows], EVENTS).coalesce(1).write.mode("append").parquet(log)
    for run in ("one", "two"):  # the second run gives all batches again
        stream = library.event_stream(spark, log, EVENTS, max_files=1)
        watch.on_batch(stream, watch.catalog_sink(base), str(tmp_path / run)).awaitTermination()
        files = {r.file_path.rsplit("/", 1)[1]: r for r in catalog.read("files").collect()}
        assert set(files) == {"a.jpg", "b.nef", "y.jpg", "old.jpg"}  # c.jpg is a copy of a stored file
        assert {n: (r.processed, r.error) for n, r in files.items()} == {"a.jpg": (False, None), "b.nef": (False, None), "y.jpg": (False, None), "old.jpg": (True, "File not found")}
        assert files["b.nef"].file_hash == digest(b"two") and files["b.nef"].id == 2 and files["a.jpg"].file_size == 3
        tasks = catalog.read("processing_queue").collect()
        assert sorted(t.file_id for t in tasks) == sorted(files[n].id for n in ("a.jpg", "b.nef", "y.jpg")) and len({t.id for t in tasks}) == 3
        logs = catalog.read("ingestion_logs").collect()
        assert sorted((r.ingested, r.duplicates, r.errors) for r in logs) == [(1, 1, 0), (1, 1, 1)]
        assert catalog.manifest()["batches"] == {"events": 1}


def test_only_touched_buckets_are_written(spark, tmp_path):
    base = str(tmp_path / "c")
    catalog = Catalog(spark, base, buckets=32)
    rows = spark.range(3000).select("id", F.concat(F.lit("/l/"), "id", F.lit(".jpg")).alias("file_path"), F.md5(F.col("id").cast("string")).alias("file_hash"))
    rest = [c for c in catalog.read("files").dtypes if c[0] not in rows.columns]
    catalog.commit(upserts={"files": rows.selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in rest))})
    whole = sum(map(os.path.getsize, size(base)))
    before = size(base)
    batch = spark.createDataFrame([("deleted", "/l/5.jpg", None, False, at(1))], EVENTS)
    watch.catalog_sink(base)(batch, 0)
    files = {f for f in size(base) - before if "/files-" in f}
    assert sum(map(os.path.getsize, files)) < whole / 8
    assert catalog.read("files").count() == 3000 and catalog.read("files").where("error = 'File not found'").first().file_path == "/l/5.jpg"
