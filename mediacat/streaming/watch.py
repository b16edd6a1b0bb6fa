"""File events as streams: filter, debounce, batches, routing. Each also runs on a static table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.functions.paths import glob_type, should_reprocess
from mediacat.functions.text import event_key
from mediacat.operators import queue
from mediacat.operators.ignore import is_ignored
from mediacat.plans import jobs
from mediacat.sources.library import describe_files
from mediacat.sources.versioned import Catalog
from mediacat.storage import stored

# Priorities, and how much longer or shorter an event type is waited for.
PRIORITY = {"created": 10, "moved": 8, "modified": 5, "deleted": 3}
WAIT = {"modified": 0.5, "deleted": 2.0}
DROP_AFTER = "300 seconds"


def filter_events(df: DataFrame) -> DataFrame:
    """Files of supported types that no rule ignores; a move also looks at its destination."""
    ok = lambda p: glob_type(p).isNotNull() & ~is_ignored(p, F.lit(False))
    dest = (F.col("event_type") != "moved") | F.col("dest_path").isNull() | ok(F.col("dest_path"))
    return df.where(~F.col("is_directory") & ok(F.col("src_path")) & dest)


def event_priority(event_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[event_type], F.lit(5))


def session_wait(base_ms: int) -> Column:
    """How long an event's type is waited for, as the gap of a session window."""
    wait = F.lit(f"{base_ms} milliseconds")
    for k, w in WAIT.items():
        wait = F.when(F.col("event_type") == k, F.lit(f"{int(base_ms * w)} milliseconds")).otherwise(wait)
    return wait


def debounce(df: DataFrame, base_ms: int = 2000, delay: str = DROP_AFTER) -> DataFrame:
    """One row for each key once it has been quiet for its type's time: first_seen, last_seen, n. On a stream, later rows than the delay are dropped."""
    rows = df.withColumn("key", event_key(F.col("event_type"), F.col("src_path"), F.col("dest_path")))
    rows = rows.withWatermark("ts", delay) if df.isStreaming else rows
    return rows.groupBy("key", "event_type", "src_path", "dest_path", F.session_window("ts", session_wait(base_ms))).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).drop("session_window")


def batch_events(df: DataFrame, key: str = "source", idle: str = "5 seconds", size: int = 100, least_modified: int = 3, bucket_seconds: int = 600) -> DataFrame:
    """Static rows in batches: a key's events until it is idle, cut every `size`; the newest event of each path and type stays, modified ones only if there were enough.

    (key, start, chunk, src_path, event_type, n, last_seen). A key's time is cut into buckets, each numbered on its own; one row a bucket
    carries on the last time, the start of the session that is still open, and how many events that has had.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.where(F.col("ts").isNotNull()).withColumn("__t", micros("ts")).withColumn("__b", F.floor(F.col("__t") / (bucket_seconds * 1_000_000)))
    by_key, limit = Window.partitionBy(key).orderBy("__b"), F.expr(f"unix_micros(timestamp_micros(0) + interval {idle})")
    own = Window.partitionBy(key, "__b").orderBy("__t", "src_path", "event_type")
    last = rows.groupBy(key, "__b").agg(F.max("__t").alias("__last"))
    before = stored(last.select(F.col(key).alias("__k"), "__b", F.lag("__last").over(by_key).alias("__prev")), "batch-last")  # a row for each key and bucket
    same = F.col(key).eqNullSafe(F.col("__k"))
    rows = rows.join(before.withColumnRenamed("__b", "__b2"), same & (F.col("__b") == F.col("__b2"))).drop("__k", "__b2")
    rows = rows.withColumn("__new", F.coalesce(F.col("__t") - F.coalesce(F.lag("__t").over(own), "__prev") > limit, F.lit(True)))
    rows = rows.withColumn("__start", F.max(F.when(F.col("__new"), F.col("__t"))).over(own)).withColumn("__r", F.row_number().over(own))
    # Of each bucket: its last start, and its rows from there on (all, if nothing starts in it).
    ends = rows.groupBy(key, "__b").agg(F.max("__start").alias("s"), F.count("*").alias("all"), F.max(F.when(F.col("__new"), F.col("__r"))).alias("first"))
    ends = ends.withColumn("tail", F.col("all") - F.coalesce(F.col("first") - 1, F.lit(0))).withColumn("g", F.count("s").over(by_key))
    run = Window.partitionBy(key, "g").orderBy("__b")
    ends = ends.withColumn("n", F.sum("tail").over(run)).withColumn("s", F.max("s").over(Window.partitionBy(key, "g")))
    carried = stored(ends.select(F.col(key).alias("__k"), F.col("__b").alias("__b2"), F.lag("s").over(by_key).alias("__s"), F.lag("n").over(by_key).alias("__n")), "batch-open")
    rows = rows.join(carried, same & (F.col("__b") == F.col("__b2"))).drop("__k", "__b2")
    begin = F.min(F.when(F.col("__new"), F.col("__r"))).over(Window.partitionBy(key, "__b", "__start"))
    place = F.when(F.col("__start").isNull(), F.col("__n") + F.col("__r")).otherwise(F.col("__r") - begin + 1)
    rows = rows.withColumn("start", F.timestamp_micros(F.coalesce("__start", "__s"))).withColumn("chunk", F.floor((place - 1) / size))
    out = rows.groupBy(key, "start", "chunk", "src_path", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return out.where((F.col("event_type") != "modified") | (F.col("n") >= least_modified))


def apply_events(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """events with what each asks of the catalog: ingest, reingest, mark_deleted or none, and the path it is about."""
    kind = F.col("event_type")
    action = F.when(kind.isin("created", "moved"), "ingest").when((kind == "modified") & should_reprocess(F.col("src_path"), types), "reingest").when(kind == "deleted", "mark_deleted").otherwise("none")
    return events.withColumn("action", action).withColumn("path", F.when(kind == "moved", F.coalesce("dest_path", "src_path")).otherwise(F.col("src_path")))


def detect_bursts_stream(df: DataFrame, key: str, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """(key, start, end, n): runs of two or more captures of a key whose steps are at most the gap."""
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).where("n >= 2").drop("w")


def dedupe_stream(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; on a stream, repeats within the delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def event_stats(received: DataFrame, debounced: DataFrame) -> DataFrame:
    """received, dropped (too late to be debounced at all), debounced (held back), processed, and mean events a processed row."""
    n = received.agg(F.count("*").alias("received"))
    d = debounced.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("debounced"), F.count("*").alias("processed"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_batch"))
    both = n.unionByName(d, allowMissingColumns=True)  # one row each
    both = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return both.withColumn("dropped", F.col("received") - F.col("debounced") - F.col("processed"))


def catalog_sink(base: str, types: list[str] | None = None, describe: Callable[[SparkSession, DataFrame], DataFrame] = describe_files, stream: str = "events", index: str | None = None) -> Callable[[DataFrame, int], None]:
    """For on_batch(): takes each batch of events (event_type, src_path, dest_path, is_directory, ts) into the catalog under base, in one commit.

    The last event of a path in the batch counts. New and moved-to paths are described (size, mtime, hash, perceptual_hash, error), held against the stored
    files and elected as by jobs.ingest(): keepers become rows of files with a task each, duplicates and unreadable files only count in ingestion_logs. Changed
    files that are stored get their new hash and size and a new task; deleted ones are marked and done. Only buckets that the
    batch touches are written, and a batch given twice changes nothing. describe: another way to look at files, with fingerprints say.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        catalog = Catalog(spark, base)
        if catalog.manifest()["batches"].get(stream, -1) >= number:
            return
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), "event_type"))
        todo = apply_events(filter_events(batch), types).where("action <> 'none'").withColumn("__r", last).where("__r = 1")
        todo = stored(todo.select(F.col("path").alias("file_path"), "action", F.col("ts").cast("timestamp").alias("__ts")), "sink-todo")
        files = catalog.read("files")
        ours = files.join(todo, "file_path")
        gone = ours.where("action = 'mark_deleted'").withColumns({"processed": F.lit(True), "error": F.lit("File not found")})
        seen = stored(describe(spark, todo.where("action <> 'mark_deleted'").select(F.col("file_path").alias("path"))), "sink-seen")
        now = F.current_timestamp()
        again = ours.where("action <> 'mark_deleted'").drop("file_hash", "file_size", "perceptual_hash", "error").join(
            seen.select(F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("size").alias("file_size"), "perceptual_hash", "error"), "file_path"
        ).withColumn("processed", F.col("error").isNotNull())
        elected, tasks, summary = jobs.ingest(seen.join(todo.where("action = 'ingest'").select(F.col("file_path").alias("path"), "__ts"), "path"), files, now, index=index)
        fresh = jobs.stored_rows(elected, now)
        columns = files.columns
        changes = stored(gone.select(columns).unionByName(again.select(columns)).unionByName(fresh.select(columns)), "sink-files")
        redo = queue.enqueue(again.where("error is null").select("id"), 5, now)
        tasks = tasks.unionByName(redo).withColumns({"id": F.xxhash64("file_id", F.lit(stream), F.lit(number)), "retry_count": F.lit(0), **{c: F.lit(None).cast(t) for c, t in (("started_at", "timestamp"), ("completed_at", "timestamp"), ("error", "string"))}})
        catalog.commit(upserts={"files": changes}, appends={"processing_queue": tasks, "ingestion_logs": jobs.ingestion_log(summary, now, now)}, stream=stream, batch=number)

    return apply


def on_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, event_type: str | None = None):
    """Start the stream and give each batch (of one event type, if asked) to fn; runs until what is there is done."""
    rows = stream if event_type is None else stream.where(F.col("event_type") == event_type)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fn).start()
