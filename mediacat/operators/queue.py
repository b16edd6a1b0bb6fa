"""The work queue: picking, closing, retrying and purging tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.text import classify_error
from mediacat.storage import row_numbers

# Seconds before each retry.
RETRY_DELAYS = (3, 9, 27)


def next_tasks(queue: DataFrame, n: int = 1) -> DataFrame:
    """Pending tasks by priority, oldest first; ties to the smaller id."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("tasks"))


def processing_stats(queue: DataFrame) -> DataFrame:
    """Processed, errors, and mean seconds a task (0 if none)."""
    seconds = F.col("completed_at").cast("double") - F.col("started_at").cast("double")
    return queue.agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status") == "failed").alias("errors"), F.round(F.coalesce(F.avg(F.when(F.col("status") == "completed", seconds)), F.lit(0.0)), 6).alias("mean_seconds"))


def purge_queue(queue: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Without the tasks that finished before the cutoff; what has no end time stays."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") < as_of - F.make_dt_interval(F.lit(days)))
    return queue.where(~F.coalesce(old, F.lit(False)))


def enqueue(ids: DataFrame, level: Column | int, as_of: Column) -> DataFrame:
    """One pending task for each id; priority is ten times the level."""
    level = F.lit(level) if isinstance(level, int) else level
    return ids.select(F.col("id").alias("file_id"), F.lit("analyze").alias("task_type"), (level * 10).cast("int").alias("priority"), F.lit("pending").alias("status"), as_of.alias("created_at"))


def requeue_all(files: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(files with their flags reset, a new queue with one task each, numbered in order of the files); the analysis table starts empty."""
    reset = files.withColumns({"processed": F.lit(False), "analyzed_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    return reset, row_numbers(enqueue(files.select("id"), 1, as_of), ["file_id"], "id").withColumn("id", F.col("id").cast("long"))


def apply_retry_policy(failed: DataFrame, max_retries: int, as_of: Column) -> DataFrame:
    """failed (error, retry_count) with the next state: one more retry, final by message or after the last, and when it may run."""
    n = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
    final = (classify_error(F.col("error")) == "final") | (n >= max_retries)
    delay = F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(n, F.lit(len(RETRY_DELAYS))))
    return failed.withColumns({"status": F.when(final, "failed_final").otherwise("failed_temp"), "next_allowed_at": F.when(~final, as_of + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))), "retry_count": n})


def close_tasks(queue: DataFrame, files: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Tasks with a result are completed or failed by its error; tasks whose file is missing fail."""
    there = files.select(F.col("id").alias("file_id"), F.lit(True).alias("__there"))
    rows = queue.join(results.select("file_id", F.col("error").alias("__error"), F.lit(True).alias("__done")), "file_id", "left").join(there, "file_id", "left")
    missing = F.col("__there").isNull()
    open_ = F.col("status").isin("pending", "processing")
    touched = open_ & (missing | F.col("__done").isNotNull())
    error = F.when(missing, "File not found").otherwise(F.col("__error"))
    return rows.withColumns({"error": F.when(touched, error).otherwise(F.col("error")), "completed_at": F.when(touched, as_of).otherwise(F.col("completed_at")), "status": F.when(touched, F.when(error.isNull(), "completed").otherwise("failed")).otherwise(F.col("status"))}).drop("__error", "__done", "__there")
