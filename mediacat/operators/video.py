"""Video: sampled frames, scene changes, and files that are still being written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyframe_times(df: DataFrame, every: int = 10, duration: str = "duration") -> DataFrame:
    """df with one row for each of 0, every, 2 * every ... below the whole seconds of duration; none for less than a second."""
    last = F.col(duration).cast("int") - 1
    return df.where(last >= 0).withColumn("frame_time", F.explode(F.sequence(F.lit(0), last, F.lit(every))))


def middle_time(duration: Column) -> Column:
    return F.when(duration > 0, duration / 2).otherwise(0.0)


def scene_changes(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(video_id, scene_changes): times of frames (video_id, frame_ts, luma) whose mean absolute difference to the frame before exceeds threshold * 255."""
    rows = frames.withColumn("before", F.lag("luma").over(Window.partitionBy("video_id").orderBy("frame_ts")))
    diff = F.aggregate(F.zip_with("luma", "before", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size("luma")
    changed = rows.withColumn("t", F.when(diff > threshold * 255, F.col("frame_ts")))
    return changed.groupBy("video_id").agg(F.sort_array(F.collect_list("t")).alias("scene_changes"))


def stable_files(snapshots: DataFrame, required: int = 3) -> DataFrame:
    """(path, stable_at): when a file's size (path, ts, size) has been equal to the one before `required` times in a row, first such time."""
    w = Window.partitionBy("path").orderBy("ts")
    rows = snapshots.withColumn("changed", F.coalesce((F.col("size") != F.lag("size").over(w)).cast("long"), F.lit(1).cast("long")))
    rows = rows.withColumn("island", F.sum("changed").over(w))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "island").orderBy("ts")))
    return rows.where(F.col("nth") == required + 1).groupBy("path").agg(F.min("ts").alias("stable_at"))
