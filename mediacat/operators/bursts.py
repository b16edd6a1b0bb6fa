"""Photo bursts: sessions of captures, their ids, scores, and what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from mediacat.storage import stored

# Weights of a photo's score; composition is a constant.
WEIGHTS = {"sharpness": 0.3, "face": 0.25, "eye": 0.2, "aesthetic": 0.15}
COMPOSITION, COMPOSITION_WEIGHT = 0.5, 0.1
BUCKET_SECONDS = 3600
#: Rows of photos that a task sorts, as long as no bucket or burst has more.
TASK_ROWS = 100_000


def detect_bursts(df: DataFrame, ts: str = "ts", path: str = "path", gap: float = 1.0, partition: str | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """df with burst (a number by time) for rows in runs of two or more whose steps are at most `gap` seconds; others go.

    Without a partition the order is global: it is cut into time buckets, each numbered on its own, and only one row for
    each bucket carries the last time and the count of starts on to the next. Ties in time are ordered by path.
    """
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).withColumn("__t", sec)
    limit = F.lit(round(gap * 1_000_000))
    if partition:
        w = Window.partitionBy(partition).orderBy("__t", path)
        before, after = F.lag("__t").over(w), F.lead("__t").over(w)
    else:
        rows = rows.withColumn("__b", F.floor(F.col("__t") / (bucket_seconds * 1_000_000)))
        ends = rows.groupBy("__b").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.count("*").alias("__rows"))
        order = Window.orderBy("__b")  # a row for each bucket
        around = stored(ends.select("__b", "__rows", F.lag("__last").over(order).alias("__prev"), F.lead("__first").over(order).alias("__next")), "buckets")
        rows = rows.repartition(_tasks(around.agg(F.sum("__rows")).first()[0] or 0), "__b").join(F.broadcast(around.drop("__rows")), "__b")
        w = Window.partitionBy("__b").orderBy("__t", path)
        before, after = F.coalesce(F.lag("__t").over(w), F.col("__prev")), F.coalesce(F.lead("__t").over(w), F.col("__next"))
    # A row starts a run if the one before is too far off; it is alone if the one after starts one as well.
    starts = lambda t, last: F.coalesce((t - last > limit).cast("long"), F.lit(1).cast("long"))
    rows = rows.withColumns({"__new": starts(F.col("__t"), before), "__over": starts(after, F.col("__t"))}).withColumn("burst", F.sum("__new").over(w))
    if not partition:
        base = rows.groupBy("__b").agg(F.sum("__new").alias("__n")).select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__base"))
        rows = rows.join(F.broadcast(base), "__b").withColumn("burst", F.col("__base") + F.col("burst")).drop("__b", "__base", "__prev", "__next")
    rows = rows.where("__new = 0 or __over = 0").drop("__t", "__new", "__over")
    return stored(rows.select(*([partition] if partition else []), "burst", *(c for c in df.columns if c != partition)), "bursts")


def _tasks(rows: int) -> int:
    """So many tasks that none sorts many more than TASK_ROWS."""
    return rows // TASK_ROWS + 1


def burst_id(df: DataFrame, keys: list[str], ts: str = "ts", path: str = "path") -> DataFrame:
    """(keys, burst_id): burst_<first time>_<8 hex of md5 over each path and time, in order>."""
    t = F.col(ts).cast("timestamp")
    micros = F.date_format(t, "SSSSSS")
    text = F.concat(F.col(path), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(t.alias("t"), F.col(path).alias("p"), text.alias("x")))).alias("r"))
    return rows.select(*keys, F.concat(F.lit("burst_"), F.date_format(F.get("r", F.lit(0))["t"], "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.array_join(F.transform("r", lambda x: x["x"]), "")), 1, 8)).alias("burst_id"))


def face_score(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, face_score): 0.7 of the mean confidence and 0.3 of the number of faces up to ten; 0.3 without faces."""
    found = faces.groupBy("file_id").agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    return photos.join(found, F.col("id") == F.col("file_id"), "left").select("id", F.coalesce(0.7 * F.col("c") + 0.3 * F.least(F.lit(1.0), F.col("n") / 10), F.lit(0.3)).alias("face_score"))


def eye_score(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, eye_score): mean of the known eye values, 0.5 if there are none."""
    found = faces.groupBy("file_id").agg(F.avg("eye_open_prob").alias("e"))
    return photos.join(found, F.col("id") == F.col("file_id"), "left").select("id", F.coalesce("e", F.lit(0.5)).alias("eye_score"))


def photo_score(sharpness: Column, face: Column, eye: Column, aesthetic: Column) -> Column:
    parts = {"sharpness": sharpness, "face": face, "eye": eye, "aesthetic": aesthetic}
    total = F.lit(COMPOSITION * COMPOSITION_WEIGHT)
    for k, w in WEIGHTS.items():
        total = total + parts[k] * w
    return total


def _by_burst(df: DataFrame, keys: list[str], ts: str, path: str, score: str) -> tuple[DataFrame, WindowSpec]:
    """df dealt by burst to as many tasks as its rows ask for, and the order of a burst."""
    return df.repartition(_tasks(df.count()), *keys), Window.partitionBy(*keys).orderBy(F.desc(score), ts, path)


def select_best(df: DataFrame, keys: list[str], keep: int = 1, ts: str = "ts", path: str = "path", score: str = "score") -> DataFrame:
    """The best `keep` rows of each burst; ties in burst order."""
    rows, w = _by_burst(df, keys, ts, path, score)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("rank")


def cull_actions(df: DataFrame, keys: list[str], keep: int = 1, action: str = "mark", ts: str = "ts", path: str = "path", score: str = "score") -> DataFrame:
    """df with action (keep, or the one chosen) and best (the burst's best path)."""
    rows, w = _by_burst(df, keys, ts, path, score)
    return rows.withColumn("best", F.first_value(path).over(w)).withColumn("action", F.when(F.row_number().over(w) <= keep, "keep").otherwise(action))


def culling_totals(summary: DataFrame) -> DataFrame:
    """One row for the whole run, from the bursts' rows: bursts, photos, kept and culled."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return summary.agg(F.count("*").alias("bursts"), total("photos"), total("kept"), total("culled"))


def burst_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """For rows with actions: one row a burst with its photos, kept and culled."""
    kept = F.count_if(F.col("action") == "keep")
    return df.groupBy(*keys).agg(F.count("*").alias("photos"), kept.alias("kept"), (F.count("*") - kept).alias("culled"), F.min("best").alias("best"))
