"""Joins, counts and reports over the catalog's tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.paths import COUNTER, RAW, directory, extension, is_burst_name, stem
from mediacat.storage import partitions, stored

#: Pairs that a share and a block of a content's files make, those that a task gives, and how many tasks there are at most.
PAIRS_A_SHARE, PAIRS_A_TASK, MOST_TASKS = 1 << 24, 1 << 26, 10_000
#: Files of a block (Parquet packs numbers in runs of 504, so runs of a block repeat byte for byte), and files of one content that are sorted at once.
BLOCK, PIECE = 504, 1 << 17


def latest_analysis(files: DataFrame, analysis: DataFrame, n: int = 20) -> DataFrame:
    """The n analyses made last, with their files; ties to the smaller id."""
    return files.join(analysis, files["id"] == analysis["file_id"]).orderBy(F.desc("analyzed_at"), "file_id").limit(n)


def mark_orphans(files: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """files with those under a folder that are no longer listed marked processed, with an error."""
    there = listing.select(F.col("path").alias("__p")).distinct().withColumn("__there", F.lit(True))
    gone = F.col("file_path").startswith(prefix.rstrip("/") + "/") & F.col("__there").isNull()
    rows = files.join(there, F.col("file_path") == F.col("__p"), "left")
    return rows.withColumn("processed", F.when(gone, True).otherwise(F.col("processed"))).withColumn("error", F.when(gone, "File not found").otherwise(F.col("error"))).drop("__p", "__there")


def new_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    return listing.join(files.select(F.col("file_path").alias("path")), "path", "left_anti")


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of equal content under another path.

    All pairs: of one content as many as the square of its files. Left files of a content are dealt to shares and right ones, by path, to blocks. A share and a
    block meet in one task, where every left file meets the block's files in the same order: what is written of the pairs repeats itself, and encodes
    to a small part of what it takes in any order. content_classes() has a row for each file instead.
    """
    spark, keys = left.sparkSession, ["file_hash", "left_share", "right_share"]
    count = lambda df, n: df.where("file_hash is not null").groupBy("file_hash").agg(F.count("file_path").alias(n))
    counts = count(left, "l").join(count(right, "r"), "file_hash", "full_outer")
    counts = stored(counts.where("greatest(l, r) > 1"), "contents")
    pairs = counts.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0
    tasks = max(partitions(spark), min(MOST_TASKS, math.ceil(pairs / PAIRS_A_TASK)))  # few rows may stand for very many pairs

    ways = lambda n, most: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / most), F.lit(1)).cast("int")
    hot = counts.select("file_hash", ways("l", max(1, PAIRS_A_SHARE // BLOCK)).alias("shares"), ways("r", PIECE).alias("pieces"), "r")
    hot = hot.withColumn("blocks", ways(F.col("r") / F.col("pieces"), BLOCK) + (F.col("pieces") > 1).cast("int")).drop("r")
    hot = F.broadcast(hot.where("shares > 1 or pieces * blocks > 1"))  # at most one for each BLOCK files

    def files(df: DataFrame) -> DataFrame:
        known = df.where("file_hash is not null and file_path is not null")
        known = known.select("file_hash", F.struct(F.col("file_path").alias("path"), "id").alias("file"), F.xxhash64("id", "file_path").alias("deal"))
        return known.join(hot, "file_hash", "left").fillna(1, ["shares", "pieces", "blocks"])

    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = files(left).groupBy("file_hash", F.expr("int(pmod(deal, shares))").alias("left_share"), F.expr("pieces * blocks").alias("n")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    a = a.select("file_hash", "left_share", each(F.col("n")).alias("right_share"), "files").repartition(tasks, *keys).select(*keys, F.explode("files").alias("a"))
    b = files(right).withColumn("piece", F.expr("int(pmod(deal, pieces))"))
    place = F.row_number().over(Window.partitionBy("file_hash", "piece").orderBy("file")) - 1
    block = F.least(F.floor(place / BLOCK).cast("int"), F.col("blocks") - 1)  # pieces differ a little in size
    b = b.select("file_hash", "shares", (F.col("piece") * F.col("blocks") + block).alias("right_share"), F.col("file").alias("b"))
    b = b.select("file_hash", each(F.col("shares")).alias("left_share"), "right_share", "b").repartition(tasks, *keys)
    return a.hint("merge").join(b, keys).where("a.path <> b.path").select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


def content_classes(files: DataFrame) -> DataFrame:
    """files with class_id and class_size: the smallest id among the files of equal content, and how many they are.

    One row a file, however many share a content; a null hash is no content, and its class is null.
    """
    known = files.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return files.join(known, "file_hash", "left").select(*files.columns, "class_id", "class_size")


def _named(df: DataFrame, path: str) -> DataFrame:
    p = F.col(path)
    return df.select(p.alias("path"), directory(p).alias("dir"), stem(p).alias("stem"), extension(p).alias("ext"))


def raw_jpeg_pairs(df: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, related): raw files and JPEGs of the same folder and stem, both ways."""
    files = _named(df, path)
    raw, jpeg = files.where(F.col("ext").isin(*RAW)), files.where(F.col("ext").isin("jpg", "jpeg"))
    pairs = raw.join(jpeg.withColumnRenamed("path", "related"), ["dir", "stem"]).select("path", "related")
    return pairs.unionByName(pairs.select(F.col("related").alias("path"), F.col("path").alias("related")))


def live_photo_pairs(df: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, related): stills and the movie of the same folder and stem."""
    files = _named(df, path)
    still, movie = files.where(F.col("ext").isin("heic", "jpg", "jpeg")), files.where(F.col("ext") == "mov")
    return still.join(movie.withColumnRenamed("path", "related"), ["dir", "stem"]).select("path", "related")


def burst_siblings(df: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, related): for names of bursts, files of the same folder, ending, and stem without its counter."""
    files = _named(df, path).withColumn("base", F.regexp_replace("stem", COUNTER, "")).withColumn("burst", is_burst_name(F.col("path")))
    own = files.where("burst").select("dir", "base", "ext", "path")
    return own.join(files.select("dir", "base", "ext", F.col("path").alias("related")), ["dir", "base", "ext"]).where("path <> related").select("path", "related")


def related_files(df: DataFrame, path: str = "file_path") -> DataFrame:
    kinds = {"raw_jpeg": raw_jpeg_pairs, "live_photo": live_photo_pairs, "burst": burst_siblings}
    parts = [f(df, path).withColumn("kind", F.lit(k)) for k, f in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_manifests(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Full outer comparison by key of (key, size, hash): which side has it, and what agrees."""
    left, right = a.select(F.col(key), F.col("size").alias("ls"), F.col("hash").alias("lh"), F.lit(True).alias("l")), b.select(F.col(key), F.col("size").alias("rs"), F.col("hash").alias("rh"), F.lit(True).alias("r"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = left.join(right, key, "full_outer").select(key, yes(F.col("l")).alias("exists_left"), yes(F.col("r")).alias("exists_right"), yes(F.col("ls") == F.col("rs")).alias("same_size"), yes(F.col("lh") == F.col("rh")).alias("same_hash"))
    return rows.withColumn("identical", F.col("same_size") & F.col("same_hash"))


def ingestion_summary(results: DataFrame) -> DataFrame:
    """results (outcome, size): counts of each outcome, and the size of what was ingested."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k if k == "ingested" else f"{k}s")
    return results.agg(n("ingested"), n("duplicate"), n("error"), F.coalesce(F.sum(F.when(F.col("outcome") == "ingested", F.col("size"))), F.lit(0)).alias("total_size"))


def embedding_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct("file_id").alias("files"), F.countDistinct("embedding_type").alias("types"))


def catalog_status(files: DataFrame) -> DataFrame:
    """total, analysed, vaulted and pending in one pass."""
    return files.agg(F.count("*").alias("total"), F.count_if("processed").alias("analysed"), F.count_if(F.col("error").like("Vaulted:%")).alias("vaulted")).withColumn("pending", F.col("total") - F.col("analysed"))


def media_stats(df: DataFrame) -> DataFrame:
    """df (file_type, faces, error): what one analysis run did."""
    return df.agg(F.count("*").alias("processed"), F.count_if(F.col("file_type") == "image").alias("images"), F.count_if(F.col("file_type") == "video").alias("videos"), F.coalesce(F.sum("faces"), F.lit(0)).alias("faces"), F.count("error").alias("errors"))


def unprocessed(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows not processed yet, from a time on if one is given."""
    rows = df.where(~F.col("processed"))
    return rows if since is None else rows.where(F.col("ingested_at") >= since)


def recent(df: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Rows analysed within the last hours."""
    return df.where((F.col("analyzed_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("analyzed_at") <= as_of))


def vaulted(files: DataFrame, yes: bool = True) -> DataFrame:
    """Files that lie in the vault, or those that don't."""
    there = F.coalesce(F.col("error").like("Vaulted:%"), F.lit(False))
    return files.where(there if yes else ~there)


def merge_analysis(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by file_id. Image fields only where the update has an image result (caption), duration and place only where given; the rest always."""
    kept_if_absent = {"caption": "caption", "tags": "caption", "objects": "caption", "mood": "caption", "contains_text": "caption", "is_sensitive": "caption", "video_duration": "video_duration", "latitude": "latitude", "longitude": "latitude", "altitude": "latitude"}
    old, new = existing.withColumn("__o", F.lit(True)).alias("o"), updates.withColumn("__n", F.lit(True)).alias("n")
    both = old.join(new, F.col("o.file_id") == F.col("n.file_id"), "full_outer")
    cols = [F.coalesce("n.file_id", "o.file_id").alias("file_id")]
    for c in existing.columns:
        if c == "file_id":
            continue
        has = F.col("n.__n") & F.col(f"n.{kept_if_absent[c]}").isNotNull() if c in kept_if_absent else F.col("n.__n")
        value = F.coalesce(F.col(f"n.{c}"), F.array().cast(existing.schema[c].dataType)) if c == "scene_changes" else F.col(f"n.{c}")
        cols.append(F.when(has, value).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def upsert_embeddings(base: DataFrame, updates: DataFrame) -> DataFrame:
    return base.join(updates, ["file_id", "embedding_type"], "left_anti").unionByName(updates)


def delete_embeddings(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids, "file_id", "left_anti")


def get_embedding(df: DataFrame, file_id: int, embedding_type: str) -> DataFrame:
    return df.where((F.col("file_id") == file_id) & (F.col("embedding_type") == embedding_type))


def append_faces(base: DataFrame, detections: DataFrame) -> DataFrame:
    """New face rows: whole boxes; an age or eye value of zero is unknown; no person or cluster yet."""
    boxes = {f"bbox_{c}": F.col(f"bbox_{c}").cast("int") for c in ("x1", "y1", "x2", "y2")}
    rows = detections.withColumns(boxes | {"age": F.nullif(F.col("age").cast("int"), F.lit(0)), "eye_open_prob": F.nullif(F.col("eye_open_prob"), F.lit(0.0)), "person_id": F.lit(None).cast("long"), "cluster_id": F.lit(None).cast("int")})
    return base.unionByName(rows.select(base.columns))
