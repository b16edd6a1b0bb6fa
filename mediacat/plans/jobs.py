"""Jobs that combine the operators, and the hook for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from inspect import Parameter, Signature

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from mediacat.functions.paths import file_type, mime_type
from mediacat.functions.records import metadata_projection
from mediacat.functions.text import caption_mood, caption_sensitive, caption_tags, content_hash, contains_text, embedding_text, object_labels
from mediacat.operators import bursts, catalog, dedup, queue, sensitivity
from mediacat.operators.clustering import assign_clusters, cluster_vectors, person_rollup
from mediacat.operators.ignore import filter_ignored
from mediacat.storage import stored


def score_with(df: DataFrame, make_fn: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: StructType) -> DataFrame:
    """df's rows through a user model: make_fn() once a task, its function on each batch; a batch that fails is tried row by row, and rows that fail carry the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for b in batches:
            try:
                yield fn(b).assign(error=None)
            except Exception:  # noqa: BLE001 - one row's fault must not end the job
                for i in range(len(b)):
                    try:
                        yield fn(b.iloc[i : i + 1]).assign(error=None)
                    except Exception as e:  # noqa: BLE001
                        row = {f.name: b[f.name].iloc[i] if f.name in b else None for f in schema.fields}
                        yield pd.DataFrame([row | {"error": str(e)}])

    return df.mapInPandas(run, StructType([*schema.fields, StructField("error", StringType())]))


def predict_with(df: DataFrame, make_predict: Callable[[], Callable[..., np.ndarray]], inputs: list[str], batch_size: int = 256, output: str = "prediction") -> DataFrame:
    """df with a numeric model's prediction (double) and error (string) for each row. make_predict() loads the model once in a Python worker and gives a function of
    arrays, one for each input column (numbers, or arrays of numbers of one length), to an array of numbers.

    Where a batch fails, its rows are tried one by one, and a row that fails has its error and no prediction. Rows with a null input aren't given to the model.
    """

    def make() -> Callable[..., list[dict]]:
        predict = make_predict()

        def run(*columns: np.ndarray) -> list[dict]:
            try:
                return [{"value": float(x), "error": ""} for x in predict(*columns)]
            except Exception:  # noqa: BLE001 - one row's fault must not end the job
                out = []
                for i in range(len(columns[0])):
                    try:
                        out.append({"value": float(predict(*(c[i : i + 1] for c in columns))[0]), "error": ""})
                    except Exception as e:  # noqa: BLE001
                        out.append({"value": float("nan"), "error": str(e) or type(e).__name__})
                return out

        # The number of inputs is read off the function.
        run.__signature__ = Signature([Parameter(f"c{n}", Parameter.POSITIONAL_ONLY) for n in range(len(inputs))])
        return run

    fields = df.schema
    shapes = {}
    for n, c in enumerate(inputs):
        if isinstance(fields[c].dataType, ArrayType):
            size = df.where(F.col(c).isNotNull()).agg(F.max(F.size(c))).first()[0] or 1
            shapes[n] = [int(size)]
    types = StructType([StructField("value", DoubleType()), StructField("error", StringType())])
    score = predict_batch_udf(make, return_type=types, batch_size=batch_size, input_tensor_shapes=shapes or None)
    given = F.lit(True)
    for c in inputs:
        given = given & F.col(c).isNotNull()
    asked, rest = df.where(given), df.where(~given)
    done = asked.withColumn("__p", score(*inputs)).select(*df.columns, F.when(F.col("__p.error") == "", F.col("__p.value")).alias(output), F.nullif("__p.error", F.lit("")).alias("error"))
    return done.unionByName(rest.select(*df.columns, F.lit(None).cast("double").alias(output), F.lit("a null input").alias("error")))


def ingest(listing: DataFrame, files: DataFrame, as_of: Column, hash_col: str = "hash", index: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new files with keeper, duplicate_of, score and error; their tasks; a summary row). listing (path, size, mtime, is_dir, hash, perceptual_hash).

    Cheap tests first: ignored and known paths go. A file whose hash is null couldn't be read: it is an error, with the listing's error if it has
    one. The others are held against the stored files (equal content, then near fingerprints) and then elected, oldest first. files: the catalog's
    table; index: where write_fingerprints() keeps its fingerprints, so that only keys of new files are read.
    """
    fresh = catalog.new_files(filter_ignored(listing), files)
    said = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    error = F.when(F.col(hash_col).isNull(), F.coalesce(said, F.lit("content could not be read")))
    rows = fresh.select(F.xxhash64("path").alias("id"), F.col("path").alias("file_path"), F.col(hash_col).alias("file_hash"), "perceptual_hash", F.col("size").alias("file_size"), "mtime", file_type(F.col("path")).alias("file_type"), mime_type(F.col("path")).alias("mime_type"), error.alias("error"))
    rows = stored(rows, "ingest-rows")
    held = dedup.duplicates(rows.where("error is null").select("id", "file_hash", "perceptual_hash", "mtime", "file_path"), ["mtime", "file_path"], known=files.select("id", "file_hash", "perceptual_hash"), index=index)
    elected = stored(rows.join(held, "id", "left").withColumn("keeper", F.coalesce("keeper", F.lit(False))), "ingest-elected")
    tasks = queue.enqueue(elected.where("keeper").select("id"), 5, as_of)
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("keeper"), "ingested").otherwise("duplicate")
    return elected, tasks, catalog.ingestion_summary(elected.select(outcome.alias("outcome"), F.col("file_size").alias("size")))


def ingestion_log(summary: DataFrame, started: Column, finished: Column) -> DataFrame:
    """The row of the ingestion_logs table for ingest()'s summary."""
    counts = ("ingested", "duplicates", "errors")
    details = F.create_map(*(x for c in counts for x in (F.lit(c), F.col(c).cast("long"))))
    return summary.select(started.alias("started_at"), finished.alias("finished_at"), *(F.col(c).cast("int").alias(c) for c in counts), F.col("total_size").cast("long").alias("total_size"), details.alias("details"))


def stored_rows(elected: DataFrame, as_of: Column) -> DataFrame:
    """The rows of the files table for ingest()'s keepers."""
    return elected.where("keeper").select("id", "file_path", "file_hash", "perceptual_hash", "file_size", "file_type", "mime_type", as_of.alias("ingested_at"), F.lit(None).cast("timestamp").alias("analyzed_at"), F.lit(False).alias("processed"), F.lit(None).cast("string").alias("error"))


def cull(photos: DataFrame, faces: DataFrame, gap: float = 1.0, keep: int = 1, action: str = "mark", partition: str | None = None) -> DataFrame:
    """photos (id, path, ts, sharpness, aesthetic) in bursts, with score, action and the burst's best."""
    keys = [partition, "burst"] if partition else ["burst"]
    found = bursts.detect_bursts(photos, gap=gap, partition=partition)
    scored = found.join(bursts.face_score(found, faces), "id").join(bursts.eye_score(found, faces), "id")
    scored = scored.withColumn("score", bursts.photo_score(F.col("sharpness"), F.col("face_score"), F.col("eye_score"), F.col("aesthetic")))
    return bursts.cull_actions(scored, keys, keep, action)


def privacy_scan(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(safe rows, vault, summary) of documents (text, name, contains_text, is_sensitive)."""
    scanned = sensitivity.detect_sensitive(df)
    safe, vault = sensitivity.quarantine(scanned, key)
    return safe, vault, sensitivity.sensitivity_summary(scanned)


def enrich_captions(df: DataFrame, caption: str = "caption", objects: str = "objects", text: str = "text") -> DataFrame:
    """df (caption, objects array<label, score>, text) with labels, tags, mood, sensitivity, contains_text and embedding_text."""
    rows = df.withColumn("labels", object_labels(F.col(objects))).withColumn("tags", caption_tags(F.col(caption)))
    return rows.withColumns({"mood": caption_mood(F.col(caption)), "is_sensitive": caption_sensitive(F.col(caption), F.col("labels")), "contains_text": contains_text(F.col(text)), "embedding_text": embedding_text(F.col(caption), F.col("tags"))})


def metadata_to_write(files: DataFrame, analysis: DataFrame, written: DataFrame, scale: float = 10.0) -> DataFrame:
    """(file_id, file_path, metadata) of analysed files that were not written yet."""
    rows = analysis.join(files.select(F.col("id").alias("file_id"), "file_path"), "file_id").join(written.select("file_id"), "file_id", "left_anti")
    return metadata_projection(rows, scale).select("file_id", "file_path", "metadata")


def maintain(files: DataFrame, listing: DataFrame, tasks: DataFrame, prefix: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(files with orphans marked, the queue without old finished tasks)."""
    return catalog.mark_orphans(files, listing, prefix), queue.purge_queue(tasks, as_of)


def identify_faces(faces: DataFrame, gallery: DataFrame, files: DataFrame, eps: float, min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """(faces with cluster and person_id, rollup by person). faces (id, file_id, embedding)."""
    clustered = faces.join(cluster_vectors(faces, eps, min_samples), "id")
    found = assign_clusters(clustered, gallery)
    named = clustered.join(found.select("cluster", "person_id"), "cluster", "left")
    return named, person_rollup(named, files)


def hash_contents(df: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    return df.withColumn("file_hash", content_hash(F.col(content), algorithm)).drop(content)
