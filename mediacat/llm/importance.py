"""Quality by importance resampling: how much likelier a document is under target text than under raw text.

Both models are bags of hashed word unigrams and bigrams. The raw model counts every document, the target model a bounded
sample of documents labelled good. A document's log weight is the sum of its n-grams' log ratios; adding Gumbel noise
and keeping the largest keys draws without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table

BUCKETS = 10_000
TARGET_SAMPLE = 20_000
KEEP = 0.85
SEED = 7
COLLECT = 10_000


def grams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all word unigrams and bigrams of the whole text, repeats included."""
    words = (text or "").lower().split()
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    h = np.concatenate([h * np.uint64(0x2545F4914F6CDD1D), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]])
    return (((h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = TARGET_SAMPLE) -> np.ndarray:
    """Log of target over raw probability of each bucket, each count plus one.

    Target: documents labelled quality 1 and not toxic, at most `sample` of them by a hash of doc_id.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    good = good.orderBy(F.xxhash64("good"), "good").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(good), F.col("doc_id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("is_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, is_good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                one = np.bincount(grams(text.as_py(), buckets), minlength=buckets)
                raw += one
                target += one * is_good
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row for each bucket
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The kth largest value of a double column, by counting ever narrower ranges; null if there are fewer."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or n < k:
        return None
    while True:
        inside = df.where(F.col(col).between(low, high))
        if low == high:
            return low
        if n <= COLLECT:
            return inside.select(col).orderBy(F.desc(col)).limit(k).agg(F.min(col)).first()[0]
        width = (high - low) / 1024
        part = F.least(F.floor((F.col(col) - low) / width), F.lit(1023))
        for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).orderBy(F.desc("part")).collect():
            if r.n >= k:
                low, high, n = r.a, r.b, r.n
                break
            k -= r.n


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int = BUCKETS, sample: int = TARGET_SAMPLE, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_grams, log_weight, sample_key, selected.

    The round(keep * rows) largest keys are selected, with all that equal the last of them. Noise comes from a hash of doc_id, so
    reruns agree and rows that share a doc_id share it. Null and wordless texts weigh 0 (log), with no label all do. Other columns are ignored.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t.as_py(), buckets) for t in b.column(1)]
            weights = [float(ratios.value[g].sum()) for g in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, found), pa.int64()), pa.array(weights, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keyed = stored(rows.mapInArrow(weigh, "doc_id long, n_grams long, log_weight double").withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    last = kth_largest(keyed, "sample_key", round(keep * keyed.count()))
    return keyed.withColumn("selected", F.col("sample_key") >= F.lit(last) if last is not None else F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
