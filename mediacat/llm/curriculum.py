"""Mixing sources to target weights, as a curriculum over training time.

Each source gets a target in words. Its documents are laid end to end in a fixed random order, over as many passes as
the target asks for; the source's weight schedule over training time t in [0, 1] integrates to its cumulative demand,
and the inverse of that gives each document's position. Sums run over buckets of the order, so no source is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: The schedule of a source's weight over t is 1 + slope * (1 - 2t); sources take these in turn.
SLOPES = (0.5, 0.0, -0.5)
SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sizes (source, source_size), one row per source -> with place (from 0, by code point, null last) and target.

    Weights share the sum of all sizes; a target stops at `most` times its source's size, and the excess goes to the
    others by weight: min(cap, level * weight), for the level at which the targets sum to the whole.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_rows) - F.sum("cap").over(by_ratio) + F.col("cap"))
    s = s.withColumn("heavy", F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight"))
    s = s.withColumn("level", F.min(F.when(F.col("left") / F.col("heavy") <= F.col("ratio"), F.struct("ratio", "place", (F.col("left") / F.col("heavy")).alias("level")))).over(all_rows)["level"])
    return s.select("source", "source_size", "place", F.round(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), 6).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The time t at which the schedule has asked for this share of the target: t + slope * (t - t*t) = share."""
    return 2 * share / ((1 + slope) + F.sqrt((1 + slope) * (1 + slope) - 4 * slope * share))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES, slopes: tuple = SLOPES, buckets: int = 3) -> DataFrame:
    """docs with a column __mix: struct(size, source_size, target, taken, passes, part, position).

    passes: how often the mix takes the whole document; part: words of it taken in the last, partial pass (at most one
    document of a source is taken in part). position: that of its first pass, null if nothing is taken. A null text has
    size 0; a null source is a source; rows that share a doc_id, or have none, are each mixed, and only those of one doc_id and
    text stand next to each other. buckets: hex digits of the order that make a bucket. The columns of docs may have any names but __mix.
    """
    own_names = _names(docs)
    source, size, key, bucket, name, goal_, before_ = map(own_names, ("source", "size", "key", "bucket", "name", "p", "own"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    # Never null, so that the join and the window deal the rows out alike, once.
    full = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("null"))
    rows = docs.withColumn(source, F.col("source").cast("string")).withColumn(size, n_words(F.col("text"))).withColumn(key, order)
    rows = rows.withColumn(bucket, F.substring(key, 1, buckets)).withColumn(name, full(source))
    sums = stored(rows.groupBy(F.col(source).alias("of"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words")), "mix-sums")  # at most a row for each source and bucket
    goal = targets(sums.groupBy(F.col("of").alias("source")).agg(F.sum("words").alias("source_size")), weights, most)
    before = F.sum("words").over(Window.partitionBy("of").orderBy("bucket")) - F.col("words")
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("place") % len(slopes) + 1).cast("int"))
    plan = sums.withColumn("before", before).join(goal, F.col("of").eqNullSafe(F.col("source")))
    plan = plan.select(full("of").alias(name), F.col("bucket").alias(bucket), F.struct("before", "source_size", "target", slope.alias("slope")).alias(goal_))
    own = F.sum(size).over(Window.partitionBy(name, bucket).orderBy(key, "doc_id", size).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(plan, [name, bucket]).withColumn(before_, own - F.col(size))
    of = lambda c: F.col(f"{goal_}.{c}")
    at = of("before") + F.col(before_)
    whole = F.floor(of("target"))
    passes = F.when(of("source_size") > 0, F.floor(whole / of("source_size"))).otherwise(0).cast("long")
    part = F.least(F.col(size), F.greatest(F.lit(0), whole - passes * of("source_size") - at)).cast("long")
    taken = passes * F.col(size) + part
    when = F.when(taken > 0, F.round(position(at / of("target"), of("slope")), 9))
    out = F.struct(F.col(size).alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), taken.alias("taken"), passes.alias("passes"), part.alias("part"), when.alias("position"), at.alias("at"), of("slope").alias("slope"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], out.alias("__mix"))


def _names(docs: DataFrame) -> Callable[[str], str]:
    """Names for columns of our own that docs doesn't have."""
    front = "__"
    while any(c.lower().startswith(front) for c in docs.columns):
        front += "_"
    return lambda n: front + n


def mixed_copies(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix itself, in training order: each pass over a document is a row at its own position; columns as in docs.

    A document taken in part in the last pass comes with its first words only, joined by spaces; or as it is if `whole`,
    and then a source may pass its target by less than that document.
    """
    own_names = _names(docs)
    nth, at = own_names("pass"), own_names("at")
    m = mix(docs, **options)
    copies = F.sequence(F.lit(0).cast("long"), F.col("__mix.passes") - F.when(F.col("__mix.part") > 0, 0).otherwise(1))
    m = m.where("__mix.taken > 0").withColumn(nth, F.explode(copies))
    m = m.withColumn(at, position((F.col(nth) * F.col("__mix.source_size") + F.col("__mix.at")) / F.col("__mix.target"), F.col("__mix.slope")))
    cut = (F.col(nth) == F.col("__mix.passes")) & (F.col("__mix.part") < F.col("__mix.size")) & F.lit(not whole)
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("__mix.part").cast("int")), " ")).otherwise(F.col("text"))
    return m.withColumn("text", text).orderBy(at, "doc_id", F.xxhash64("text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mix(docs).select("doc_id", F.col("__mix.size").alias("size"), F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), F.col("__mix.taken").alias("taken"), F.col("__mix.position").alias("position"))
    return rows.orderBy("position", "doc_id")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap, source_size * 3 / CAST(place % 3 + 1 AS DOUBLE) AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - sum(cap) OVER (ORDER BY ratio, place) + cap)
          / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, place) + weight) AS lev FROM w
), t AS (
  SELECT *, round(least(CAST(cap AS DOUBLE), weight * (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, place LIMIT 1)), 6) AS target,
         CASE place % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE -0.5 END AS slope FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS at_word,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CAST(passes * size + least(size, greatest(0, floor(target) - passes * source_size - at_word)) AS BIGINT) AS taken FROM o
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * (at_word / target) / ((1 + slope) + sqrt((1 + slope) * (1 + slope) - 4 * slope * (at_word / target))), 9) END AS position
FROM p
"""
