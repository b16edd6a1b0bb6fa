"""Exact top-k search by inner product over a vector-approximation file.

Every vector is also kept as one small cell number per dimension. A scan of the cells alone bounds each candidate's score
from both sides: the kth best lower bound is a floor, and only candidates whose upper bound reaches it are read
exactly, the best bounds first; their kth score then cuts the rest. Equal vectors are searched once. Queries come in
blocks of bounded size, each broadcast to a scan of all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table
from mediacat.llm.hard_negatives import Best, by_dim
from mediacat.llm.whole import NAMELESS, best_first, exact_products, is_narrow, taking_part

SCALE = 256
K = 5
EVERY = 50
CELLS = 64
SAMPLE = 10_000
QUERY_BLOCK = 4096
FIRST_READ = 4
SALTS = 16
PART = 1000
WIDE_FOUND = "anchor int, slot int, vec_id long, beyond int, key binary, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, a whole number of any size; rows that take no part are dropped.

    Those are vectors null or holding null or non-finite components (also after scaling).
    """
    return taking_part(vectors, scale).withColumn("vec_id", F.nullif("vec_id", F.lit(NAMELESS)))


def edges_of(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The cells' lowest and highest values: quantiles of the components of a bounded sample, and the extremes of all components."""
    lowest, highest, n = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.count("*")).first()
    if lowest is None:
        return np.zeros(1), np.zeros(1)
    shares = [0.0001, 0.001, *(i / (CELLS - 4) for i in range(1, CELLS - 4)), 0.999, 0.9999]
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / n)))).select(F.explode("v").alias("c"))
    inner = some.agg(F.percentile_approx("c", shares, 10_000)).first()[0] or []
    lows = sorted({lowest, *(e for e in inner if lowest < e <= highest)})
    return np.array(lows), np.array([*(e - 1 for e in lows[1:]), highest])


def corners(batch: pa.RecordBatch, edges: tuple[np.ndarray, np.ndarray], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cids, lower, upper corners) of the rows of this dimension, in small parts."""
    dims = batch.column(1).to_numpy(zero_copy_only=False)
    here = np.flatnonzero(dims == dim)
    cids = batch.column(0).to_numpy(zero_copy_only=False)
    for at in range(0, len(here), PART):
        part = here[at : at + PART]
        cells = np.frombuffer(b"".join(batch.column(2).take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), dim)
        yield cids[part], edges[0][cells], edges[1][cells]


def _wide(classes: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best classes of each task for each query, of those pairs of which either has components too large for doubles: whole numbers of any size."""
    shared = classes.sparkSession.sparkContext.broadcast([(np.array(r.v, np.float64), r.narrow) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, (len(shared.value), 1))
        for b in batches:
            cids, narrow = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for rows, x in by_dim(b, 1):
                for n, (v, small) in enumerate(shared.value):
                    some = ~narrow[rows] if small else np.ones(len(rows), bool)
                    if len(v) == x.shape[1] and some.any():
                        scores = exact_products(v[None], x[some])[0]
                        best.add(np.full(len(scores), n), cids[rows[some]], scores)
        yield from best.rows()

    return classes.select("cid", "v", "narrow").mapInArrow(run, WIDE_FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by inner product, ties to the smaller vec_id; fewer if there are fewer.

    Both: (vec_id, v array<double> of whole numbers); queries are rows of vectors, and a query's own row is no candidate of it (rows repeated under
    one vec_id are candidates of each other). Vectors of another dimension than the query's are no candidates. Candidates without a
    vec_id come after all others of their score. Scores beyond a long are given as the nearest long, but ranked by their full value: vectors with
    components that could make a product inexact in doubles are not filed in cells but scored in whole numbers of any size.
    """
    spark = vectors.sparkSession
    vectors = vectors.withColumn("vec_id", F.coalesce("vec_id", F.lit(NAMELESS)))
    # Equal vectors are one class; of its rows only the k + 1 smallest ids can be in a result.
    order = Window.partitionBy("v").orderBy("vec_id")
    least = vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.select(F.get("ids", F.lit(0)).alias("cid"), F.size("v").alias("dim"), "v", "ids", is_narrow(F.col("v")).alias("narrow")), "va-exact")
    edges = edges_of(vectors.where(is_narrow(F.col("v"))))
    any_wide = not classes.where("not narrow").isEmpty()
    # A component's cell: how many lowest values but the first are at or below it.
    cell = F.transform("v", lambda c: F.aggregate(F.array(*map(F.lit, edges[0][1:].tolist())).cast("array<double>"), F.lit(0), lambda n, e: n + (e <= c).cast("int")))
    file = stored(classes.where("narrow").select("cid", "dim", F.unhex(F.array_join(F.transform(cell, lambda n: F.lpad(F.hex(n), 2, "0")), "")).alias("cells")), "va-cells")

    asked = stored(queries.groupBy("v").agg(F.min("vec_id").alias("qkey")).select("qkey", "v", is_narrow(F.col("v")).alias("narrow")), "va-queries")
    blocks = max(1, -(-asked.count() // query_block))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks))), "va-blocks")
    results = []
    for block in range(blocks):
        own = asked.where(F.col("block") == block).drop("block") if blocks > 1 else asked
        q = own.collect()  # one block
        dims = {}
        for r in q:
            if r.narrow:
                dims.setdefault(len(r.v), []).append(r)
        packed = {d: (np.array([r.qkey for r in rs], np.int64), np.array([r.v for r in rs], np.float64)) for d, rs in dims.items()}
        shared = spark.sparkContext.broadcast(packed)

        def floors(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: np.full((len(keys), k + 1), -np.inf) for d, (keys, _) in shared.value.items()}
            for b in batches:
                for d, (_, v) in shared.value.items():
                    for _, low, high in corners(b, edges, d):
                        lower = np.maximum(v, 0) @ low.T + np.minimum(v, 0) @ high.T
                        both = np.concatenate([best[d], lower], axis=1)
                        best[d] = -np.partition(-both, k, axis=1)[:, : k + 1]
            for d, (keys, _) in shared.value.items():
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best[d].tolist(), pa.list_(pa.float64()))], ["qkey", "low"])

        lows = file.mapInArrow(floors, "qkey long, low array<double>").select("qkey", F.explode("low").alias("low"))
        nth = lows.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("low")))).where(F.col("r") == k + 1)
        known = {r.qkey: r.low for r in nth.collect()}  # one block
        floor = spark.sparkContext.broadcast({d: np.array([known.get(x, -np.inf) for x in keys.tolist()]) for d, (keys, _) in packed.items()})

        def reached(batches: Iterator[pa.RecordBatch], shared=shared, floor=floor) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, (keys, v) in shared.value.items():
                    for cids, low, high in corners(b, edges, d):
                        upper = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
                        i, j = np.nonzero(upper >= floor.value[d][:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(cids[j]), pa.array(upper[i, j])], ["qkey", "cid", "upper"])

        found = stored(file.mapInArrow(reached, "qkey long, cid long, upper double"), "va-found")

        def exact(pairs: DataFrame, own=own) -> DataFrame:
            both = pairs.join(classes, "cid").join(F.broadcast(own.select("qkey", F.col("v").alias("q"))), "qkey")  # one block
            score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).cast("long")
            return both.select("qkey", "ids", score.alias("score"))

        # The best bounds first; then only what can still reach the kth score among them. Nothing ranks all that was reached.
        by_bound = Window.partitionBy("qkey").orderBy(F.desc("upper"), "cid")
        head = stored(found.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= FIRST_READ * (k + 1)).drop("r"), "va-head")
        last = head.groupBy("qkey").agg(F.max(F.struct((-F.col("upper")).alias("u"), "cid")).alias("last"))
        first = stored(exact(head.drop("upper")), "va-first")
        certain = first.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score")))).where(F.col("n") == k + 1).select("qkey", F.col("score").cast("double").alias("kth"))
        limits = F.broadcast(last.join(certain, "qkey"))  # a row for each query of the block
        rest = found.join(limits, "qkey").where((F.col("upper") >= F.col("kth")) & (F.struct((-F.col("upper")).alias("u"), "cid") > F.col("last")))
        none = {"beyond": F.lit(0), "key": F.lit(None).cast("binary")}
        results.append(first.unionByName(exact(rest.select("qkey", "cid"))).withColumns(none))
        if any_wide or len(q) > sum(map(len, dims.values())):
            keys = spark.createDataFrame([(n, r.qkey) for n, r in enumerate(q)], "anchor int, qkey long")  # one block
            wide = stored(_wide(classes, q, k + 1), "va-wide").join(F.broadcast(keys), "anchor").withColumnRenamed("vec_id", "cid")
            results.append(wide.join(classes.select("cid", "ids"), "cid").select("qkey", "ids", "score", "beyond", "key"))
    scored = results[0]
    for other in results[1:]:
        scored = scored.unionByName(other)
    rows = scored.select("qkey", "score", "beyond", "key", F.explode("ids").alias("vec_id"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(*best_first()))).where(F.col("r") <= k + 1)
    top = top.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    # Back to the query rows; many may share a vector, so they are salted.
    lists = top.join(asked.select("qkey", "v"), "qkey").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = queries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(lists, ["v", "salt"])
    mine = F.array_position(F.transform("top", lambda t: t["vec_id"]), F.col("vec_id"))
    others = F.slice(F.filter("top", lambda t, i: i + 1 != F.coalesce(mine, F.lit(0))), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.nullif(F.col("t.vec_id"), F.lit(NAMELESS)).alias("vec_id"), F.col("t.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantised(table(spark, sf_dir, "embeddings")), "va-rows")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(EVERY)) == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
