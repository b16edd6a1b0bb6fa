"""Vector search by blocks gives what scoring pair by pair gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat.operators import clustering, vectors


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 700)] + rng.normal(0, 0.4, (700, 16))
    x[100:160] = x[99]  # ties
    x[200] = 0
    x[201] *= 1e-160
    x[202] *= 1e7
    rows = [(i, i % 23, [float(c) for c in r]) for i, r in enumerate(x)]
    rows[203] = (203, 1, [float("nan")] + rows[203][2][1:])
    rows[204] = (204, 2, [None] + rows[204][2][1:])
    rows += [(700, 3, [1.0, 2.0]), (701, 4, [2.0, 1.0]), (702, 5, None)]
    v = spark.createDataFrame(rows, "file_id long, person_id long, embedding array<double>").repartition(3)
    return v.where("file_id % 3 = 0 or file_id > 699").select(F.col("file_id").alias("id"), "embedding"), v


def plain(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)


def both_ways(monkeypatch, make):
    got = []
    for few, block in ((1 << 30, 32 << 20), (0, 32 << 20), (0, 20_000)):
        monkeypatch.setattr(vectors, "FEW_PAIRS", few)
        got.append(plain(make(block).collect()))
    assert len(got[0]) > 100 and got[1] == got[0] and got[2] == got[0]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize(("k", "least"), [(5, 0.0), (80, 0.3)])
def test_top(spark, tables, monkeypatch, metric, k, least):
    q, v = tables
    scored = vectors._scored
    for name in (False, True):
        w = v.withColumn("file_id", F.concat(F.lit("f"), F.col("file_id").cast("string"))) if name else v

        def make(block, w=w):
            monkeypatch.setattr(vectors, "_scored", lambda *a: scored(*a, block))
            return vectors.search_similar(q, w, k, least, metric=metric)

        both_ways(monkeypatch, make)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_tiles(tables, monkeypatch, metric):
    v = tables[1].where("file_id < 700 and file_id not in (200, 203, 204)")
    held = v.select("file_id", "embedding").toArrow()
    rows = vectors._read(held.column(0), held.column(1))[16]
    got = []
    for tile in (4096, 37):
        monkeypatch.setattr(vectors, "TILE_ROWS", tile)
        found = [vectors._best(iter([(16, rows, rows)]), metric, 7, 0.1), vectors._reaching(iter([(16, rows, rows)]), metric, 0.5)]
        got.append([sorted((a, b, c) for x in f for a, b, c in zip(*(y.tolist() for y in x), strict=True)) for f in found])
        best = {}
        for a, b, c in (t for x in vectors._best_of_owner(iter([(16, rows, rows._replace(ids=rows.ids % 23))]), 0.5) for t in zip(*(y.tolist() for y in x), strict=True)):
            best[a, b] = max(c, best.get((a, b), -1))
        got[-1].append(best)
    assert got[0] == got[1] and min(map(len, got[0])) > 1000


def test_few_queries_and_few_vectors(spark, tables, monkeypatch):
    q, v = tables
    both_ways(monkeypatch, lambda _: vectors.search_similar(q.where("id < 60"), v, 20))
    both_ways(monkeypatch, lambda _: vectors.search_similar(q, v.where("file_id < 60"), 20))


def test_threshold_and_persons(spark, tables, monkeypatch):
    q, v = tables
    both_ways(monkeypatch, lambda _: vectors.find_similar(q, v, 0.5))
    for best in (True, False):
        both_ways(monkeypatch, lambda block: vectors.match_persons(q, v.select("person_id", "embedding"), 0.5, best, block_bytes=block))


def test_halves_round_as_the_column_does(spark):
    x = [0.1234565, 0.1234575, 0.0000005, -0.0000005, 0.9999995, 0.25, 2.5e-7, -0.1234565, 0.12345649999999999]
    want = [r[0] for r in spark.createDataFrame([(c,) for c in x], "x double").select(F.round("x", 6)).collect()]
    assert vectors._rounded(np.array(x)).tolist() == want


def test_many_pairs_are_not_joined(spark, tables):
    q, v = tables
    for df in (vectors.search_similar(q, v, 5), vectors.find_similar(q, v, 0.5), vectors.match_persons(q, v.select("person_id", "embedding"), 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" in plan and "Join" not in plan


def test_clusters_get_persons_by_blocks(spark, tables, monkeypatch):
    _, v = tables
    faces = v.select(F.col("file_id").alias("id"), (F.col("file_id") % 200).alias("cluster"), "embedding")
    both_ways(monkeypatch, lambda _: clustering.assign_clusters(faces, v.where("file_id % 7 = 0").select("person_id", "embedding"), 0.97))
