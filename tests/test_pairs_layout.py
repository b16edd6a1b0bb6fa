"""Pairs of equal content are laid out so that what is written of them stays small, and none is lost by it."""

import itertools
import os

import pytest

from mediacat.operators import catalog

SCHEMA = "id long, file_path string, file_hash string"


def brute(a, b):
    return sorted(((x[0], y[0]) for x, y in itertools.product(a, b) if x[2] is not None and x[2] == y[2] and None not in (x[1], y[1]) and x[1] != y[1]), key=repr)


def test_written_pairs_are_small(spark, tmp_path):
    df = spark.createDataFrame([((i * 7919) % 100_003, f"/lib/d{i % 7}/IMG_{i}.JPG", "a") for i in range(3000)], SCHEMA)
    catalog.exact_matches(df, df).write.parquet(f"{tmp_path}/pairs")
    files = [os.path.join(tmp_path, "pairs", f) for f in os.listdir(tmp_path / "pairs") if f.endswith(".parquet")]
    assert spark.read.parquet(*files).count() == 3000 * 2999
    assert sum(map(os.path.getsize, files)) < 0.6 * 3000 * 2999  # bytes


@pytest.mark.parametrize("piece", [5, 16, 1000])
def test_blocks_and_pieces_lose_nothing(spark, monkeypatch, piece):
    for name, value in (("PAIRS_A_SHARE", 40), ("PAIRS_A_TASK", 50), ("BLOCK", 8), ("PIECE", piece)):
        monkeypatch.setattr(catalog, name, value)
    a = [(i, f"/p{i % 30}", "a" if i < 70 else "b" if i < 72 else "left" if i < 90 else f"h{i}") for i in range(100)] + [(None, "/p1", "a"), (7, None, "a"), (8, "/p8", None), (8, "/p8", "a"), (8, "/p8", "a")]
    b = [(i, f"/p{i % 11}", "a" if i < 40 else "b" if i < 75 else "right") for i in range(100)] + [(3, "/p3", "a")] * 9 + [(None, None, "a"), (None, "/q", "b"), (1, "/q", None)]
    pairs = catalog.exact_matches(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    assert sorted(map(tuple, pairs.collect()), key=repr) == brute(a, b)
    none = spark.createDataFrame([], SCHEMA)
    assert catalog.exact_matches(none, none).count() == catalog.exact_matches(spark.createDataFrame(a, SCHEMA), none).count() == 0


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_A_TASK", 1000)
    df = spark.createDataFrame([(i, f"/p{i}", f"h{i % 3}") for i in range(300)], SCHEMA)
    assert catalog.exact_matches(df, df).rdd.getNumPartitions() == 30  # 30,000 pairs
