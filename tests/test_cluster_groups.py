"""Density clusters: blocks are dealt in groups, so that copies of rows don't grow with the blocks."""

import numpy as np
from pyspark.sql import functions as F

from mediacat.operators import clustering


def plain(x, eps, least):
    """Cluster of each row by brute force."""
    z = (x - x.mean(0)) / x.std(0)
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) <= eps
    core, label = near.sum(1) >= least, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, k = [i], label.max() + 1
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
    out, noise = label.copy(), 0
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        noise -= not len(around)
        out[i] = around.min() if len(around) else noise
    return dict(enumerate(out.tolist()))


def test_groups_of_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clustering, "GROUPS", 4)
    monkeypatch.setattr(clustering, "SLAB", 7)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in (0, 3, 6, 9)] + [rng.uniform(-3, 12, (80, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id long, embedding array<double>")
    # Blocks that lie apart and groups of five blocks; one group of all; large eps, where all blocks meet.
    for eps, least, rows in ((0.1, 4, 16), (0.1, 4, 500), (1.0, 60, 16), (0.05, 1, 30)):
        got = {r.id: r.cluster for r in clustering.cluster_vectors(df, eps, least, block_rows=rows).collect()}
        assert got == plain(x, eps, least), (eps, least, rows)


def test_copies_of_a_row_are_bounded_by_the_groups(spark):
    """64 blocks that all meet: 65 copies of a row when pairs of blocks are dealt one by one."""
    blocks = spark.range(640).select("id", F.floor(F.col("id") / 10).alias("block"))
    b = blocks.select("block").distinct()
    pairs = b.select(F.col("block").alias("a")).join(b.select(F.col("block").alias("b")), F.col("a") <= F.col("b"))
    dealt = clustering._dealt(blocks, pairs, 4)
    assert dealt.count() == 640 * 16 and dealt.distinct().count() == 640 * 16
