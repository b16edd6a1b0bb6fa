"""Density clustering of vectors, and clusters to persons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.vectors import doubles
from mediacat.operators.vectors import person_hits
from mediacat.storage import components, row_numbers, stored

BLOCK_ROWS, LEAST_ROWS = 2048, 256
#: Blocks are dealt in groups: so many, so that a row is copied for at most one more, unless they would pass so many rows.
GROUPS, GROUP_ROWS = 16, 131072
#: Rows of a block that are held against another at a time.
SLAB = 512


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: each row's smallest row reached."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def standardize(df: DataFrame, id: str = "id") -> DataFrame:
    """(id, v): (x - mean) / population deviation of each dimension; a constant one is only centred."""
    long = df.select(id, F.posexplode(doubles(F.col("embedding"))).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).orderBy("dim").collect()  # a row for each dimension
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
    scaled = F.zip_with(F.zip_with(doubles(F.col("embedding")), lits([r.mean for r in stats]), lambda x, m: x - m), lits([r.dev if r.dev else 1.0 for r in stats]), lambda x, s: x / s)
    return df.select(F.col(id).alias("id"), scaled.alias("v"))


def _blocks(points: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """points (id, v) with block, ranges of about `rows` rows of the axis of largest spread; and that axis."""
    spread = points.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg((F.max("x") - F.min("x")).alias("s")).orderBy(F.desc("s"), "dim").first()
    placed = points.withColumn("__x", F.get("v", F.lit(spread.dim)))
    return row_numbers(placed, ["__x", "id"], "__n").select("id", "v", F.floor((F.col("__n") - 1) / rows).alias("block")), spread.dim


def _tile_pairs(blocks: DataFrame, axis: int, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks whose boxes come within eps of each other. blocks: (id, v, block), ranges of the axis.

    Blocks meet in cells of the axis, of which there are about as many as blocks: a block lies in those that it reaches, and looks eps further.
    """
    box = blocks.select("block", F.posexplode("v").alias("dim", "x")).groupBy("block", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    corner = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("dim", c))), lambda s: s[c]).alias(c)
    box = stored(box.groupBy("block").agg(corner("lo"), corner("hi")), "boxes")  # a row for each block
    low, high = F.get("lo", F.lit(axis)), F.get("hi", F.lit(axis))
    n, least, most = box.agg(F.count("*"), F.min(low), F.max(high)).first()
    width = max(eps, (most - least) / n) or 1.0
    cell = lambda x: F.floor((x - least) / width).cast("long")
    one = box.select(F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell(low), cell(high + eps * (1 + 1e-9)))).alias("cell"))
    two = box.select(F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    apart = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps * (1 + 1e-9)
    return one.join(two, "cell").where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of x and y are within eps: by products, and term by term where that is too close to tell."""
    limit = eps * eps
    norms = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d = norms - 2 * x @ y.T
    near = d <= limit
    i, j = np.nonzero(np.abs(d - limit) <= 1e-9 * (norms + limit))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        near[i[part], j[part]] = np.add.accumulate((x[i[part]] - y[j[part]]) ** 2, axis=1)[:, -1] <= limit  # summed in order
    return near


def _dealt(blocks: DataFrame, pairs: DataFrame, group: int) -> DataFrame:
    """blocks with (a, b), a <= b: the pairs of groups of `group` neighbouring blocks in which a block meets another. A row comes once for each."""
    of = lambda c: F.floor(F.col(c) / group).cast("long").alias(c)
    ends = pairs.select(of("a"), of("b"), F.explode(F.array("a", "b")).alias("block")).distinct()
    return blocks.join(ends, "block")  # the pairs may be many: no broadcast


def _tiles(key: tuple, v: np.ndarray, block: np.ndarray, group: int, eps: float) -> Iterator[tuple[slice, slice, bool]]:
    """(rows, rows, same block) of the blocks, sorted, that meet in a pair of groups and whose boxes come within eps of each other."""
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends, low, high = [*starts[1:], len(block)], np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    for i, a in enumerate(starts):
        for j in range(i, len(starts)):
            if key[0] != key[1] and block[a] // group == block[starts[j]] // group:
                continue
            apart = np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0)
            if (apart * apart).sum() <= eps * eps * (1 + 1e-9):
                for at in range(a, ends[i], SLAB):
                    yield slice(at, min(at + SLAB, ends[i])), slice(starts[j], ends[j]), i == j


def _each_group(blocks: DataFrame, pairs: DataFrame, group: int, eps: float, work, schema: str) -> DataFrame:
    """work(ids, v, core, tiles) on the rows of every pair of groups."""
    n = pairs.select(F.max("b")).first()[0] // group + 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        v = np.array(pdf["v"].tolist(), float)
        return pd.DataFrame(work(pdf["id"].to_numpy(), v, pdf["core"].to_numpy(bool), _tiles(key, v, pdf["block"].to_numpy(), group, eps)))

    rows = _dealt(blocks, pairs, group).repartition(min(n * (n + 1) // 2, 2000), "a", "b")
    return rows.groupBy("a", "b").applyInPandas(run, schema)


def cluster_vectors(df: DataFrame, eps: float = 0.5, min_samples: int = 2, id: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster): density clusters of standardised vectors, numbered by their first core row; noise gets -1, -2, ... in order of id.

    df (id, embedding). Rows whose vector is null or holds a null or NaN have no cluster (null), and count nowhere. Distances up to eps count, a point counts itself. A border point joins the lowest-numbered cluster next to it. One vector alone is cluster 0.
    Blocks of points are compared pair by pair, unless their boxes lie apart; each pair of groups of blocks gives counts, then a forest of links between
    its core points and, for its other points, the trees they touch: never all pairs of points. A row is copied for as many pairs as there are groups,
    16 up to two million rows, so what is shuffled grows with the rows; the comparisons grow with their square.
    """
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    odd = df.where(~fine | fine.isNull()).select(F.col(id).alias("id"), F.lit(None).cast("long").alias("cluster"))
    points = stored(standardize(df.where(fine), id), "points")
    total = points.count()
    if total < 2:
        return points.select("id", F.lit(0).cast("long").alias("cluster")).unionByName(odd)
    kind = points.schema["id"].dataType.simpleString()
    block_rows = min(block_rows, max(LEAST_ROWS, math.ceil(total / GROUPS)))
    group = max(1, min(math.ceil(math.ceil(total / block_rows) / GROUPS), GROUP_ROWS // block_rows))
    placed, axis = _blocks(points, block_rows)
    blocks = stored(placed.withColumn("core", F.lit(False)), "blocks")
    pairs = stored(_tile_pairs(blocks, axis, eps), "tiles")

    def counts(ids, v, _, tiles):
        n = np.zeros(len(ids), np.int64)
        for x, y, same in tiles:
            near = _near(v[x], v[y], eps)
            n[x] += np.count_nonzero(near, axis=1)
            if not same:
                n[y] += np.count_nonzero(near, axis=0)
        return {"id": ids, "n": n}

    n = _each_group(blocks, pairs, group, eps, counts, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    blocks = stored(blocks.drop("core").join(n, "id").select("id", "v", "block", "n", (F.col("n") >= min_samples).alias("core")), "blocks")

    def links(ids, v, core, tiles):
        label, touched = np.arange(len(ids)), [np.empty(0, np.int64)]
        for x, y, _ in tiles:
            first = label[x.start]
            if core[x].all() and core[y].all() and (label[x] == first).all() and (label[y] == first).all():
                continue
            a, b = np.nonzero(_near(v[x], v[y], eps))
            a, b = a + x.start, b + y.start
            inner = core[a] & core[b]
            label = merged(label, a[inner], b[inner])
            # A point that is not core touches trees: each once.
            out, to = np.concatenate([a, b]), np.concatenate([b, a])
            rim = ~core[out] & core[to]
            touched.append(np.unique(out[rim] * len(ids) + label[to[rim]]))
        moved = np.flatnonzero(core & (label != np.arange(len(ids))))
        out, to = np.divmod(np.concatenate(touched), len(ids))
        out, to = np.divmod(np.unique(out * len(ids) + label[to]), len(ids))
        return {"a": ids[np.concatenate([moved, out])], "b": ids[np.concatenate([label[moved], to])], "inner": np.arange(len(moved) + len(out)) < len(moved)}

    linked = blocks.where("n > 1").drop("n")  # others have no neighbour
    found = stored(_each_group(linked, pairs, group, eps, links, f"a {kind}, b {kind}, inner boolean"), "tile-links")
    core = blocks.where("core").select("id")
    roots = stored(core.join(components(found.where("inner").select("a", "b")).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
    numbers = row_numbers(roots.select("root").distinct(), ["root"], "n").select("root", (F.col("n").cast("long") - 1).alias("cluster"))
    labelled = stored(roots.join(numbers, "root").select("id", "cluster"), "labelled")
    border = found.where("not inner").join(labelled.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    all_ = stored(points.select("id").join(labelled, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near").alias("cluster")), "clusters")
    noise = row_numbers(all_.where("cluster is null").select("id"), ["id"], "n").select("id", (-F.col("n")).cast("long").alias("cluster"))
    return all_.where("cluster is not null").unionByName(noise).unionByName(odd)


def person_rollup(faces: DataFrame, files: DataFrame) -> DataFrame:
    """For each person: photos, faces, first and last seen."""
    rows = faces.where("person_id is not null").join(files.select(F.col("id").alias("file_id"), "ingested_at"), "file_id")
    return rows.groupBy("person_id").agg(F.countDistinct("file_id").alias("photo_count"), F.count("*").alias("face_count"), F.min("ingested_at").alias("first_seen"), F.max("ingested_at").alias("last_seen"))


def centroids(df: DataFrame, key: str) -> DataFrame:
    """(key, embedding): mean vector of each key."""
    long = df.select(key, F.posexplode(doubles(F.col("embedding"))).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))


def assign_clusters(faces: DataFrame, gallery: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(cluster, person_id, is_new): the first person with any face at the threshold, else a new person after the highest id, in cluster order.

    faces (id, cluster, embedding); gallery (person_id, embedding).
    """
    hits = person_hits(faces.select("id", "embedding"), gallery, threshold)
    first = faces.select("id", "cluster").join(hits, F.col("id") == F.col("face_id")).groupBy("cluster").agg(F.min("person_id").alias("person_id"))
    rows = faces.select("cluster").distinct().join(first, "cluster", "left")
    top = gallery.agg(F.max("person_id")).first()[0] or 0
    new = row_numbers(rows.where("person_id is null").select("cluster"), ["cluster"], "n").select("cluster", (F.col("n") + top).cast("long").alias("person_id"), F.lit(True).alias("is_new"))
    return rows.where("person_id is not null").select("cluster", F.col("person_id").cast("long"), F.lit(False).alias("is_new")).unionByName(new)
