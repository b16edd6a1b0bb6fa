"""Hard negatives: for an anchor and each of its best rows of the same label, the best rows of other labels whose scores lie in a window under it.

A score is an inner product. With one more component, which gives every row the same length, the score of a row is a matter of
its distance from the anchor: a window of scores is an annulus. A tree cuts the space: a node has several split points, and
a row goes to the nearest. For each split point the node keeps the range of its distances to the rows of each sibling; a sibling whose range
misses what the annulus allows is left out, and so on down to the leaves, whose rows are scored exactly. The tree is fitted on a
bounded sample of the rows, all rows are filed in it, and ranges come from all rows. Anchors come in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.llm.common import partitions, stored, table
from mediacat.llm.whole import NAMELESS, best_first, exact_products, from_key, is_narrow, sort_key, taking_part

SCALE = 256
EVERY, MOVED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share of the positive's, in hundredths, and at most all of it.
LEAST_SHARE = 80
#: Rows that the tree is fitted on; split points of a node; rows of the sample under which a node is a leaf; levels of nodes.
SAMPLE, SPLITS, LEAF, DEPTH = 4096, 12, 64, 3
ANCHOR_BLOCK = 1024
#: Rows scored at once, and candidates held before all but the best go.
PART, HELD = 1024, 1 << 20
#: The leaf of rows with components too large to be scored in doubles; such rows are scored in whole numbers of any size.
WIDE = -1
FOUND = "anchor int, slot int, vec_id long, beyond int, key binary, score long"


@dataclass
class Node:
    points: np.ndarray  # split points, with the added component
    children: list  # a Node, or the number of a leaf
    low: np.ndarray = field(default=None)  # of each split point to each sibling's rows
    high: np.ndarray = field(default=None)


def lengthened(v: np.ndarray, most: float) -> np.ndarray:
    """v with the component that gives every row the squared length most."""
    return np.concatenate([v, np.sqrt(np.maximum(0, most - (v * v).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def fitted(sample: np.ndarray, counter: list[int], depth: int = DEPTH) -> Node | int:
    """A tree of split points that lie far apart among the sample's (lengthened) rows, or a leaf's number."""
    points = np.unique(sample, axis=0)
    if depth == 0 or len(sample) <= LEAF or len(points) < 2:
        counter[0] += 1
        return counter[0] - 1
    some = points[:: max(1, len(points) // (3 * SPLITS))][: 3 * SPLITS]
    chosen, apart = [0], distances(some, some[:1])[:, 0]
    while len(chosen) < min(SPLITS, len(some)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, distances(some, some[chosen[-1:]])[:, 0])
    own = some[chosen]
    near = distances(sample, own).argmin(axis=1)
    return Node(own, [fitted(sample[near == j], counter, depth - 1) for j in range(len(own))])


def walk(node: Node | int, rows: np.ndarray, at: np.ndarray | None = None) -> Iterator[tuple[Node | int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows that come to it, their distances to its split points, their child); a leaf comes with its rows alone."""
    at = np.arange(len(rows)) if at is None else at
    if not isinstance(node, Node):
        yield node, at, None, None
        return
    d = distances(rows[at], node.points)
    near = d.argmin(axis=1)
    yield node, at, d, near
    for j, child in enumerate(node.children):
        if (near == j).any():
            yield from walk(child, rows, at[near == j])


def nodes(node: Node | int) -> list[Node]:
    return [] if not isinstance(node, Node) else [node, *(n for c in node.children for n in nodes(c))]


def reached(node: Node | int, from_: np.ndarray, to: np.ndarray, d: dict[int, np.ndarray], slack: float, out: np.ndarray, alive: np.ndarray) -> None:
    """Mark in out (anchors x leaves) what can hold a row whose distance to the anchor is between from_ and to. d: by node, anchors' distances to its points."""
    if not alive.any():
        return
    if not isinstance(node, Node):
        out[:, node] |= alive
        return
    own = d[id(node)]
    most, least = own + to[:, None] + slack, np.maximum(own - to[:, None], from_[:, None] - own) - slack
    for j, child in enumerate(node.children):
        meets = ((node.low[None, :, j] <= most) & (node.high[None, :, j] >= least)).all(axis=1)
        reached(child, from_, to, d, slack, out, alive & meets)


@dataclass
class Tree:
    """For each number of components: the root, how many leaves, and the squared length of the lengthened rows."""

    roots: dict[int, tuple[Node | int, int]]
    most: dict[int, float]

    def leaves(self, v: np.ndarray) -> np.ndarray:
        out, dim = np.zeros(len(v), np.int64), v.shape[1]
        if dim in self.roots:
            for node, at, _, near in walk(self.roots[dim][0], lengthened(v, self.most[dim])):
                if near is None:
                    out[at] = node
        return out

    def reach(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """anchors x leaves: which may hold a row that scores between low and high with the anchor (one pair or several a row)."""
        root, n = self.roots[anchors.shape[1]]
        most, out = self.most[anchors.shape[1]], np.zeros((len(anchors), n), bool)
        own = np.concatenate([anchors, np.zeros((len(anchors), 1))], axis=1)
        d, square = {id(x): distances(own, x.points) for x in nodes(root)}, (anchors * anchors).sum(axis=1) + most
        slack = 1e-5 * float(np.sqrt(square.max(initial=1.0))) + 1e-5
        for k in range(low.shape[1]):
            to, from_ = np.sqrt(np.maximum(0, square - 2 * low[:, k])), np.sqrt(np.maximum(0, square - 2 * high[:, k]))
            reached(root, from_, to, d, slack, out, low[:, k] <= high[:, k])
        return out


def by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each number of components, PART rows at a time."""
    vectors = batch.column(column)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), PART):
            part = rows[at : at + PART]
            yield part, flat[starts[part][:, None] + np.arange(dim)]


def build(rows: DataFrame) -> tuple[DataFrame, Tree]:
    """The file of rows (vec_id, label, v): dim and leaf added, sorted by them; and the tree. Rows of numbers of components that the sample misses have one leaf."""
    spark = rows.sparkSession
    marked = rows.withColumn("narrow", is_narrow(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    found = marked.where("narrow").groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("most"), F.count("*").alias("n")).collect()  # a row for each number of components
    most, n = {r.dim: float(r.most) for r in found}, sum(r.n for r in found)
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
    sample = marked.where("narrow").where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share).select("v").limit(2 * SAMPLE).collect() if n else []
    roots = {}
    for dim in most:
        of_dim, counter = [r.v for r in sample if len(r.v) == dim], [0]
        own = np.array(of_dim, np.float64).reshape(len(of_dim), dim)
        roots[dim] = (fitted(lengthened(own, most[dim]), counter), max(1, counter[0]))
    shared = spark.sparkContext.broadcast(Tree(roots, most))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.full(b.num_rows, WIDE, np.int64)
            narrow = b.column(3).to_numpy(zero_copy_only=False)
            for part, v in by_dim(b, 2):
                ok = narrow[part]
                leaf[part[ok]] = shared.value.leaves(v[ok])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(leaf, pa.int32())], ["vec_id", "label", "v", "leaf"])

    filing = marked.select("vec_id", "label", "v", "narrow").mapInArrow(filed, "vec_id long, label long, v array<double>, leaf int").withColumn("dim", F.size("v"))
    parts = partitions(spark)
    file = stored(filing.repartitionByRange(parts, "dim", "leaf", "vec_id").sortWithinPartitions("dim", "leaf", "vec_id"), "negatives-file")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {id(x): (dim, i) for dim, (root, _) in shared.value.roots.items() for i, x in enumerate(nodes(root))}
        low, high = {}, {}
        for b in batches:
            for _, v in by_dim(b, 0):
                dim = v.shape[1]
                for node, _, d, near in walk(shared.value.roots[dim][0], lengthened(v, shared.value.most[dim])):
                    if near is None:
                        continue
                    key, k = places[id(node)], len(node.points)
                    lo, hi = low.setdefault(key, np.full((k, k), np.inf)), high.setdefault(key, np.full((k, k), -np.inf))
                    for j in np.unique(near):
                        lo[:, j] = np.minimum(lo[:, j], d[near == j].min(axis=0))
                        hi[:, j] = np.maximum(hi[:, j], d[near == j].max(axis=0))
        rows = [(*key, i, j, lo[i, j], high[key][i, j]) for key, lo in low.items() for i in range(len(lo)) for j in range(len(lo)) if lo[i, j] <= high[key][i, j]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        names = ["dim", "node", "i", "j", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names)

    ranges = file.where(F.col("leaf") != WIDE).select("v").mapInArrow(ranged, "dim int, node int, i int, j int, low double, high double")
    tree = Tree(roots, most)
    for root, _ in roots.values():
        for x in nodes(root):  # a sibling without rows can hold none
            x.low, x.high = np.full((len(x.points), len(x.points)), np.inf), np.full((len(x.points), len(x.points)), -np.inf)
    for r in ranges.groupBy("dim", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # the size of the tree
        x = nodes(roots[r.dim][0])[r.node]
        x.low[r.i, r.j], x.high[r.i, r.j] = r.low, r.high
    return file, tree


class Best:
    """The k best of each (anchor, slot) among candidates that come bit by bit: higher scores first, then smaller ids."""

    def __init__(self, k: int, shape: tuple[int, int]):
        self.k, self.shape, self.parts, self.held = k, shape, [], 0
        self.floor = np.full(shape[0] * shape[1], -np.inf)  # the kth score so far: what is under it can't count

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(place):
            self.parts.append((place, ids, scores))
            self.held += len(place)
            if self.held > HELD:
                self.pack()

    def pack(self) -> None:
        if not self.parts:
            return
        place, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if scores.dtype == object:
            places = {s: n for n, s in enumerate(sorted(set(scores.tolist())))}
            rank = np.array([places[s] for s in scores.tolist()], np.int64)
        else:
            rank = scores
        order = np.lexsort((ids, -rank, place))
        place = place[order]
        first = np.maximum.accumulate(np.where(np.diff(place, prepend=-1) != 0, np.arange(len(place)), 0))
        nth = np.arange(len(place)) - first
        full = order[nth == self.k - 1]
        self.floor[place[nth == self.k - 1]] = [float(s) for s in scores[full].tolist()]
        keep = order[nth < self.k]
        place = place[nth < self.k]
        self.parts, self.held = [(place, ids[keep], scores[keep])], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.pack()
        for place, ids, scores in self.parts:
            keys = [sort_key(int(s)) for s in scores.tolist()]
            columns = [pa.array(place // self.shape[1], pa.int32()), pa.array(place % self.shape[1], pa.int32()), pa.array(ids, pa.int64()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "vec_id", "beyond", "key", "score"])


def scan(file: DataFrame, tree: Tree, anchors: list, low: list[list], high: list[list], same: bool, k: int) -> DataFrame:
    """(anchor, slot, vec_id, beyond, key, score): of each task's rows, the k best of each anchor's windows; same: of its label, else of others.

    anchors: (vec_id, label, v, narrow); low, high: a list of windows each, whole numbers or None for no bound (for high). Every exact
    score in a window counts; leaves that no window of an anchor can meet are passed over for it.
    """
    slots = max(map(len, low))
    place, alive, dims = {}, {}, {}
    for i, a in enumerate(anchors):
        dims.setdefault((len(a.v), a.narrow), []).append(i)
    for (dim, narrow), own in dims.items():
        v = np.array([anchors[i].v for i in own], np.float64).reshape(len(own), dim)
        place[dim, narrow] = (np.array(own), v)
        if narrow:
            lo = np.array([[-np.inf if x is None else float(x) for x in low[i]] + [np.inf] * (slots - len(low[i])) for i in own])
            hi = np.array([[np.inf if x is None else float(x) for x in high[i]] + [-np.inf] * (slots - len(high[i])) for i in own])
            alive[dim] = tree.reach(v, lo, hi)
    wide = any(not a.narrow for a in anchors) or any(abs(x) > 1 << 62 for side in (low, high) for row in side for x in row if x is not None)
    kind = object if wide else np.int64
    bound = lambda side, none: np.array([[none if x is None else x for x in row] + [None] * (slots - len(row)) for row in side], object)
    lows, highs = bound(low, -(1 << 3000)), bound(high, 1 << 3000)
    used = np.array([[x is not None for x in row] for row in lows])
    if not wide:
        lows = np.where(used, np.maximum(np.where(used, lows, 0), -(1 << 62)), 1).astype(np.int64)
        highs = np.where(used, np.minimum(np.where(used, highs, 0), 1 << 62), 0).astype(np.int64)
    else:
        lows, highs = np.where(used, lows, 1), np.where(used, highs, 0)
    own_ids, own_labels = np.array([a.vec_id for a in anchors], np.int64), np.array([a.label for a in anchors], np.int64)
    shared = file.sparkSession.sparkContext.broadcast((place, alive, lows, highs, own_ids, own_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, alive, lows, highs, own_ids, own_labels = shared.value
        best = Best(k, (len(own_ids), slots))
        for b in batches:
            ids, labels, leaves = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
            for part, v in by_dim(b, 2):
                for leaf in np.unique(leaves[part]).tolist():
                    here = leaves[part] == leaf
                    rows, x = part[here], v[here]
                    for (dim, narrow), (who, a) in place.items():
                        if dim != v.shape[1]:
                            continue
                        if narrow and leaf != WIDE:
                            live = alive[dim][:, leaf]
                            if not live.any():
                                continue
                            who, a = who[live], a[live]
                            scores = (a @ x.T).astype(np.int64)
                        else:
                            scores = exact_products(a, x)
                        fits = (labels[rows][None, :] == own_labels[who][:, None]) == same
                        fits &= ids[rows][None, :] != own_ids[who][:, None]
                        for s in range(slots):
                            inside = (scores >= lows[who, s][:, None]) & (scores <= highs[who, s][:, None])
                            i, j = np.nonzero(fits & inside.astype(bool))
                            got, at = scores[i, j], who[i] * slots + s
                            if got.dtype != object:
                                still = got >= best.floor[at]
                                i, j, got, at = i[still], j[still], got[still], at[still]
                            best.add(at, ids[rows[j]], got.astype(kind) if kind is object else got)
        yield from best.rows()

    return file.select("vec_id", "label", "v", "leaf").mapInArrow(run, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*best_first()))).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Both: (vec_id, label, v array<double> of whole numbers), anchors being rows. Positives are the anchor's best rows of its label, negatives
    the best rows of other labels with least_share * positive <= 100 * negative <= 100 * positive, so a positive below zero has none.
    Rows under the anchor's own vec_id are never its partners; rows that repeat are each a partner, and each an anchor.
    Vectors of another number of components than the anchor's aren't either. Rows without a vec_id come last among ties. Scores of any size are compared
    exactly; beyond a long the nearest long is given. An empty table gives no rows.
    """
    spark = rows.sparkSession
    file, tree = build(rows)
    asked = stored(anchors.select("vec_id", "label", "v", is_narrow(F.col("v")).alias("narrow")), "negatives-anchors")
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks))), "negatives-blocks")
    results = []
    for n in range(blocks):
        own = (asked.where(F.col("block") == n) if blocks > 1 else asked).orderBy("vec_id", "label", "v").collect()  # one block
        if not own:
            continue
        every = [[None]] * len(own)
        got: dict[int, list] = {}
        for r in top(scan(file, tree, own, every, every, True, positives), positives).orderBy("anchor", "rank").collect():  # a few rows for each of the block
            got.setdefault(r.anchor, []).append((r.vec_id, from_key(r.beyond, bytes(r.key) if r.key is not None else None, r.score)))
        high = [[score for _, score in got.get(i, ())] for i in range(len(own))]
        low = [[-(-(least_share * score) // 100) for score in scores] for scores in high]
        if not any(high):
            continue
        found = top(scan(file, tree, own, low, high, False, negatives), negatives)
        names = [(i, s, own[i].vec_id, p[0], sort_key(p[1])[2]) for i, ps in got.items() for s, p in enumerate(ps)]
        named = spark.createDataFrame(names, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        results.append(stored(found.join(F.broadcast(named), ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))  # one block's names
    out = results[0] if results else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for other in results[1:]:
        out = out.unionByName(other)
    hidden = lambda c: F.nullif(F.col(c), F.lit(NAMELESS)).alias(c)
    return out.select(hidden("anchor_id"), hidden("positive_id"), "rank", hidden("negative_id"), "positive_score", "negative_score")


def labelled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the embeddings that take part: label and vector without nulls, finite; every seventh row's label is moved on."""
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    return taking_part(vectors.where("label is not null"), SCALE, moved.alias("label")).select("vec_id", "label", "v")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(labelled(table(spark, sf_dir, "embeddings")), "negatives-rows")
    return mine(rows, rows.where((F.col("vec_id") != NAMELESS) & (F.col("vec_id") % EVERY == 0)))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, c.vec_id, c.label, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE al = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.al <> s.label AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
