"""Near copies by SimHash, tiled comparison of fingerprints, and the exact similarity of word shingles.

Texts are sets of five-word shingles. Two texts of Jaccard similarity 0.8 differ in 15 % of their SimHash bits, those of four
and five shingles in 19 %: too many for 64 bits and bands by the pigeonhole, so a fingerprint is 320 bits and more, and its bands
are 8 bits and more; of these such texts share at least one with a chance of 0.9994, more similar ones with a greater one. A
band's bucket is compared tile against tile, as in simhash: exclusive-or and bit counts of 192 bits. What is linked so is a group of
candidates: few texts give pairs, each verified once however many bands it shares; more are verified in tiles, and give a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import components, partitions, stored
from mediacat.llm.simhash import LOWER, first_rows, merge

SHINGLE = 5
LEAST = 0.8
#: Bits of a band, and words of 64 bits of a fingerprint, for up to a million rows; see layout().
WIDTH, WORDS = 8, 5
#: Words that tiles compare, and the bits in which they may differ: at similarity 0.8 more do with a chance below 1 in 10,000.
COMPARED, RADIUS = 3, 58
FEW = 16
#: Rows, and bytes of shingle sets, of a tile of a large bucket.
TILE_ROWS, TILE_BYTES = 8192, 1 << 26
TILE = 512
COLUMNS = 4096
_rng = np.random.default_rng(42)
MULTIPLY, ADD = _rng.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LANES = np.uint64(0x0101010101010101)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 (seed 42) of the text's distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    shingles = {line[a:b] for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)}
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles)))


def layout(rows: int) -> tuple[int, int]:
    """(width, words): bits of a band, so that buckets of unlike texts keep about 4,096 rows, and words of the fingerprint.

    As many bands as texts of four and five shingles (0.8125 of their bits agree) need to share one with a chance of 0.9994.
    """
    width = min(16, max(WIDTH, math.ceil(math.log2(max(rows, 1) / 4096))))
    return width, math.ceil(math.log(6e-4) / math.log(1 - 0.8125**width) / (64 // width))


def fingerprint(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of 64 bits a word: a bit is 1 if set in over half the shingles' hashes, mixed anew for each word. No shingles: all zero."""
    ones = np.zeros((8, words, 8), np.int64)  # by bit of the byte, word, byte
    shift = np.arange(8, dtype=np.uint64)[:, None, None]
    for at in range(0, len(shingles), 255):  # sums fit in their bytes; bounded memory for very long texts
        x = shingles[at : at + 255] * MULTIPLY[:words, None] + ADD[:words, None]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += ((x >> shift) & LANES).sum(axis=2).astype("<u8").view(np.uint8).reshape(8, words, 8)
    bits = np.packbits((2 * ones > len(shingles)).transpose(1, 2, 0).reshape(words, 64), axis=1, bitorder="little")
    return bits.reshape(-1).view("<u8").astype(np.uint64)


def band_keys(shingles: np.ndarray, words: int = WORDS, width: int = WIDTH) -> np.ndarray:
    """The bands of the fingerprint, each with its number in front. All texts without words get the same."""
    each = 64 // width
    bits = fingerprint(shingles, words)[:, None] >> (np.arange(each, dtype=np.uint64) * np.uint64(width)) & np.uint64((1 << width) - 1)
    return (np.arange(words * each, dtype=np.uint64) << np.uint64(width)) | bits.reshape(-1)


def compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which fingerprints (words in rows) of one tile are within the radius of which of another."""
    differ = np.bitwise_count(x[0][:, None] ^ y[0][None])
    for a, b in zip(x[1:], y[1:], strict=True):
        differ += np.bitwise_count(a[:, None] ^ b[None])
    return differ <= RADIUS


def candidates(fp: np.ndarray, key: np.ndarray, size: np.ndarray, side: np.ndarray, least: float = LEAST, tile: int = 256) -> np.ndarray:
    """Root of each row after linking all rows of one key within the radius. side: 0 both, or rows 1 are held against rows 2 only.

    fp: words in rows. Rows are laid out by key and size of the shingle set and cut into tiles; a tile meets the later ones that go on with
    its last key, unless their sizes rule the similarity out. Small keys share a tile, and are kept apart.
    """
    order = np.lexsort((size, key))
    x, k, n, s, label = fp[:, order], key[order], size[order], side[order], np.arange(len(key))
    for a in range(0, len(k), tile):
        left = slice(a, min(a + tile, len(k)))
        for b in range(a, len(k), tile):
            # A later tile can only hold on to the last key of this one.
            if b > a and (k[b] != k[left.stop - 1] or n[left.stop - 1] < least * n[b]):
                break
            right = slice(b, min(b + tile, len(k)))
            if (label[left] == label[a]).all() and (label[right] == label[a]).all():
                continue
            i, j = np.nonzero(compare(x[:, left], x[:, right]))
            i, j = i + a, j + b
            fit = (i < j) & (k[i] == k[j]) & (n[i] >= least * n[j]) & ((s[i] != s[j]) | (s[i] == 0))
            label = merge(label, i[fit], j[fit])
    root = np.empty(len(k), np.int64)
    root[order] = order[label]
    return root


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], side: np.ndarray, least: float = LEAST, tile: int = TILE) -> np.ndarray:
    """Root of each set after linking all that are alike. side: 0 both, or sets 1 are held against sets 2 only.

    Tiles in order of size: those of too different sizes never meet, nor those whose sets are all linked already.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    n, side, label = sizes[order], side[order], np.arange(len(sets))
    for a in range(0, len(n), tile):
        for b in range(a, len(n), tile):
            left, right = np.arange(a, min(a + tile, len(n))), np.arange(b, min(b + tile, len(n)))
            if n[left[-1]] < least * n[right[0]]:
                break
            if len(np.unique(label[np.concatenate([left, right])])) == 1:
                continue
            both = common([sets[i] for i in order[left]], [sets[i] for i in order[right]])
            near = both >= least * (n[left][:, None] + n[right][None, :] - both)
            if side.any():
                near &= side[left][:, None] != side[right][None, :]
            i, j = np.nonzero(near)
            label = merge(label, left[i], right[j])
    root = np.empty(len(n), np.int64)
    root[order] = order[label]
    return root


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    x, y = (np.concatenate([*s, np.empty(0, np.uint64)]) for s in (a, b))
    shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float64)
    places = []
    for sets, flat in ((a, x), (b, y)):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(shared, flat)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat) if len(shared) else np.zeros(len(flat), bool)
        by = np.argsort(at[hit], kind="stable")
        places.append((row[hit][by], at[hit][by]))
    for first in range(0, len(shared), COLUMNS):
        dense = []
        for sets, (row, at) in zip((a, b), places, strict=True):
            lo, hi = np.searchsorted(at, [first, first + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, len(shared) - first)), np.float32)
            m[row[lo:hi], at[lo:hi] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _groups(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Groups of candidates (key, node, total, bytes) of rows (key, node, size, side, words ...) that come sorted by key.

    The new key is the hash of the group's nodes: a group that several bands find is one.
    """

    def linked(rows: pa.Table) -> pa.RecordBatch:
        key, size, side, *words = (rows.column(c).to_numpy() for c in (0, 2, 3, *range(4, rows.num_columns)))
        root = candidates(np.stack(words).view(np.uint64), key, size, side, least)
        _, of, count = np.unique(root, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[of] > 1)
        at = at[np.argsort(of[at], kind="stable")]
        nodes, ends = rows.column(1).take(pa.array(at)).to_pylist(), np.flatnonzero(np.diff(of[at], append=-1)) + 1
        start, out = 0, ([], [], [], [])
        for end in ends.tolist():
            group, total = sorted(nodes[start:end]), end - start
            for column, values in zip(out, ([xxhash.xxh64_intdigest(b"".join(group)) - (1 << 63)] * total, group, [total] * total, [int(size[at[start:end]].sum())] * total), strict=True):
                column += values
            start = end
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["key", "node", "total", "bytes"])

    keep: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if keep and (cut or keep[-1].column(0)[0].as_py() != key[-1]):
            yield linked(pa.Table.from_batches([*keep, batch.slice(0, cut)]))
            keep = []
        elif cut:
            yield linked(pa.Table.from_batches([batch.slice(0, cut)]))
        keep.append(batch.slice(cut))
    if keep:
        yield linked(pa.Table.from_batches(keep))


def _pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The alike ones of rows (a, b, set of a, set of b)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            near = [alike(x, y, least) for x, y in zip(_sets(part.column(2)), _sets(part.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(near, pa.bool_())), part.column(1).filter(pa.array(near, pa.bool_()))], ["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """A forest of links for each key of rows (key, node, set, side) that come sorted by key."""

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        root = forest([r[1] for r in rows], np.array([r[2] for r in rows], np.int8), least)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in moved], pa.binary()), pa.array([rows[root[i]][0] for i in moved], pa.binary())], ["a", "b"])

    now, rows = None, []
    for batch in batches:
        for key, node, shingles, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if rows and key != now:
                yield linked(rows)
                rows = []
            now = key
            rows.append((node, shingles, side))
    if rows:
        yield linked(rows)


def node_of(text: Column) -> Column:
    """Equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def shingle_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, text) -> (node, shingles): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [shingle_set(t, width).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles binary")


def fingerprinted(docs: DataFrame, words: int = WORDS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, node, words, size) of each row of docs; size: bytes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(t, width)
                found.append(fingerprint(own, words).view(np.int64))
                sizes.append(8 * len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "node", "words", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node binary, words array<long>, size long")


def bands(nodes: DataFrame, bits: int = WIDTH) -> DataFrame:
    """(key, node, size, w0, w1, ...) for each band of each of nodes (node, words, size), keys as band_keys has them."""
    each = 64 // bits
    rows = nodes.select("node", "size", *(F.get("words", F.lit(i)).alias(f"w{i}") for i in range(COMPARED)), F.posexplode("words").alias("at", "word"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    return rows.select(F.expr(f"shiftleft(cast(at * {each} + part as bigint), {bits}) | (shiftrightunsigned(word, part * {bits}) & {(1 << bits) - 1}L)").alias("key"), "node", "size", *(f"w{i}" for i in range(COMPARED)))


def dealt(rows: DataFrame, ways: Column) -> DataFrame:
    """rows with side, their key for each pair of tiles: large buckets meet as such pairs, dealt by the node's hash."""
    rows = rows.withColumn("ways", ways.cast("int")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).withColumn("side", F.when(F.col("salt") == F.col("other"), 0).when(F.col("salt") < F.col("other"), 1).otherwise(2).cast("byte"))
    return rows.withColumn("key", F.xxhash64("key", F.least("salt", "other"), F.greatest("salt", "other"), F.col("side") == 0))


def candidate_groups(nodes: DataFrame, bits: int = WIDTH, least: float = LEAST, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(key, node, total, bytes): groups of nodes whose fingerprints link them within a band's bucket. nodes: (node, words, size), distinct."""
    rows = bands(nodes, bits)
    large = rows.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > tile_rows)
    rows = dealt(rows.join(F.broadcast(large), "key", "left"), F.ceil(F.coalesce("all", F.lit(1)) / tile_rows))  # a row for each tile_rows rows of a band at most
    rows = rows.select("key", "node", "size", "side", *(f"w{i}" for i in range(COMPARED))).repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda it: _groups(it, least), "key long, node binary, total long, bytes long").distinct()


def links(nodes: DataFrame, texts: DataFrame, width: int = SHINGLE, least: float = LEAST, few: int = FEW, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES, bits: int = WIDTH) -> DataFrame:
    """Links (a, b) of nodes that are alike. nodes: (node, words, size), distinct; texts: (node, text), at least one row a node."""
    spark = nodes.sparkSession
    rows = stored(candidate_groups(nodes, bits, least, tile_rows), "copies-groups")
    wanted = rows.select("node").distinct()
    sets = stored(shingle_sets(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), width), "copies-sets")
    # Small groups: every pair, once.
    small = rows.where(F.col("total") <= few).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    small = small.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.slice("all", F.col("at") + 2, few)).alias("b")).distinct()
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    found = small.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _pairs(it, least), "a binary, b binary")
    # Large ones: whole, or as pairs of tiles.
    large = dealt(rows.where(F.col("total") > few), F.ceil(F.greatest(F.col("total") / tile_rows, F.col("bytes") / tile_bytes, F.lit(1.0))))
    large = large.select("node", "side", "key")
    large = large.join(sets, "node").select("key", "node", "shingles", "side").repartition(partitions(spark), "key").sortWithinPartitions("key")
    return found.unionByName(large.mapInArrow(lambda it: _tiles(it, least), "a binary, b binary"))


def near_dedup(docs: DataFrame, width: int = SHINGLE, least: float = LEAST, few: int = FEW, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """docs without near copies: of each group linked by similarities of `least` and more, one document stays, its columns as they were.

    That is the one of the smallest doc_id; in a group without any, the row of the smallest node, the first in the order of its
    columns. Rows that share a doc_id count as one document, of which the first row stays. Texts without words are copies of each other.
    """
    bits, words = layout(docs.count())
    rows = stored(fingerprinted(docs, words, width), "copies-words")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words"), F.first("size").alias("size")), "copies-nodes")
    texts = docs.select(node_of(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    roots = components(stored(links(nodes.select("node", "words", "size"), texts, width, least, few, tile_rows, tile_bytes, bits), "copies-links"))
    grouped = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = stored(grouped.groupBy("root").agg(F.min("rep").alias("keep"), F.min("node").alias("least")), "copies-kept")
    named = best.where("keep is not null").select(F.col("keep").alias("__keep"))
    unnamed = best.where("keep is null").select(F.col("least").alias("__keep"))
    at = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__node", F.when(F.col("doc_id").isNull(), node_of(F.col("text"))))
    kept = at.join(named, F.col("__id") == F.col("__keep"), "left_semi").unionByName(at.where("__id is null").join(unnamed, F.col("__node") == F.col("__keep"), "left_semi"))
    return first_rows(kept, ["__id", "__node"], docs.columns).select("__row.*")
