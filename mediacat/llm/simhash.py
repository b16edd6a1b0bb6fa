"""Near-duplicates by SimHash and tiled exact comparison.

Fingerprints that differ in few bits agree in one of radius + 1 bands of their bits, so only those that share a
band meet. A band's bucket is compared exactly, tile against tile in order of population counts: numpy
exclusive-or and bit counts; tile pairs whose population counts differ by more than the radius are skipped.
Buckets of more than TILE_ROWS are dealt out as such tile pairs, so no bucket is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from mediacat.llm.common import components, partitions, stored, table

SHINGLE = 3
RADIUS = 3
TILE_ROWS = 8192
TILE = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of all word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [line[a:b] for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
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


def compare(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints of one tile are within the radius of which of another."""
    return np.bitwise_count(x[:, None] ^ y[None]) <= radius


def tiles(fp: np.ndarray, key: np.ndarray, side: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Root of each row after linking all rows of one key within the radius. side: 0 both, or rows 1 are held against rows 2 only.

    Rows are laid out by key and population count and cut into tiles; a tile meets the later ones that go on with its last key,
    unless their counts differ beyond the radius. Small keys share a tile, and a mask keeps them apart.
    """
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((pop, key))
    x, p, s, k = fp[order], pop[order], side[order], key[order]
    from_, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(x), tile):
        last = min(a + tile, len(x)) - 1
        for b in range(a, len(x), tile):
            # A later tile can only hold on to the last key of this one.
            if b > a and (k[b] != k[last] or p[b] - p[last] > radius):
                break
            near = compare(x[a : a + tile], x[b : b + tile], radius)
            near &= k[a : a + tile, None] == k[None, b : b + tile]
            if s[a : a + tile].any():
                near &= (s[a : a + tile, None] != s[None, b : b + tile]) | (s[a : a + tile, None] == 0)
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):  # a forest of the tile pair, not all of its links
                j = j + (b - a)
                label = merge(np.arange(b - a + tile), i, j)
                moved = np.flatnonzero(label != np.arange(len(label)))
                from_.append(moved + a)
                to.append(label[moved] + a)
    label = merge(np.arange(len(x)), np.concatenate(from_), np.concatenate(to))
    root = np.empty(len(x), np.int64)
    root[order] = order[label]
    return root


def _groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (key, fp, side) that come sorted by key: a forest for each key, whatever its size."""

    def linked(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        root = tiles(fp, key, side, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], ["a", "b"])

    keep: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8)]
    for batch in batches:
        cols = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
        keep = [np.concatenate([x, y]) for x, y in zip(keep, cols, strict=True)]
        if len(keep[0]) == 0:
            continue
        cut = int(np.searchsorted(keep[0], keep[0][-1]))  # the last key may go on
        if cut:
            yield linked(*(x[:cut] for x in keep))
            keep = [x[cut:] for x in keep]
    if len(keep[0]):
        yield linked(*keep)


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints within the radius; no link of a group is lost, not all are listed.

    fps: (fp long), distinct. Each fingerprint goes to one bucket per band; buckets of over tile_rows rows are split
    by population count and salt, and their tiles meet pair by pair unless the counts differ beyond the radius.
    """
    bands, width = radius + 1, -(-64 // (radius + 1))
    mask = (1 << width) - 1
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    rows = rows.select("fp", "pop", "band", F.expr(f"shiftrightunsigned(fp, band * {width}) & {mask}L").alias("bits"))
    cells = rows.groupBy("band", "bits", "pop").agg(F.count("*").alias("n"))
    totals = cells.groupBy("band", "bits").agg(F.sum("n").alias("total")).where("total > 1")
    rows = rows.join(totals, ["band", "bits"])
    key = lambda *c: F.xxhash64("band", "bits", *c)
    whole = rows.where(F.col("total") <= tile_rows).select(key().alias("key"), "fp", F.lit(0).cast("byte").alias("side"))
    # Tiles of the large buckets: one for each population count and salt.
    big = cells.join(totals.where(F.col("total") > tile_rows).drop("total"), ["band", "bits"])
    split = F.ceil(F.col("n") / tile_rows).cast("int")
    big = big.select("band", "bits", "pop", split.alias("ways"), F.explode(F.sequence(F.lit(0), split - 1)).alias("salt"))
    other = big.select("band", "bits", F.col("pop").alias("pop2"), F.col("salt").alias("salt2"))
    pairs = big.join(other, ["band", "bits"]).where((F.abs(F.col("pop2") - F.col("pop")) <= radius) & ((F.col("pop") < F.col("pop2")) | ((F.col("pop") == F.col("pop2")) & (F.col("salt") <= F.col("salt2")))))
    pair = key("pop", "salt", "pop2", "salt2").alias("key")
    own = (F.col("pop") == F.col("pop2")) & (F.col("salt") == F.col("salt2"))
    ends = F.explode(F.when(own, F.array(F.struct(F.col("pop").alias("p"), F.col("salt").alias("s"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("pop").alias("p"), F.col("salt").alias("s"), F.lit(1).alias("side")), F.struct(F.col("pop2").alias("p"), F.col("salt2").alias("s"), F.lit(2).alias("side")))))
    ends = pairs.select("band", "bits", pair, ends.alias("e")).select("band", "bits", "key", F.col("e.p").alias("pop"), F.col("e.s").alias("salt"), F.col("e.side").cast("byte").alias("side"))
    dealt = rows.where(F.col("total") > tile_rows).join(big.select("band", "bits", "pop", "ways").distinct(), ["band", "bits", "pop"])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")).join(ends, ["band", "bits", "pop", "salt"]).select("key", "fp", "side")
    dealt = whole.unionByName(dealt).repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _groups(it, radius), "a long, b long")


def classes(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp, component_id): for each distinct fp, the smallest doc_id among all rows linked to it."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    roots = components(links(nodes.select("fp"), radius, tile_rows))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    return grouped.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other. A null doc_id stays null and never names
    a component (a component of null ids only has a null component_id). Repeated rows stay; other columns are ignored.
    """
    fps = stored(fingerprints(docs, width), "simhash")
    found = classes(fps, radius, tile_rows)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def orderable(kind: DataType) -> bool:
    """Whether Spark can order values of the type: maps, and what holds them, have no order."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def first_rows(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of each key, the first in the order of the columns (those that have no order: in that of their JSON)."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    odd = [c for c in columns if not orderable(rows.schema[c].dataType)]
    by = F.struct(*(F.to_json(F.struct(F.col(f"`{c}`"))) if c in odd else F.col(f"`{c}`") for c in columns))
    return rows.groupBy(*keys).agg((F.min_by(row, by) if odd else F.min(row)).alias("__row"))


def near_dedup(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without near copies: of each component the document of the smallest doc_id stays, all its columns as they were.

    Rows that share a doc_id count as one document, of which the first row in the order of its columns stays. Rows
    without a doc_id can't be named by a component: of those with equal texts one stays.
    """
    keep = near_duplicates(docs, width, radius).where("doc_id <=> component_id").select(F.col("doc_id").alias("__keep")).distinct()
    unnamed = F.when(F.col("doc_id").isNull(), F.sha2(F.col("text").cast("string"), 256))
    firsts = first_rows(docs.withColumn("__id", F.col("doc_id")).withColumn("__text", unnamed), ["__id", "__text"], docs.columns)
    kept = firsts.join(keep, F.col("__id") == F.col("__keep"), "left_semi").unionByName(firsts.where("__id is null"))
    return kept.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
