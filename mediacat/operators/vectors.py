"""Vector search: exact top-k and thresholds, approximate search, and matching faces to persons."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediacat.functions.vectors import doubles, norm, similarity
from mediacat.storage import partitions, stored

QUERY_BYTES = 32 << 20
#: Up to so many pairs are scored one by one; blocks are compared in tiles of so many rows; bytes of vectors of a task.
FEW_PAIRS, TILE_ROWS, PART_BYTES = 1 << 16, 2048, 1 << 20
#: Similarities are rounded to six places: half a unit of the last, and a little.
PLACES, HALF = Decimal("0.000001"), 0.5e-6 + 1e-9
#: Rows that centroids are fitted on, rounds of fitting, and rows of the sample whose neighbours decide how many lists are probed.
SAMPLE, ROUNDS, JUDGES = 20_000, 8, 200
#: Candidates that are scored exactly, for each of the k asked for.
EXACT = 4


def _bytes(df: DataFrame, v: str) -> int:
    return _size(df, v)[1]


def _size(df: DataFrame, v: str) -> tuple[int, int]:
    """(rows, bytes)"""
    r = df.agg(F.count("*").alias("n"), F.sum(F.size(v) * 8 + 32).alias("bytes")).first()
    return r.n, int(r.bytes or 0)


def _sides(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, q) and (file_id, v) of the rows that have a length."""
    q = queries.select(F.col("id").alias("query_id"), doubles(F.col("embedding")).alias("q")).where(norm(F.col("q")) > 0)
    return q, vectors.select("file_id", doubles(F.col("embedding")).alias("v")).where(norm(F.col("v")) > 0)


class _Rows(NamedTuple):
    """Vectors of one number of components, their ids, lengths and directions."""

    ids: np.ndarray
    x: np.ndarray
    length: np.ndarray
    unit: np.ndarray

    def part(self, at: slice | np.ndarray) -> _Rows:
        return _Rows(*(c[at] for c in self))


def _in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows, term by term, as the column functions add."""
    return np.add.accumulate(terms, axis=1)[:, -1]


def _read(ids: pa.Array, v: pa.Array) -> dict[int, _Rows]:
    """The rows by their number of components."""
    ids, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, v))
    sizes, out = pc.list_value_length(v).to_numpy(zero_copy_only=False), {}
    for dim in np.unique(sizes).tolist():
        own = pa.array(np.flatnonzero(sizes == dim))
        names = ids.take(own)
        named = names.to_numpy() if pa.types.is_integer(names.type) and not names.null_count else np.array([*names.to_pylist(), None], object)[:-1]
        x = v.take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
        with np.errstate(all="ignore"):
            length = np.sqrt(_in_order(x * x))
            # A row whose products can't be trusted to rounding (too long, too short, not finite) is scored one by one.
            unit = np.where(((length > 1e-100) & (length < 1e100))[:, None], x / length[:, None], np.nan)
        out[dim] = _Rows(named, x, length, unit)
    return out


def _scores(a: _Rows, b: _Rows, metric: str) -> tuple[np.ndarray, np.ndarray | float]:
    """(similarities by products, how far off each row's may be); not a number where they can't be trusted."""
    slack = 4e-16 * (a.x.shape[1] + 8)
    if metric != "l2":
        return a.unit @ b.unit.T, slack
    with np.errstate(all="ignore"):
        s = a.x @ b.x.T
        s *= -2
        s += (a.length**2)[:, None]
        s += (b.length**2)[None]
        s = 1 / (1 + np.maximum(s, 0))
        s[~np.isfinite(a.unit[:, 0])] = np.nan
        s[:, ~np.isfinite(b.unit[:, 0])] = np.nan
        fine = b.length[np.isfinite(b.unit[:, 0])]
        return s, (slack * (a.length + fine.max(initial=0.0)) ** 2)[:, None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """x to six places, halves away from zero by the shortest decimal that stands for x, as the column function rounds."""
    with np.errstate(invalid="ignore"):
        out = np.rint(x * 1e6) / 1e6 + 0.0
        for i in np.flatnonzero(np.abs(np.abs(x * 1e6 - np.trunc(x * 1e6)) - 0.5) < 1e-6):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(PLACES, ROUND_HALF_UP)) + 0.0
    return out


def _settled(s: np.ndarray, off: np.ndarray, a: _Rows, b: _Rows, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Rounded similarities of the rows i of a and j of b, whose s is `off` off at most: those too near to a half are computed again, term by term."""
    with np.errstate(all="ignore"):
        out = np.rint(s * 1e6) / 1e6 + 0.0
        again = np.flatnonzero(~(np.abs(np.abs(s * 1e6 - np.trunc(s * 1e6)) - 0.5) > off * 1e6 + 1e-6))
        for at in range(0, len(again), TILE_ROWS * 8):
            rows = again[at : at + TILE_ROWS * 8]
            x, y = a.x[i[rows]], b.x[j[rows]]
            if metric == "l2":
                exact = 1 / (1 + _in_order((x - y) * (x - y)))
            else:
                exact = _in_order(x * y) / (a.length[i[rows]] * b.length[j[rows]])
            out[rows] = _rounded(exact)
    return out


def _candidates(a: _Rows, b: _Rows, metric: str, bound) -> Iterator[tuple[_Rows, _Rows, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(part of a, part of b, its place in a, i, j, rounded similarity) of the pairs that may reach bound(place, similarities, off), tile by tile."""
    for at in range(0, len(a.ids), TILE_ROWS):
        place = slice(at, at + TILE_ROWS)
        own = a.part(place)
        for first in range(0, len(b.ids), TILE_ROWS):
            other = b.part(slice(first, first + TILE_ROWS))
            s, off = _scores(own, other, metric)
            i, j = np.nonzero(~(s < bound(place, s, off) - off - HALF))
            if len(i):
                yield own, other, place, i, j, _settled(s[i, j], off[i, 0] if isinstance(off, np.ndarray) else np.full(len(i), off), own, other, i, j, metric)


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers that sort as the ids do, nulls first."""
    if ids.dtype != object:
        return ids
    place = {x: n for n, x in enumerate(sorted(set(ids.tolist()), key=lambda x: (x is not None, x)))}
    return np.array([place[x] for x in ids.tolist()], np.int64)


Meeting = Iterator[tuple[int, _Rows, _Rows]]
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _reaching(meetings: Meeting, metric: str, threshold: float) -> Found:
    """All pairs from the threshold on; one that isn't a number passes any."""
    for _, q, v in meetings:
        for own, other, _, i, j, s in _candidates(q, v, metric, lambda *_: threshold):
            over = ~(s < threshold)
            yield own.ids[i[over]], other.ids[j[over]], s[over]


def _best(meetings: Meeting, metric: str, k: int, threshold: float) -> Found:
    """The k best of each query from the threshold on, ties to the smaller id; not a number is above all."""
    states: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim, q, v in meetings:
        ids, top, names = states.setdefault(dim, (q.ids, np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), None if v.ids.dtype == object else 0, v.ids.dtype)))
        if v.ids.dtype == object and names.dtype != object:  # the first rows with a null id
            names = names.astype(object)
            states[dim] = (ids, top, names)

        def bound(place: slice, s: np.ndarray, off, top=top) -> np.ndarray:
            least = np.maximum(top[place, -1], threshold)
            empty = np.flatnonzero(top[place, -1] == -np.inf)
            if len(empty) and s.shape[1] > k:  # none known yet: the kth of the tile itself, of those that can be trusted
                kth = np.partition(np.nan_to_num(s[empty], nan=-np.inf), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                least[empty] = np.maximum(threshold, kth - 2 * np.ravel(off if np.ndim(off) == 0 else off[empty]) - 2 * HALF)
            return least[:, None]

        for _, other, place, i, j, s in _candidates(q, v, metric, bound):
            over = ~(s < threshold)
            i, j, s = i[over] + place.start, j[over], np.where(np.isnan(s[over]), np.inf, s[over])
            rows = np.unique(i)
            who, key = np.concatenate([np.repeat(rows, k), i]), np.concatenate([top[rows].ravel(), s])
            file = np.concatenate([names[rows].ravel(), other.ids[j]])
            by = np.lexsort((_order(file), -key, who))
            starts = np.flatnonzero(np.diff(who[by], prepend=-1))
            best = by[(starts[:, None] + np.arange(k)[None]).ravel()]
            top[rows], names[rows] = key[best].reshape(-1, k), file[best].reshape(-1, k)
    for ids, top, names in states.values():
        i, j = np.nonzero(top > -np.inf)
        yield ids[i], names[i, j], np.where(np.isinf(top[i, j]), np.nan, top[i, j])


def _best_of_owner(meetings: Meeting, threshold: float) -> Found:
    """The best cosine of each query and owner (the ids of the other side, many rows each) from the threshold on, once for each tile."""
    for _, q, v in meetings:
        v = v.part(np.argsort(_order(v.ids), kind="stable"))
        for first in range(0, len(v.ids), TILE_ROWS):
            other = v.part(slice(first, first + TILE_ROWS))
            of = _order(other.ids)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ends = np.append(starts[1:], len(of))
            for at in range(0, len(q.ids), TILE_ROWS):
                own = q.part(slice(at, at + TILE_ROWS))
                # Half as wide numbers tell which rows have anything near the threshold here.
                coarse = (own.unit.astype(np.float32) @ other.unit.astype(np.float32).T).max(axis=1)
                own = own.part(np.flatnonzero(~(coarse < threshold - 2e-7 * (own.x.shape[1] + 8) - HALF)))
                if not len(own.ids):
                    continue
                s, off = _scores(own, other, "cosine")
                top = np.maximum.reduceat(s, starts, axis=1)
                i, p = np.nonzero(~(top < threshold - off - HALF))
                if not len(i):
                    continue
                # Rounding keeps the order: only where the best lies too near to a half do others count.
                with np.errstate(invalid="ignore"):
                    x = top[i, p] * 1e6
                    clear = np.abs(np.abs(x - np.trunc(x)) - 0.5) > 2 * off * 1e6 + 1e-6
                    best = np.rint(x) / 1e6 + 0.0
                for n in np.flatnonzero(~clear):
                    j = np.arange(starts[p[n]], ends[p[n]])
                    j = j[~(s[i[n], j] < top[i[n], p[n]] - 2 * off)]
                    best[n] = _settled(s[i[n], j], np.full(len(j), np.inf), own, other, np.full(len(j), i[n]), j, "cosine").max()
                over = ~(best < threshold)
                yield own.ids[i[over]], other.ids[starts[p[over]]], best[over]


def _met(q: DataFrame, v: DataFrame, work: Callable[[Meeting], Found], block_bytes: int, sizes: tuple[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(query_id, file_id, similarity) that work gives for all meetings of queries and vectors of one number of components.

    The smaller side goes to every task if it is under block_bytes, and the other passes by; two large sides meet block by block, each pair of blocks
    in a group.
    """
    kinds = (q.schema["query_id"].dataType, v.schema["file_id"].dataType)
    schema = f"query_id {kinds[0].simpleString()}, file_id {kinds[1].simpleString()}, similarity double"
    arrow = [to_arrow_type(k) for k in kinds]

    def batches(found: Found) -> Iterator[pa.RecordBatch]:
        for i, j, s in found:
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(i[part], arrow[0]), pa.array(j[part], arrow[1]), pa.array(s[part])], ["query_id", "file_id", "similarity"])

    few, ways = (sizes[0][1] <= sizes[1][1]), partitions(q.sparkSession)
    small, large = (q, v) if few else (v, q)
    if min(sizes[0][1], sizes[1][1]) <= block_bytes:
        held = small.toArrow()  # at most block_bytes
        shared = q.sparkSession.sparkContext.broadcast(_read(held.column(0), held.column(1)) if held.num_rows else {})

        def passing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            meet = ((dim, shared.value[dim], part) for b in rows if b.num_rows for dim, part in _read(b.column(0), b.column(1)).items() if dim in shared.value)
            if few:
                yield from batches(work(meet))
            else:
                for dim, held, part in meet:
                    yield from batches(work(iter([(dim, part, held)])))

        rows = large.repartition(int(min(ways, max(sizes[0][1], sizes[1][1]) // PART_BYTES + 1)))
        return rows.mapInArrow(passing, schema)
    # Blocks small enough that every partition gets a few pairs of them.
    block = min(block_bytes, max(PART_BYTES, int((sizes[0][1] * sizes[1][1] / (4 * ways)) ** 0.5)))
    n = {"i": sizes[0][1] // block + 1, "j": sizes[1][1] // block + 1}
    dealt = lambda df, own, other, key: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n[own])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n[other] - 1))))
    q, v = dealt(q, "i", "j", "query_id"), dealt(v, "j", "i", "v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        left, right = _read(a.column("query_id"), a.column("q")), _read(b.column("file_id"), b.column("v"))
        out = [*batches(work((dim, left[dim], right[dim]) for dim in left if dim in right))]
        return pa.Table.from_batches(out, pa.schema([("query_id", arrow[0]), ("file_id", arrow[1]), ("similarity", pa.float64())]))

    return q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(meet, schema)


def _scored(queries: DataFrame, vectors: DataFrame, metric: str, work: Callable[[Meeting], Found], block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, file_id, similarity) of at least the pairs that work finds; rows of zero length take no part.

    Few pairs are scored one by one, all of them, with the smaller side broadcast; more by products of blocks, which give the same numbers.
    """
    if metric not in ("cosine", "cosine_distance", "l2"):
        raise ValueError(metric)
    q, v = _sides(queries, vectors)
    sizes = _size(q, "q"), _size(v, "v")
    if sizes[0][0] * sizes[1][0] > FEW_PAIRS or min(sizes[0][1], sizes[1][1]) > block_bytes:
        return _met(q, v, work, block_bytes, sizes)
    same = F.size("v") == F.size("q")
    pairs = q.join(F.broadcast(v), same) if sizes[1][1] < sizes[0][1] else v.join(F.broadcast(q), same)
    return pairs.select("query_id", "file_id", F.round(similarity(F.col("q"), F.col("v"), metric), 6).alias("similarity"))


def search_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float = 0.0, embedding_type: str | None = None, metric: str = "cosine", files: DataFrame | None = None) -> DataFrame:
    """The k best of each query by similarity (ties to the smaller id); then those under the threshold go; then rows without a file."""
    v = vectors if embedding_type is None else vectors.where(F.col("embedding_type") == embedding_type)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "file_id")
    best = _scored(queries, v, metric, lambda meetings: _best(meetings, metric, k, threshold))
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("similarity") >= threshold)
    return top if files is None else top.join(files.select(F.col("id").alias("file_id"), "file_path"), "file_id")


def find_similar(queries: DataFrame, vectors: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All pairs from the threshold on."""
    return _scored(queries, vectors, "cosine", lambda meetings: _reaching(meetings, "cosine", threshold)).where(F.col("similarity") >= threshold)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def fit_lists(vectors: DataFrame, lists: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 7) -> tuple[np.ndarray, int]:
    """(centroids, probes) of vectors (file_id, embedding): directions that k-means finds in a bounded sample, and the fewest lists next to a query that hold
    `recall` of the neighbours of the sample's own rows. lists: the square root of the number of rows, unless given. Vectors have one number of components.
    """
    v = vectors.select("file_id", doubles(F.col("embedding")).alias("v")).where(norm(F.col("v")) > 0)
    n = v.count()
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
    rows = v.where(F.pmod(F.xxhash64("file_id", "v"), F.lit(1 << 30)) < share).select("v").limit(2 * SAMPLE).collect() if n else []
    if not rows:
        return np.zeros((0, 0)), 0
    x, rng = _unit(np.array([r.v for r in rows])), np.random.default_rng(seed)
    lists = min(len(x), lists or max(1, int(n**0.5)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.bincount(own, minlength=lists)[:, None] > 0, _unit(sums), centres)
    own, judges = (x @ centres.T).argmax(axis=1), rng.choice(len(x), min(JUDGES, len(x)), replace=False)
    place = np.argsort(np.argsort(-(x[judges] @ centres.T), axis=1), axis=1)  # how near each list is to each judge
    scores = x[judges] @ x.T
    scores[np.arange(len(judges)), judges] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    reached = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return centres, int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1 if len(reached) else 1


def file_in_lists(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(list, file_id, code) of all vectors (file_id, embedding) with a length: the nearest centroid, and the direction in a byte a component; sorted by list."""
    v = vectors.select(F.col("file_id").cast("long").alias("file_id"), doubles(F.col("embedding")).alias("v")).where(norm(F.col("v")) > 0)
    shared = v.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(np.array(b.column(1).to_pylist(), np.float64)) if b.num_rows else np.zeros((0, shared.value.shape[1]))
            codes = np.rint(x * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array((x @ shared.value.T).argmax(axis=1) if len(x) else [], pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "file_id", "code"])

    filed = v.mapInArrow(run, "list int, file_id long, code binary")
    return stored(filed.repartitionByRange("list", "file_id").sortWithinPartitions("list", "file_id"), "lists")


def approx_candidates(queries: DataFrame, filed: DataFrame, centres: np.ndarray, probes: int, n: int) -> DataFrame:
    """(query_id, file_id): the n best of each query by their codes, of the rows in the `probes` lists next to it. queries (id, embedding) are a stated set, in blocks of QUERY_BYTES."""
    q = queries.select(F.col("id").cast("long").alias("query_id"), doubles(F.col("embedding")).alias("q")).where(norm(F.col("q")) > 0)
    blocks, found = _bytes(q, "q") // QUERY_BYTES + 1, None
    for at in range(blocks if len(centres) else 0):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)).collect()  # one block
        if not rows:
            continue
        x = _unit(np.array([r.q for r in rows]))
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
        by_list = [np.flatnonzero((near == c).any(axis=1)) for c in range(len(centres))]
        shared = filed.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows]), x.astype(np.float32), by_list))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, by_list = shared.value
            best_id, best = np.zeros((len(ids), n), np.int64), np.full((len(ids), n), -np.inf, np.float32)
            for b in batches:
                lists, files = b.column(0).to_numpy(), b.column(1).to_numpy()
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(b.num_rows, -1).astype(np.float32)
                for c in np.unique(lists).tolist():
                    here, who = np.flatnonzero(lists == c), by_list[c]
                    for part in (here[i : i + 4096] for i in range(0, len(here), 4096)):
                        scores = np.concatenate([best[who], x[who] @ codes[part].T], axis=1)
                        names = np.concatenate([best_id[who], np.broadcast_to(files[part], (len(who), len(part)))], axis=1)
                        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                        best[who], best_id[who] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(names, top, axis=1)
            i, j = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best_id[i, j]), pa.array(best[i, j])], ["query_id", "file_id", "near"])

        part = filed.mapInArrow(run, "query_id long, file_id long, near float")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return filed.sparkSession.createDataFrame([], "query_id long, file_id long")
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "file_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("query_id", "file_id")


def search_approx(queries: DataFrame, vectors: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, recall: float = 0.95, exact: int = EXACT) -> DataFrame:
    """(query_id, file_id, similarity, rank): approximate top-k by cosine. queries (id, embedding), vectors (file_id, embedding) of one number of components.

    Every vector is filed in the list of its nearest centroid. Of the lists next to a query only small codes are read, and exact * k candidates are
    compared exactly. probes: how many lists; without it, what the sample needs for `recall`, which is few where vectors have a structure and most where they have none.
    """
    centres, needed = fit_lists(vectors, lists, recall, k)
    candidates = stored(approx_candidates(queries, file_in_lists(vectors, centres), centres, probes or needed, exact * k), "candidates")
    q, v = _sides(queries, vectors)
    pairs = candidates.join(v, "file_id").join(q, "query_id").select("query_id", "file_id", F.round(similarity(F.col("q"), F.col("v"), "cosine"), 6).alias("similarity"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "file_id"))).where(F.col("rank") <= k)


def person_hits(faces: DataFrame, gallery: DataFrame, threshold: float, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(face_id, person_id, similarity): the best hit of each face and person from the threshold on."""
    named = gallery.select(F.col("person_id").alias("file_id"), "embedding")
    hits = _scored(faces, named, "cosine", lambda meetings: _best_of_owner(meetings, threshold), block_bytes).where(F.col("similarity") >= threshold)
    return hits.groupBy(F.col("query_id").alias("face_id"), F.col("file_id").alias("person_id")).agg(F.max("similarity").alias("similarity"))


def match_persons(faces: DataFrame, gallery: DataFrame, threshold: float = 0.6, best: bool = True, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(face_id, person_id, similarity): the best hit of each person from the threshold on, best first; or, best=False, only the first person by id with any hit.

    faces (id, embedding), gallery (person_id, embedding). The smaller side is broadcast if it is under block_bytes; two large sides meet block by block, each pair of
    blocks in a task, which gives the best of each face and person in it.
    """
    persons = person_hits(faces, gallery, threshold, block_bytes)
    order = [F.desc("similarity"), F.col("person_id")] if best else [F.col("person_id")]
    ranked = persons.withColumn("rank", F.row_number().over(Window.partitionBy("face_id").orderBy(*order)))
    return ranked if best else ranked.where("rank = 1")
