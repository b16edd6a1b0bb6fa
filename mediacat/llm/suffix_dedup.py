"""Removal of long repeated byte strings, by collection Burrows-Wheeler transforms built column by column.

Every string of LENGTH bytes is found through its anchor: the least hash among its substrings of GRAM bytes, the first
of ties. Strings with one anchor start next to each other and make a piece, so equal strings lie in pieces of equal anchors
at equal places. Pieces that are equal as a whole are settled by their first occurrence. The distinct pieces of an
anchor, bytes of at most LENGTH + GRAMS - 1, are small documents: the transform of all pieces of a part of the hash range is
built by one round per column, which inserts one symbol of each piece; in its order equal strings are neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import partitions, stored, table

LENGTH = 100
GRAM = 37
GRAMS = LENGTH - GRAM + 1
CHUNK = 1 << 18
FLUSH = 1 << 24
#: Parts of the hash range to a task, and strings (about bytes of text) to a task.
PARTS, TASK_STRINGS = 4, 1 << 25
#: An anchor with this many distinct pieces is hot: its pieces go by their own hash, and its strings by theirs. Anchors count
#: as candidates from LOCAL pieces in one flush on; at most MOST_HOT are taken, the most frequent (which ones only moves work).
HOT, LOCAL, MOST_HOT = 20_000, 64, 100_000

_ODD = 0x9E3779B97F4A7C15
_SYMBOLS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        n = CHUNK + 2 * LENGTH
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            _POWERS.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))]))
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, gram: int = GRAM, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces of concatenated documents: (anchor hash, piece hash, document, first start, number of starts), starts within data.

    The piece hash is XXH64 of the piece's bytes, seeded by the anchor's place: it has nothing in common with the anchor hash.
    """
    powers, inverse = _powers()
    n, grams = len(data), length - gram + 1
    none = (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * inverse[:n], out=sums[1:])
    h = mixed((sums[gram:] - sums[: n - gram + 1]) * powers[: n - gram + 1])
    least, at, step = h, np.arange(len(h), dtype=np.int32), 1
    while step < grams:  # least of 2, 4, 8 ... grams; the last step overlaps
        shift = min(step, grams - step)
        left, right = least[: len(least) - shift], least[shift:]
        keep = left <= right
        least, at, step = np.where(keep, left, right), np.where(keep, at[: len(left)], at[shift:]), step + shift
    doc = np.searchsorted(ends, np.arange(len(at)), side="right")
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[np.minimum(doc, len(ends) - 1)])
    if not len(start):
        return none
    a, d = at[start], doc[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    begin, place = start[first], a[first]
    text, digest = data.tobytes(), xxhash.xxh64_intdigest
    spans = zip(begin.tolist(), (begin + count - 1 + length).tolist(), (place - begin).tolist(), strict=True)
    whole = np.fromiter((digest(text[i:j], at) for i, j, at in spans), np.uint64, len(begin))
    return h[place], whole, d[first], begin, count


def _later(h: np.ndarray, f: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (anchor, piece, document, start), and in that order, which are not the first of their piece."""
    order = np.lexsort((start, rid, f, h))
    hs, fs = h[order], f[order]
    return order, np.concatenate([[False], (hs[1:] == hs[:-1]) & (fs[1:] == fs[:-1])]) if len(order) else np.empty(0, bool)


SENT = "part int, h binary, f binary, rid binary, start binary, n binary"
FOUND = "rid long, run long, h long"
PIECES = "part int, rid binary, start binary, n binary, bytes binary"


def _blob(part: int, h, f, rid, start, n) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h, f, rid, start, n.astype(np.uint8)))]
    return pa.RecordBatch.from_arrays(cols, ["part", "h", "f", "rid", "start", "n"])


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, piece, rid, start, n) of all pieces, FLUSH bytes of text at a time."""
    held: list[tuple] = []
    size = 0
    for rids, texts in _chunks(batches):
        data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        ends = np.cumsum([len(t) for _, t in texts])
        h, f, d, begin, n = anchors(data, ends)
        base = np.array([o for o, _ in texts], np.int64) - np.concatenate([[0], ends[:-1]])
        held.append((h, f, np.array(rids, np.int64)[d], begin + base[d], n))
        size += len(data)
        if size >= FLUSH:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _frequent(least: int):
    """(h, n) of anchors with many distinct pieces in one flush, and how many strings it has with h null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, f, _, _, n in _flushes(batches):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int(n.sum())], pa.int64())], ["h", "n"])
            h, f = h[order := np.lexsort((f, h))], f[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])]) if len(h) else np.empty(0, bool)
            values, counts = np.unique(h[new], return_counts=True)
            many = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], ["h", "n"])

    return run


def hot_anchors(rows: DataFrame, hot: int, local: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the anchors with `hot` distinct pieces or more (of those that a flush meets `local` times), and how many strings there are."""
    found = rows.mapInArrow(_frequent(local), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= hot) | F.col("h").isNull())
    top = found.orderBy(F.col("h").isNotNull(), F.desc("n"), "h").limit(MOST_HOT + 1).collect()
    return np.sort(np.array([r.h for r in top if r.h is not None], np.int64).view(np.uint64)), sum(r.n for r in top if r.h is None)


def among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, h)
    return hot[np.minimum(at, len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def _send(parts: int, hot):
    """Pieces of all documents, as one row for each part of the hash range now and then; part -1: already known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, f, rid, start, n in _flushes(batches):
            order, later = _later(h, f, rid, start)
            again, first = order[later], np.sort(order[~later])
            if len(again):
                yield _blob(-1, h[:0], f[:0], rid[again], start[again], n[again])
            route = np.where(among(h[first], hot.value), f[first], h[first])
            part = (route >> np.uint64(32)).astype(np.int64) % parts
            by_part = np.argsort(part, kind="stable")
            first, part = first[by_part], part[by_part]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = first[a:b]
                yield _blob(int(part[a]), h[at], f[at], rid[at], start[at], n[at])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[tuple[int, bytes]]]]:
    """Documents (rid, (offset, bytes)) together up to CHUNK bytes; longer ones in parts that share LENGTH - 1 bytes."""
    rids, texts, size = [], [], 0
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            for o in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH):
                part = text[o : o + CHUNK - 1]
                if size + len(part) > CHUNK:
                    yield rids, texts
                    rids, texts, size = [], [], 0
                rids.append(rid)
                texts.append((o, part))
                size += len(part)
    if rids:
        yield rids, texts


def _settle(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For whole parts, rows sorted by part: repeats (rid, run), and the first of each piece of an anchor that has several or is hot (with h)."""

    def out(rid, start, n, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start << 8 | n), h], ["rid", "run", "h"])

    for part, rows in _by_part(batches):
        h, f = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("h", "f"))
        rid, start = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("rid", "start"))
        n = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
        if part < 0:
            yield out(rid, start, n, pa.nulls(len(rid), pa.int64()))
            continue
        order, later = _later(h, f, rid, start)
        again, first = order[later], order[~later]
        yield out(rid[again], start[again], n[again], pa.nulls(len(again), pa.int64()))
        hs = h[first]
        same = hs[1:] == hs[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(first) else np.empty(0, bool)
        first = first[several | among(hs, hot)]
        yield out(rid[first], start[first], n[first], pa.array(h[first].view(np.int64)))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one part after another; those of part -1 one at a time."""
    part, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and (r["part"] != part or part < 0):
                yield part, rows
                rows = []
            part = r["part"]
            rows.append(r)
    if rows:
        yield part, rows


def _pieces(part: int, rid, start, n, data: bytes) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int32()), *(pa.array([np.asarray(x, np.int64).tobytes()], pa.binary()) for x in (rid, start, n)), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["part", "rid", "start", "n", "bytes"])


def _cut(parts: int, hot):
    """(rid, text, asked array<struct<run,h>>) -> the pieces' bytes by part; of hot anchors the strings' hashes (part from `parts` on), each once a batch, and their repeats (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, list] = {}
            strings: list[tuple] = []
            for rid, text, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                h = np.array([x["h"] for x in asked], np.int64).view(np.uint64)
                for x, k, is_hot in zip(asked, h.tolist(), among(h, hot.value).tolist(), strict=True):
                    start, n = x["run"] >> 8, x["run"] & 255
                    data = text[start : start + n - 1 + LENGTH]
                    if is_hot:
                        strings += [(hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest(), rid, start + i) for i in range(n)]
                    else:
                        held.setdefault((k >> 32) % parts, []).append((rid, start, n, data))
            for part, xs in held.items():
                yield _pieces(part, [x[0] for x in xs], [x[1] for x in xs], [x[2] for x in xs], b"".join(x[3] for x in xs))
            strings.sort()
            new = [i == 0 or strings[i][0] != strings[i - 1][0] for i in range(len(strings))]
            if again := [x for x, first in zip(strings, new, strict=True) if not first]:
                yield _pieces(-1, [x[1] for x in again], [x[2] for x in again], [1] * len(again), b"")
            by_part: dict[int, list] = {}
            for x in (x for x, first in zip(strings, new, strict=True) if first):
                by_part.setdefault(parts + int.from_bytes(x[0][:4], "little") % parts, []).append(x)
            for part, xs in by_part.items():
                yield _pieces(part, [x[1] for x in xs], [x[2] for x in xs], [1] * len(xs), b"".join(x[0] for x in xs))

    return run


def column_bwt(pieces: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes of the pieces (concatenated bytes, ends of each) in order, as places in the bytes; equal ones in order of pieces.

    Column-wise construction: the transform starts with each piece's empty suffix. Every round takes from each piece that
    goes on the symbol before its last suffix; the new suffix's rank is the count of smaller symbols plus that of the same
    symbol earlier in the transform, and the transform gets its own symbol at that rank. Only the transform and the places are kept.
    """
    starts = np.concatenate([[0], ends[:-1]])
    m = len(ends)
    live, rank = np.arange(m), np.arange(m)
    # Symbol 0 stands for the end of a piece, bytes for themselves plus 1: UTF-8 has no byte 255, so one byte holds a symbol and sorts in one pass.
    narrow = np.uint8 if not len(pieces) or pieces.max() < 255 else np.int16
    symbols = np.append(pieces.astype(narrow) + narrow(1), narrow(0))
    before = np.where(ends > starts, symbols[np.maximum(ends - 1, 0)], narrow(0))
    bwt, place = before, ends.astype(np.int64)
    depth = 0
    while len(live):
        depth += 1
        at = ends[live] - depth
        live, at, rank = live[at >= starts[live]], at[at >= starts[live]], rank[at >= starts[live]]
        if not len(live):
            break
        # Order of all symbols in the transform: a place in it is the rank among suffixes that start with its symbol.
        order = np.argsort(bwt, kind="stable")
        ends_of_pieces = len(bwt) - int(np.count_nonzero(bwt))
        going = np.zeros(len(bwt), bool)
        going[rank] = True
        hits, new = np.flatnonzero(going[order]), np.empty(len(rank), np.int64)
        new[np.argsort(rank)] = hits[np.argsort(order[hits])] - ends_of_pieces + m
        symbol = np.where(at > starts[live], symbols[np.maximum(at - 1, 0)], narrow(0))
        total = len(bwt) + len(live)
        fill = np.ones(total, bool)
        fill[new] = False
        grown, where = np.empty(total, narrow), np.empty(total, np.int64)
        grown[new], where[new] = symbol, at
        grown[fill], where[fill] = bwt, place
        bwt, place, rank = grown, where, new
    return place


def repeats(pieces: np.ndarray, ends: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For pieces in order of their place in the collection: which of their first counts[i] strings of length bytes also come in an earlier piece.

    One flag for each string, piece by piece.
    """
    order = column_bwt(pieces, ends)
    piece = np.searchsorted(ends, order, side="right")
    ok = piece < len(ends)
    order, piece = order[ok], piece[ok]
    starts = np.concatenate([[0], ends[:-1]])
    inside = order - starts[piece] < counts[piece]
    order, piece = order[inside], piece[inside]
    view = np.lib.stride_tricks.sliding_window_view(pieces, length) if len(pieces) >= length else np.empty((0, length), np.uint8)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 14):
        b = min(a + (1 << 14), len(order))
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    first = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, group, piece)
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out = np.zeros(int(counts.sum()), bool)
    out[base[piece] + order - starts[piece]] = piece > first[group]
    return out


def _compare(parts: int):
    """Repeats (rid, run) among the distinct pieces of each part, and among the strings of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            rid, start, n = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("rid", "start", "n"))
            if part < 0 or part >= parts:
                again = np.ones(len(rid), bool)
                if part >= parts:
                    digest = np.frombuffer(b"".join(r["bytes"] for r in rows), "<u8").reshape(-1, 2)
                    order = np.lexsort((start, rid, digest[:, 1], digest[:, 0]))
                    rid, start, digest = rid[order], start[order], digest[order]
                    again = np.concatenate([[False], (digest[1:] == digest[:-1]).all(axis=1)])
                yield pa.RecordBatch.from_arrays([pa.array(rid[again]), pa.array(start[again] << 8 | 1)], ["rid", "run"])
                continue
            data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
            sizes = n - 1 + LENGTH
            first = np.cumsum(sizes) - sizes
            order = np.lexsort((start, rid))
            rid, start, n, sizes, first = rid[order], start[order], n[order], sizes[order], first[order]
            ends = np.cumsum(sizes)
            data = data[np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)]
            flags = repeats(data, ends, n)
            owner = np.repeat(np.arange(len(n)), n)
            change = np.concatenate([[True], (owner[1:] != owner[:-1]) | (flags[1:] != flags[:-1])])
            at = np.flatnonzero(change)
            length = np.diff(np.concatenate([at, [len(flags)]]))
            at, length = at[flags[at]], length[flags[at]]
            begin = start[owner[at]] + at - (np.cumsum(n) - n)[owner[at]]
            yield pa.RecordBatch.from_arrays([pa.array(rid[owner[at]]), pa.array(begin << 8 | length)], ["rid", "run"])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(n_bytes: int, runs: list[int] | None, length: int = LENGTH) -> np.ndarray:
    """Which bytes the repeated strings cover; runs: first start << 8 | number of starts."""
    edges = np.zeros(n_bytes + 1, np.int32)
    runs = np.array(runs or [], np.int64)
    np.add.at(edges, runs >> 8, 1)
    np.add.at(edges, (runs >> 8) + (runs & 255) - 1 + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
            text = text.as_py()
            if not runs:
                rows.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            gone = covered(len(text), runs)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): rid unique, in the order of doc_id; doc_id itself if that is unique and never null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")


def dedup(docs: DataFrame, hot: int = HOT, local: int = LOCAL) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same document.
    Null doc_ids come first, rows that share a doc_id follow each other by text, as documents of their own; null texts are
    empty. Other columns are ignored. hot, local: see HOT and LOCAL; they move work, not results.
    """
    spark = docs.sparkSession
    rows = numbered(docs)
    found, strings = hot_anchors(rows.select("rid", "text"), hot, local)
    # A part is held by one task, so parts and tasks grow with the text.
    tasks = max(partitions(spark), -(-strings // TASK_STRINGS))
    parts, frequent = PARTS * tasks, spark.sparkContext.broadcast(found)
    spread = lambda df: df.repartition(tasks, F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.pmod(F.xxhash64("rid"), F.lit(parts)))).sortWithinPartitions("part")
    sent = rows.select("rid", "text").mapInArrow(_send(parts, frequent), SENT)
    found = stored(spread(sent).mapInArrow(lambda it: _settle(it, frequent.value), FOUND), "pieces")
    asked = found.where("h is not null").groupBy("rid").agg(F.collect_list(F.struct("run", "h")).alias("asked"))
    cut = rows.select("rid", "text").join(asked, "rid").mapInArrow(_cut(parts, frequent), PIECES)
    more = spread(cut).mapInArrow(_compare(parts), "rid long, run long")
    runs = found.where("h is null").select("rid", "run").unionByName(more).groupBy("rid").agg(F.collect_list("run").alias("runs"))
    return rows.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_remove, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
