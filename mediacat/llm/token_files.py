"""Token-id output: documents in doc_id or stored order, tokenized, packed by Simple-8b into block files, and read back.

A file (one part of a Parquet folder, binary columns uncompressed) is a shard: a range of the order. A row is a group of
whole documents: their ids and lengths, the words, the escapes, and the offsets of each block of ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from re import escape, finditer
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import simple8b
from mediacat.llm.common import partitions, shared_dir, stored, table

VOCABULARY = "byte_bpe_50k.json"
END = 0
GROUP_IDS = 1 << 18
#: Bytes of text coded at once, characters of new pieces given to the tokenizer at once, and how many of them to a string.
BATCH_BYTES, NEW_BYTES, TOGETHER = 1 << 23, 1 << 20, 32
#: Pieces that a worker remembers, of at most LONGEST bytes each.
CACHED, LONGEST = 1_500_000, 64
#: What a UTF-8 byte is part of: a letter, digit, ASCII punctuation, apostrophe, space, other ASCII white space, or unknown.
LETTER, DIGIT, POINT, QUOTE, BLANK, BREAK, UNKNOWN = range(7)
KINDS = np.full(256, UNKNOWN, np.uint8)
for kind, of in ((POINT, range(33, 127)), (LETTER, (*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, 0xD0, 0xD1)), (DIGIT, range(48, 58)), (QUOTE, b"'"), (BLANK, b" "), (BREAK, b"\t\n\r")):
    KINDS[list(of)] = kind
#: Neighbours that the tokenizer never joins: different kinds of visible characters but for the apostrophe, and what comes before white space.
APART = np.zeros((8, 8), bool)
APART[:3, :3] = ~np.eye(3, dtype=bool)
APART[:4, BLANK : BREAK + 1] = True
APART = APART.reshape(-1)
#: First bytes of the characters beyond ASCII that some engine takes for white space.
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3, 0xEF])

FILE = "shard int, row long, doc_ids array<long>, lengths array<long>, words binary, escapes binary, starts array<long>"
DOCS = "shard int, row long, place int, doc_id long, n_tokens long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes of the UTF-8 text begin a piece: the tokenizer never joins across its edge, whatever stands around."""
    out = np.zeros(len(data), bool)
    if len(data) < 4:
        return out
    kind = KINDS[data]
    two = np.flatnonzero((data == 0xC3) | (data == 0xC4) | (data == 0xC5) | (data == 0xD0) | (data == 0xD1))
    kind[two + 1] = LETTER  # but for the two signs among the letters
    signs = two[(data[two] == 0xC3) & ((data[two + 1] == 0x97) | (data[two + 1] == 0xB7))]
    kind[signs] = kind[signs + 1] = UNKNOWN
    out[1:] = APART[kind[:-1] << 3 | kind[1:]]
    # A single line break or tab stands alone.
    at = np.flatnonzero(kind[1:-1] == BREAK) + 1
    out[at[(kind[at - 1] < BLANK) & (kind[at + 1] < BLANK)] + 1] = True
    # Other characters beyond ASCII end before a space, unless they may be white space themselves.
    at = np.flatnonzero((kind[3:] == BLANK) & (kind[2:-1] == UNKNOWN)) + 3
    last, second, third = data[at - 1], data[at - 2], data[at - 3]
    maybe = (second == 0xC2) | LEADS[third] & (second >= 0x80) & (second < 0xC0)
    out[at[(last >= 0x80) & ~maybe]] = True
    return out


class Encoder:
    """The tokenizer's ids of whole texts. Pieces between spaces are looked up first; their ids lie in one flat array."""

    def __init__(self, path: str, cached: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of its name stands for each
        for name, i in vocabulary.items():
            self.width[i] = len(name)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.pieces = 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Pieces at the end of the flat array, which doubles when it is full."""
        at, n = int(self.starts[self.pieces]), len(lengths)
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.pieces + n >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[at : at + len(ids)] = ids
        self.starts[self.pieces + 1 : self.pieces + n + 1] = at + np.cumsum(lengths)
        self.pieces += n

    def _one_by_one(self, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._add(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _learn(self, pieces: list[str]) -> None:
        """New pieces that begin with their only space, some to a string: which ids belong to which follows from their bytes."""
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        lines = ["".join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.array([i for x in ids for i in x], np.int64)
        ends, wanted = np.cumsum(self.width[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, wanted)
        if len(ids) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            self._add(ids.astype(np.uint32), np.diff(last + 1, prepend=0))
        else:
            self._one_by_one(pieces)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces in the flat array; new ones are tokenized, long ones not remembered."""
        found = list(map(self.slot.get, pieces))
        together, alone, size = [], [], 0
        new = [i for i, s in enumerate(found) if s is None]
        for i in new:
            p = pieces[i]
            if p[0] != " " or not (p[-1].isalnum() or p[-1] in punctuation) or "<|" in p:
                alone.append(i)
                continue
            together.append(i)
            size += len(p)
            if size >= NEW_BYTES:
                self._number(together, pieces, found, self._learn)
                together, size = [], 0
        self._number(together, pieces, found, self._learn)
        self._number(alone, pieces, found, self._one_by_one)
        self.slot.update((p, found[i]) for i in new if len(p := pieces[i]) <= LONGEST)
        return np.array(found, np.int64)

    def _number(self, at: list[int], pieces: list[str], found: list, learn) -> None:
        first = self.pieces
        if at:
            learn([pieces[i] for i in at])
        for k, i in enumerate(at):
            found[i] = first + k

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many are each one's); texts without nulls. end: an id behind each text."""
        if len(self.slot) > self.cached or self.pieces > 2 * self.cached:
            self.forget()
        texts = texts.cast(pa.large_string())
        n, (_, offsets, data) = len(texts), texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
        base = int(offsets[0]) if n else 0
        data = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None and n else np.empty(0, np.uint8)
        begins = np.append(cuts(data), True)
        for token in self.special:  # these stay whole
            for at in finditer(escape(token), data):
                begins[at.start() + 1 : at.end()] = False
        begins[offsets - base] = True
        edges = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        slots, words = self._slots(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        ends = np.searchsorted(edges, offsets[1:] - base)  # words up to each text's end
        if end is not None:
            self._add(np.array([end], np.uint32), np.ones(1, np.int64))
            slots, words = np.append(slots, self.pieces - 1), np.insert(words, ends, len(slots))
            ends = ends + np.arange(1, n + 1)
        first = self.starts[slots]
        count = (self.starts[slots + 1] - first)[words]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(first[words] - total[:-1], count)]
        return ids, np.diff(total[ends], prepend=0)


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One for each Python worker, which keeps it for its next tasks."""
    return Encoder(path, cached)


def _pack(shard: int, row: int, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    words, escapes, starts, _ = simple8b.encode(ids)
    cols = [[shard], [row], [doc_ids], [lengths.tolist()], [words.astype("<u8").tobytes()], [escapes.astype("<u4").tobytes()], [starts.tolist()]]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "row", "doc_ids", "lengths", "words", "escapes", "starts"])


def stored_order() -> list[Column]:
    """The order of rows of a Parquet folder that Spark wrote in order: its part's number, then the place in the file."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, "^part-([0-9]+)", 1).cast("int"), name, F.col("_metadata.row_index")]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts (null: empty) of about BATCH_BYTES at a time, over the batches' edges."""
    names, texts, size = [], [], 0
    for b in batches:
        column = pc.fill_null(b.column(1).cast(pa.large_string()), "")
        at = 0
        while at < b.num_rows:
            offsets = np.frombuffer(column.buffers()[1], np.int64, b.num_rows + 1, column.offset * 8)
            stop = min(b.num_rows, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES - size, "right")))
            stop = max(stop, at + 1)
            names += b.column(0).slice(at, stop - at).to_pylist()
            texts.append(column.slice(at, stop - at))
            size += int(offsets[stop] - offsets[at])
            at = stop
            if size >= BATCH_BYTES or at < b.num_rows:
                yield names, pa.concat_arrays(texts)
                names, texts, size = [], [], 0
    if names:
        yield names, pa.concat_arrays(texts)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, cached: int = CACHED, order: list[Column] | None = None) -> str:
    """Write the ids of docs, each document followed by the end id, in ascending doc_id order (nulls first) to folder.

    Null texts are empty documents. Rows that share a doc_id follow each other, ordered by text; with an order, its columns
    alone place the rows. Other columns are ignored.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = encoder(path, cached), TaskContext.get().partitionId()
        names, ids, lengths, row = [], np.empty(0, np.uint32), np.empty(0, np.int64), 0
        for doc_ids, texts in _bounded(batches):
            more, n = coder.encode(texts, end)
            names, ids, lengths = names + doc_ids, np.concatenate([ids, more]), np.concatenate([lengths, n])
            ends, done = np.cumsum(lengths), 0
            while done < len(ends) and ends[-1] - (before := ends[done - 1] if done else 0) >= GROUP_IDS:
                stop = int(np.searchsorted(ends, before + GROUP_IDS)) + 1
                yield _pack(shard, row, names[done:stop], ids[before : ends[stop - 1]], lengths[done:stop])
                done, row = stop, row + 1
            if done:
                names, ids, lengths = names[done:], ids[ends[done - 1] :], lengths[done:]
        if names:
            yield _pack(shard, row, names, ids, lengths)

    keys = [f"__order{i}" for i in range(len(order or ()))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(k) for c, k in zip(order or (), keys, strict=True)))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *(keys or ["doc_id"])).sortWithinPartitions(*(keys or ["doc_id", "text"]))
    rows.mapInArrow(run, FILE).write.option("compression", "none").parquet(folder)
    return folder


def read_ids(folder_df: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>): the documents of write_tokens()'s files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, names, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return folder_df.mapInArrow(run, "doc_id long, ids array<long>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[np.ndarray]]]:
    for b in batches:
        for r in b.to_pylist():
            words, escapes = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u4")
            ids = simple8b.decode(words, escapes, sum(r["lengths"]), np.array(r["starts"]))
            yield r["shard"], r["row"], r["doc_ids"], np.split(ids, np.cumsum(r["lengths"])[:-1])


def read_summary(folder_df: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, row, names, ids in _documents(batches):
            n = len(names)
            cols = [pa.array([shard] * n, pa.int32()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "row", "place", "doc_id", "n_tokens", "ids_crc32"])

    docs = stored(folder_df.mapInArrow(run, DOCS), "token-docs")
    # Starts: sums over rows of files (one for each 2**18 ids at least), then over the documents of a row.
    totals = folder_df.select("shard", "row", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    shards = totals.groupBy("shard").agg(F.sum("total").alias("total"))
    before = shards.select("shard", F.expr("sum(total) over (order by shard) - total").alias("base"))
    rows = totals.join(before, "shard").select("shard", "row", F.expr("base + sum(total) over (partition by shard order by row) - total").alias("base"))
    placed = docs.join(rows, ["shard", "row"])
    return placed.select("doc_id", F.expr("base + sum(n_tokens) over (partition by shard, row order by place) - n_tokens").alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str | None = None, end: int = END, cached: int = CACHED, order: list[Column] | None = None) -> DataFrame:
    """Tokenize and write docs, then read the files back: doc_id, start, n_tokens, ids_crc32, one row per row of docs.

    An empty table gives no rows; a null or empty text has the end id alone. cached: pieces a worker remembers; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    folder = write_tokens(docs, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}", vocabulary, end, cached, order)
    return read_summary(spark.read.schema(FILE).parquet(folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
