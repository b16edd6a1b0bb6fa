"""Benchmark decontamination: BM25 over test items by block-max WAND, then a check of question and answer.

The items are the indexed collection, every passage of every training document is a query. A term's weight in an item is
its BM25 impact divided by the item's own total, so a score is the share of the item (0 to 1) that the passage covers
and one threshold serves all items. Postings carry their largest impact by blocks of items. Items come in portions of bounded
size, each broadcast in turn, whatever the size of the benchmark; document frequencies count all items. How long passages are
hangs on the item's own length alone, so neither other items nor the portions change what is found.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table

THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items that share a block maximum: few, as items are long queries' worth of terms and bounds of many add up to anything.
BLOCK = 4
#: Items of at most SPAN words, of at most GROWTH times that, and so on, are searched with passages of twice as many words.
SPAN, GROWTH = 64, 4
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts(item: list[str], text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: the last sentence answers, or the last third if that leaves either under SHINGLE words."""
    sentences = [words(s) for s in SENTENCE.split(text.strip())]
    answer = len(sentences[-1])
    if answer < SHINGLE or len(item) - answer < SHINGLE:
        answer = max(1, len(item) // 3)
    return item[: len(item) - answer], item[len(item) - answer :]


def span_of(n: int) -> int:
    """Half the length of the passages that an item of n words is searched with."""
    span = SPAN
    while span < n:
        span *= GROWTH
    return span


def shingles(w: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def shingle_hashes(terms: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `width` term numbers; of fewer, one of the whole."""
    n = min(width, len(terms))
    if not n:
        return np.empty(0, np.uint64)
    x = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.full(len(terms) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ x[k : len(terms) - n + 1 + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    return h


class Index:
    """Inverted index of items of one span: flat postings by term, and the largest impact of each term in each block of items that has it.

    Its size goes with the postings (a term in an item): 12 bytes each, as much for the block maxima, 8 for each shingle.
    """

    def __init__(self, items: list[tuple], df: dict[str, int], n: int, mean: float):
        """items: (item_id, text); df, n and mean (length in words): of all items, in this block or not."""
        self.ids, self.term, self.span = [], {}, 0
        terms, docs, impacts = array("i"), array("i"), array("d")
        self.question, self.answer = [], []
        for name, text in items:
            if not (w := words(text)):
                continue
            tf, d = Counter(w), len(self.ids)
            own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            total = sum(own.values())
            terms.extend(self.term.setdefault(t, len(self.term)) for t in own)
            docs.extend([d] * len(own))
            impacts.extend(x / total for x in own.values())
            self.ids.append(name)
            self.span = max(self.span, span_of(len(w)))
            for held, part in zip((self.question, self.answer), parts(w, text), strict=True):
                held.append(np.unique(shingle_hashes(np.array([self.term[x] for x in part], np.int64))))
        term = np.frombuffer(terms, np.int32) if terms else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")
        edges = np.arange(len(self.term) + 1)
        item, x = np.array(docs, np.int32)[order], np.array(impacts, np.float64)[order]
        first = np.searchsorted(term[order], edges)  # of each term's postings
        block = item // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(term[order]) != 0)])) if len(block) else np.empty(0, np.int64)
        self.block, self.block_max = block[new], np.maximum.reduceat(x, new) if len(new) else np.empty(0)
        self.first_block = np.searchsorted(term[order][new], edges)
        self.blocks = np.diff(self.first_block)
        self.top = np.append(np.maximum.reduceat(x, first[:-1]) if len(self.term) else np.empty(0), 0.0)
        self.docs, self.impact, self.ends, self.tops = array("i", item.tobytes()), array("d", x.tobytes()), first.tolist(), self.top.tolist()

    def find(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items (number, score) that score the threshold or more against the terms (distinct).

        The block maxima of the terms add up to a bound for every block of items; lists jump over the blocks whose bound is too
        low, and within the others to the first item where the terms' largest impacts add up to the threshold.
        """
        least, found = threshold - 1e-9, []
        if not len(terms):
            return found
        count = self.blocks[terms]
        at = np.repeat(self.first_block[terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
        bound = np.bincount(self.block[at], self.block_max[at])
        live = np.flatnonzero(bound >= least).tolist()
        if not live:
            return found
        docs, impact, ends, top, reach = self.docs, self.impact, self.ends, self.tops, set(live)
        lists = []  # current item, term, place in its postings
        for t in terms.tolist():
            at = bisect_left(docs, live[0] * BLOCK, ends[t], ends[t + 1])
            if at < ends[t + 1]:
                lists.append((docs[at], t, at))
        while lists:
            lists.sort()
            reached, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(lists):
                reached += top[t]
                if reached >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = lists[pivot][0]
            if d // BLOCK in reach:
                to, score = d + 1, 0.0
                for now, t, at in lists:
                    if now > d:
                        break
                    at = bisect_left(docs, d, at, ends[t + 1])
                    if at < ends[t + 1] and docs[at] == d:
                        score += impact[at]
                if score >= least:
                    found.append((d, min(1.0, score)))
            else:
                to = next((k * BLOCK for k in live if k * BLOCK > d), None)
                if to is None:
                    break
            if to // BLOCK not in reach:
                to = next((k * BLOCK for k in live if k * BLOCK > to), None)
                if to is None:
                    break
            moved = []
            for x in lists:
                if x[0] < to:
                    end = ends[x[1] + 1]
                    at = bisect_left(docs, to, x[2], end)
                    if at == end:
                        continue
                    x = (docs[at], x[1], at)
                moved.append(x)
            lists = moved
        return found

    def hits(self, w: list[str], threshold: float, overlap: float) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap) of the items that the whole text (its words) leaks, best passage each.

        Passages are two spans long and one apart, so each item fits into one.
        """
        none = len(self.term)
        numbers = list(map(self.term.get, w, repeat(none)))
        terms = np.array(numbers, np.int64)
        if not len(w) or terms.min() == none:
            return []
        # Passages whose terms' largest impacts can't reach the threshold need no search.
        sums = np.concatenate([[0.0], np.cumsum(self.top[terms])])
        step = self.span
        starts = np.arange(0, max(1, len(w) - step), step)
        ends = np.minimum(starts + 2 * step, len(w))
        found: dict[int, tuple] = {}
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if sums[b] - sums[a] < threshold - 1e-9:
                continue
            here = set(numbers[a:b])
            here.discard(none)
            have = None
            for d, score in self.find(np.fromiter(here, np.int64, len(here)), threshold):
                have = shingle_hashes(terms[a:b]) if have is None else have
                q, x = (np.isin(s, have).mean() if len(s) else 0.0 for s in (self.question[d], self.answer[d]))
                if q >= overlap and x >= overlap:
                    found[d] = max(found.get(d, (0.0,)), (score, float(q), float(x)))
        return [(self.ids[d], *x) for d, x in sorted(found.items())]


def indexes(items: list[tuple], df: dict[str, int], n: int, mean: float) -> list[Index]:
    """An index of each span's items."""
    by_span: dict[int, list[tuple]] = {}
    for name, text in items:
        by_span.setdefault(span_of(len(words(text))), []).append((name, text))
    return [Index(by_span[s], df, n, mean) for s in sorted(by_span)]


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items, read one block of bounded size at a time."""
    numbered = items.withColumn("size", F.length("text")).repartitionByRange(max(1, -(-items.count() // BLOCK_ITEMS)), "item_id", "text")
    block, chars = [], 0
    for r in numbered.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + r.size > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += r.size
    if block:
        yield block


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(words, b.column(1).to_pylist()), pa.list_(pa.string()))], ["item_id", "text", "w"])


FOUND = "item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item that a document holds.

    A passage must score `threshold` or more of the item's own BM25 total, and hold `overlap` or more of the 5-word shingles
    of its question and of its answer (an item or part of fewer words is one shingle). What one item finds doesn't depend on the others but for its
    terms' weights, nor on how items fall into portions. Null or wordless texts and items
    match nothing; an empty table gives no rows. Rows that share a doc_id are each searched; equal (item_id, text) rows of the
    benchmark count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(items.mapInArrow(_tokenize, "item_id long, text string, w array<string>"), "items")
    n, mean = tokens.where("size(w) > 0").agg(F.count("*"), F.avg(F.size("w"))).first()
    frequency = stored(tokens.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count(), "item-terms")
    found = []
    for block in _blocks(tokens) if n else ():
        own = {x for _, t in block for x in words(t)}
        vocabulary = spark.createDataFrame([(x,) for x in own or {""}], "t string")  # of one block
        df = {r.t: r["count"] for r in frequency.join(F.broadcast(vocabulary), "t").collect()}
        shared = spark.sparkContext.broadcast(indexes(block, df, n, mean))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    w = words(text.as_py())
                    out += [(name, *hit) for index in shared.value for hit in index.hits(w, threshold, overlap)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        # One portion after another: its hits are written before the next is broadcast.
        found.append(stored(rows.mapInArrow(run, f"doc_id long, {FOUND}"), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"doc_id long, {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that leak an item; all their columns as they were.

    Rows that share a doc_id go together; rows without a doc_id are kept, as nothing can name them.
    """
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
