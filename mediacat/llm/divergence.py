"""Divergence of sources within a language, from bitmaps of terms by how often they occur.

Terms of a language are numbered by falling frequency, so that neighbours have few different counts, and cut into blocks of
64 x WORDS. Each (group, count) of a block is a bitset of terms. An AND and a count of bits gives how many terms two
groups have at each pair of counts; that times the pair's value, summed over blocks, is the divergence. Terms that a
group lacks are never listed: their cells follow by complement from the groups' histograms of counts. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.llm.common import row_numbers, stored, table

LEAST_DOCS = 3
UNIT = 1_000_000_000
RANKS = 200
#: A block has this many words of 64 terms; a tile of levels is compared with all others at once.
WORDS, TILE = 4, 256
#: Bytes of text whose terms are counted together in a task.
BATCH_BYTES = 1 << 23
#: What a byte is part of, in lower case: a letter, or a byte of a character beyond ASCII; 32 is between terms.
LOWER = np.full(256, 32, np.uint8)
LOWER[65:91] = LOWER[97:123] = range(97, 123)
LOWER[128:] = range(128, 256)

COUNTS = "lang string, source string, term string, n long, docs long"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about BATCH_BYTES of text, over the batches' edges."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
            if size >= BATCH_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each portion of rows (lang, source, text)."""
    for t in _batches(batches):
        texts = t.column(2).combine_chunks().cast(pa.large_string())
        n, (_, offsets, data) = len(texts), texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        data, offsets = LOWER[raw], offsets - offsets[0]
        inside = data != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][np.diff(offsets) > 0]
        begins[at] = inside[at]  # terms never cross rows
        first = np.flatnonzero(begins)
        if not len(first):
            continue
        # Each term with what follows it, so that no byte is moved, and without it again; then the distinct ones.
        edges = np.append(first, len(data))
        terms = pc.ascii_rtrim(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(data)]), " ")
        coded = terms.dictionary_encode()
        groups = pa.StructArray.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks()], ["lang", "source"])
        keys: dict[tuple, int] = {}
        group = np.array([keys.setdefault((r["lang"], r["source"]), len(keys)) for r in groups.to_pylist()], np.int64)
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(first, offsets)))
        word, m = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        by_doc = np.sort(row * m + word)
        new = np.diff(by_doc, prepend=-1) > 0
        times = np.diff(np.append(np.flatnonzero(new), len(by_doc)))
        one = by_doc[new]
        key = group[one // m] * m + one % m
        found, inverse = np.unique(key, return_inverse=True)
        total, docs = np.zeros(len(found), np.int64), np.bincount(inverse, minlength=len(found))
        np.add.at(total, inverse, times)
        names = list(keys)
        of = (found // m).tolist()
        columns = [pa.array([names[g][0] for g in of], pa.string()), pa.array([names[g][1] for g in of], pa.string()), coded.dictionary.take(pa.array(found % m)).cast(pa.string()), pa.array(total), pa.array(docs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many rows each group has a term. Nulls are empty strings."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms))


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _joint(t: pa.Table) -> pa.Table:
    """(lang, source, item, value) of one block: what pairs of groups gain over cells with a zero, in terms that both have.

    In: lang, block, source, n, p, zero (the group's p of 0), bits array<long> of WORDS.
    """
    t = t.sort_by("source")
    source = t.column("source").combine_chunks().dictionary_encode()
    of = source.indices.to_numpy()
    p, zero = t.column("p").to_numpy(), t.column("zero").to_numpy()
    bits = np.array(t.column("bits").to_pylist(), np.int64).view(np.uint64).reshape(len(of), -1)
    sums = np.zeros((len(source.dictionary), len(source.dictionary)), np.int64)

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for at in range(0, len(of), TILE):
        rows = slice(at, at + TILE)
        joint = np.zeros((len(of[rows]), len(of)), np.int64)
        for w in range(bits.shape[1]):
            joint += np.bitwise_count(bits[rows, w][:, None] & bits[None, :, w])
        i, j = np.nonzero(joint)
        other = of[i + at] != of[j]
        i, j = i[other], j[other]
        a, b, a0, b0 = p[i + at], p[j], zero[i + at], zero[j]
        np.add.at(sums, (of[i + at], of[j]), joint[i, j] * (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)))
    names = source.dictionary.to_pylist()
    g, h = np.nonzero(sums)
    lang = t.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": pa.array([names[x] for x in g], pa.string()), "item": pa.array([names[x] for x in h], pa.string()), "value": pa.array(sums[g, h], pa.int64())})


def bitmaps(counts: DataFrame, words: int = WORDS) -> DataFrame:
    """(lang, block, source, n, p, zero, bits): the terms of a block that a group has n times, as bits.

    counts: (lang, source, term, n, p, zero, total), total a term's occurrences in the language.
    """
    terms = counts.select("lang", "term", (-F.col("total")).alias("rare")).distinct()
    numbered = stored(row_numbers(terms, ["lang", "rare", "term"], "id"), "divergence-terms").select("lang", "term", (F.col("id") - 1).alias("id"))
    placed = counts.join(numbered, ["lang", "term"])
    size = 64 * words
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    word = [F.bit_or(F.when(F.col("id") % size >= 64 * w, F.when(F.col("id") % size < 64 * w + 64, bit))).alias(f"w{w}") for w in range(words)]
    sets = placed.groupBy("lang", F.expr(f"id div {size}").alias("block"), "source", "n", "p", "zero").agg(*word)
    return sets.select("lang", "block", "source", "n", "p", "zero", F.array(*(F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(words))).alias("bits"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from each other one, and its most telling terms.

    docs: lang, source, text; other columns are ignored. Null lang, source and text are empty strings, rows that repeat count each time, an empty table gives
    no rows. A language without a term in least_docs of its rows has pairs of value 0. Values are longs; shares stay within 10^9 and
    counts may be any. Groups and terms of one value are ranked by their UTF-8 bytes.
    """
    groups = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counted = stored(term_counts(docs), "divergence-counts")
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = stored(of_lang.where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    counts = stored(counted.drop("docs").join(kept, ["lang", "term"]), "divergence-own")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero_long = F.lit(0).cast("long")
    group = groups.join(sums, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", *(F.coalesce(c, zero_long).alias(c) for c in ("group_n", "v", "lang_n")))
    group = stored(group.withColumn("zero", F.when(F.col("v") > 0, share(zero_long, F.col("group_n"), F.col("v"))).otherwise(1)), "divergence-groups")
    shared = counts.join(group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    own = stored(shared.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).drop("group_n", "v", "lang_n"), "divergence-shares")

    telling = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    # Each ordered pair of groups: all terms as if both lacked them, what each one's own terms add, and what joint ones do.
    left = group.select("lang", "source", "zero", "v")
    right = group.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    pairs = left.join(right, "lang").where("source <> item")
    none = value(F.col("zero"), F.col("item_zero"))
    empty = pairs.select("lang", "source", "item", (F.col("v") * none).alias("value"))
    levels = stored(own.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "divergence-levels")
    mine = pairs.join(levels, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (value(F.col("p"), F.col("item_zero")) - none)).alias("value"))
    theirs = pairs.join(levels.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("terms") * (value(F.col("zero"), F.col("p")) - none)).alias("value"))
    joint = bitmaps(own.select("lang", "source", "term", "n", "p", "zero", "total")).groupBy("lang", "block").applyInArrow(_joint, "lang string, source string, item string, value long")
    apart = empty.unionByName(mine).unionByName(theirs).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return apart.unionByName(telling)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), o AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p,
         1 + (1000000000 * (k.total + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
