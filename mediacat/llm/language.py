"""Language identification by unigram pieces, marginalised over segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public vocabulary, of
the product of the pieces' probabilities in that language (forward algorithm). Piece probabilities are fitted by
expectation-maximisation (forward-backward) on the words of a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import partitions, stored, table

VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 1500
ROUNDS = 3
SMOOTH = 0.1
CACHED = 200_000
UNKNOWN = "und"
MARK = "▁"
#: A run of letters, and of numbers that are no digits, such as those for a half or a square; and a word: letters only, whatever its length.
RUN = re.compile(r"[^\W\d_]+")
LETTERS = re.compile("[^" + "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha()) + "]+")


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Trie:
    """How many pieces there are, and a trie: piece to number, and -1 for what only starts pieces.

    The pieces are those of the public vocabulary, lower-cased.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return trie(pieces)


class Trie(tuple):
    """(how many pieces, piece to number with -1 for what only starts pieces), and the same as arrays: sorted edges (node, character) to nodes, and their pieces."""

    def __new__(cls, pieces: Iterable[str]) -> Trie:
        numbers = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        known = {p[:k]: -1 for p in numbers for k in range(1, len(p))} | numbers
        own = super().__new__(cls, (len(numbers), known))
        node = {"": 0} | {p: i for i, p in enumerate(known, 1)}
        edges = sorted((node[p[:-1]] << 21 | ord(p[-1]), node[p]) for p in known)
        own.edges = np.array([*(e for e, _ in edges), 1 << 62], np.int64)
        own.to = np.array([*(n for _, n in edges), -1], np.int64)
        own.piece = np.array([-1, *known.values()], np.int64)
        return own

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after one more character; -1 if there is none."""
        key = node << 21 | char
        at = np.searchsorted(self.edges, key)
        return np.where(self.edges[at] == key, self.to[at], -1)


def trie(pieces: Iterable[str]) -> Trie:
    return Trie(pieces)


def words_of(text: str) -> Counter:
    """The words of the whole text, lower-cased, and how often each comes."""
    found = Counter(RUN.findall(text.lower()))
    for run in [w for w in found if not w.isalpha()]:
        n = found.pop(run)
        for word in LETTERS.findall(run):
            found[word] += n
    return found


def lattice(words: list[str], pieces: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All arcs of the words' segmentations: (word, from, to, piece), sorted by "to"; and the words' lengths.

    Each word starts with the mark of a word; a character that is no piece is an arc of the unknown piece. All places of all words walk down
    the trie side by side, a character at a time.
    """
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(n)
    word = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(chars))
    node, length = pieces.step(np.zeros(len(chars), np.int64), chars), 1
    piece = np.where(node >= 0, pieces.piece[node], -1)
    arcs = [(at, np.ones(len(at), np.int64), np.where(piece >= 0, piece, pieces[0]))]
    while len(at):
        go = (node >= 0) & (at + length < ends[word[at]])
        at, node = at[go], node[go]
        node = pieces.step(node, chars[at + length])
        length += 1
        piece = np.where(node >= 0, pieces.piece[node], -1)
        hit = piece >= 0
        arcs.append((at[hit], np.full(int(hit.sum()), length), piece[hit]))
    at, size, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
    w = word[at]
    i = at - (ends - n)[w]
    order = np.lexsort((i, w, i + size))
    return w[order], i[order], (i + size)[order], piece[order], n


def _slices(to: np.ndarray) -> list[slice]:
    edges = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def forward(words: list[str], pieces: Trie, logp: np.ndarray) -> np.ndarray:
    """(word, language): log of the word's probability, over all segmentations. logp: (piece, language), unknown piece last."""
    out = np.empty((len(words), logp.shape[1]))
    by_length = sorted(range(len(words)), key=lambda w: len(words[w]))
    at = 0
    while at < len(words):  # words of like length together, bounded in characters
        part, total = [], 0
        while at < len(words) and (not part or (total := total + len(words[by_length[at]])) < 40_000):
            part.append(by_length[at])
            at += 1
        out[part] = _forward(lattice([words[w] for w in part], pieces), logp)[0]
    return out


def _forward(arcs: tuple, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the words, and of all their places."""
    w, i, j, p, n = arcs
    base = np.concatenate([[0], np.cumsum(n + 1)])
    alpha = np.full((base[-1], logp.shape[1]), -np.inf)
    alpha[base[:-1]] = 0
    for s in _slices(j):
        to = base[w[s]] + j[s]
        terms = alpha[base[w[s]] + i[s]] + logp[p[s]]
        order = np.argsort(to, kind="stable")
        to, terms = to[order], terms[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        alpha[to[first]] = np.logaddexp.reduceat(terms, first, axis=0)
    return alpha[base[1:] - 1], alpha


def expected(words: list[str], counts: np.ndarray, pieces: Trie, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each so many times, in one language (forward-backward)."""
    found = np.zeros(pieces[0] + 1)
    for at in range(0, len(words), 4000):
        part, times = words[at : at + 4000], counts[at : at + 4000]
        arcs = lattice(part, pieces)
        w, i, j, p, n = arcs
        total, alpha = _forward(arcs, logp)
        back = np.concatenate([w[::-1, None], n[w[::-1], None] - j[::-1, None], n[w[::-1], None] - i[::-1, None], p[::-1, None]], axis=1)
        back = back[np.argsort(back[:, 2], kind="stable")]
        beta = _forward((back[:, 0], back[:, 1], back[:, 2], back[:, 3], n), logp)[1]
        base = np.concatenate([[0], np.cumsum(n + 1)])
        post = np.exp(alpha[base[w] + i, 0] + logp[p, 0] + beta[base[w] + n[w] - j, 0] - total[w, 0])
        np.add.at(found, p, post * times[w])
    return found


def fit(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities (piece, language)) from (doc_id, text, lang) rows.

    About `sample` documents of each language are taken (all, if fewer), by a hash of doc_id; their words are counted, and
    the rounds of expectation-maximisation run over the distinct words on the executors. Rows with null text or lang don't count.
    """
    spark = labelled.sparkSession
    pieces = vocabulary(path)[0]
    known = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / (1 << 30)).alias("u"))
    sizes = known.groupBy("lang").count()
    some = known.join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("count") < sample).select("lang", "text")  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = some.repartition(partitions(spark)).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words.repartition(partitions(spark)), "lang-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((pieces + 1, 0))
    logp = np.full((pieces + 1, len(langs)), -np.log(pieces + 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp.astype(np.float32))

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            found = {}
            for b in batches:
                for lang, part in b.groupby("lang"):
                    k = langs.index(lang)
                    one = expected(part["word"].tolist(), part["n"].to_numpy(), vocabulary(path), shared.value[:, k : k + 1].astype(np.float64))
                    found[k] = found.get(k, 0) + one
            for k, one in found.items():
                at = np.flatnonzero(one)
                yield pd.DataFrame({"k": k, "piece": at, "n": one[at]})

        sums = words.mapInPandas(step, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each piece and language
        n = np.full((pieces + 1, len(langs)), SMOOTH)
        n[sums["piece"], sums["k"]] += sums["n"]
        logp = np.log(n / n.sum(axis=0))
        shared.destroy()
    return langs, logp


class Scorer:
    """Log likelihoods of whole texts; words that came lately are looked up."""

    def __init__(self, langs: list[str], logp: np.ndarray, path: str | None):
        self.langs, self.logp, self.pieces, self.seen = langs, logp, vocabulary(path), {}

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts = [words_of(t or "") for t in texts]
        seen = self.seen
        if len(seen) > CACHED:
            seen.clear()
        if new := list(dict.fromkeys(w for c in counts for w in c if w not in seen)):
            seen.update(zip(new, forward(new, self.pieces, self.logp).astype(np.float32), strict=True))
        langs, scores = [], []
        for c in counts:
            if not c or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.array(list(c.values()), np.float64) @ np.array([seen[w] for w in c], np.float64)
            p = np.exp(total - total.max())
            langs.append(self.langs[int(total.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """docs with lang_pred and score (the language's posterior, 0 to 1); und and 0 for a null text, one without letters, or no language learned.

    Of languages with one probability the first in code-point order is taken. Only the text is looked at. Columns of docs that have these two names already are replaced.
    """
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float32)))

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value[0], shared.value[1].astype(np.float64), path)
        for texts in batches:
            parts = [scorer.score(texts.iloc[k : k + 256].tolist()) for k in range(0, len(texts), 256)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    rows = docs.withColumn("__found", found(F.col("text").cast("string")))
    kept = (F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score"))
    return rows.select(*kept, "__found.lang_pred", "__found.score")


def with_fold(docs: DataFrame) -> DataFrame:
    """docs with held_out (in place of a column of that name): whether crc32 of doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """docs whose language is found with at least this score; all their columns as they were.

    Null texts and texts without letters go. Rows are judged each for itself, so rows that repeat stay or go together; an empty table stays empty, and
    without a learned language nothing stays.
    """
    kept = identify(docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}).withColumn("text", F.col("c_text")), model)
    kept = kept.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(f"`c_{c}`").alias(c) for c in docs.columns))
