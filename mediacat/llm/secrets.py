"""Secret scans: patterns of known secrets, and strings that a tokenizer can't compress.

Words come out of a public vocabulary at several characters a token, random strings at two or fewer. Runs of key-like
characters whose ratio is low are reported too, unless they look like known digests or identifiers, or lack letters or
digits altogether: names in code without a digit code as badly as random letters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_RATIO = 2.2
LEAST = 20
LONGEST_CODED = 4096
KINDS = ("assign", "access", "hex", "random")

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Digests of usual lengths, UUIDs, numbers, and one character or a short group over and over.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|(?:sha(?:1|256|384|512)|md5)[-=_].*|(?:urn=|uuid=)?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+|(.{1,8}?)\1{2,}.{0,7})\Z", re.S)
LETTERS_AND_DIGITS = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)


@lru_cache(maxsize=2)
def _encoding(path: str | None):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(path or public.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(run: str, path: str | None = None) -> float:
    """Characters a token; a long run is coded in pieces, all of it."""
    encoding = _encoding(path)
    tokens = sum(len(encoding.encode_ordinary(run[i : i + LONGEST_CODED])) for i in range(0, len(run), LONGEST_CODED))
    return len(run) / tokens


def spans(text: str | None, most_ratio: float = MOST_RATIO, path: str | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets of the whole text, by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = list(RUN.finditer(text))
    if any(m.end() - m.start() >= 32 for m in runs):  # else there's no long hex run either
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    taken = sorted((a, b) for a, _, b in found)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in runs:
        a, b, run = m.start(), m.end(), m.group()
        before = bisect_left(begins, b)  # spans that begin before the run ends; the farthest of them
        if not (before and reach[before - 1] > a) and LETTERS_AND_DIGITS.match(run) and not KNOWN.match(run) and ratio(run, path) <= most_ratio:
            found.append((a, 3, b))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def scan(docs: DataFrame, most_ratio: float = MOST_RATIO, path: str | None = None) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, digest of the base spans, all spans, and n_random.

    A null or empty text has no spans (the digest is that of an empty string). Rows keep their doc_id, null or repeated;
    other columns are ignored. most_ratio: characters a token, at or below which a run counts as random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = spans(text.as_py(), most_ratio, path)
                n = [sum(k == kind for _, k, _ in found) for kind in KINDS]
                base = joined([x for x in found if x[1] != KINDS[3]])
                rows.append((name, *n[:3], hashlib.sha256(base.encode()).hexdigest(), joined(found), n[3]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
