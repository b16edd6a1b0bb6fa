"""The corpus pipeline against a plain version of all its stages."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_operators import odd_docs

import corpus_pipeline
from mediacat.llm import decontaminate, token_files
from mediacat.llm.common import stored

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def firsts(docs):
    """The documents of the smallest doc_id of each group linked by similarities of 0.8 and more."""
    sets, root = [shingles(d["text"]) for d in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d["doc_id"]), d["doc_id"])
    return [d for d in docs if d["doc_id"] in best.values()]


def plain(docs, items):
    docs = firsts([d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")])

    def leaks(text):
        have = decontaminate.shingles(decontaminate.words(text))
        for t in items:
            q, a = (decontaminate.shingles(p) for p in decontaminate.parts(decontaminate.words(t), t))
            if len(q & have) >= 0.8 * len(q) and len(a & have) >= 0.8 * len(a):
                return True
        return False

    docs = [d for d in docs if not leaks(d["text"])]
    words = lambda d: re.findall(r"[^\x20\x09-\x0D]+", d["text"])
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    names = sorted(by, key=lambda s: (s is None, s))
    size = {s: sum(len(words(d)) for d in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, left = {}, set(names)
    while True:
        share = {s: (sum(size.values()) - sum(goal.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            break
        goal |= {s: 3.0 * size[s] for s in over}
        left -= over
    goal |= share
    out = []
    for s in names:
        rest = int(round(goal[s], 6))
        order = sorted(by[s], key=lambda d: (hashlib.md5(f"{d["doc_id"]}:{hashlib.md5(d["text"].encode()).hexdigest()}".encode()).hexdigest(), d["doc_id"]))
        while rest > 0:
            for d in order:
                if rest > 0 and (n := len(words(d))):  # the last document comes whole
                    out.append((d["doc_id"], d["text"]))
                    rest -= min(rest, n)
    return out


def test_run_equals_the_plain_version(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_files.vocabulary_path())
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = Counter()
    for doc_id, text in plain(rows, items):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)  # training order


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns


def test_stages_on_an_odd_table(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, a map column: every stage keeps the columns, and drops what it must."""
    docs = odd_docs(spark).withColumn("lang_pred", F.col("doc_id").cast("string")).withColumn("extra", F.create_map(F.lit("a"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, DATA), "odd")
        assert kept.columns == docs.columns and kept.count() > 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, stored(docs, "odd"), DATA)
    assert last.count() == docs.count()
