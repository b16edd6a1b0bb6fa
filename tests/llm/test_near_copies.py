"""Near copies against brute force."""

import itertools
import random

import numpy as np
from test_operators import ids, none, odd_docs

import corpus_pipeline
from mediacat.llm import near_copies


def plain_set(text, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(seed, texts, edits):
    """(texts, near copies of them): each copy has `edits` words changed."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    first = [[rng.choice(words) for _ in range(300)] for _ in range(texts)]
    second = [list(t) for t in first]
    for k, t in enumerate(second):
        for at in rng.sample(range(300), edits[k % len(edits)]):
            t[at] = "changed"
    return [" ".join(t) for t in first], [" ".join(t) for t in second]


def kept_of(rows, least=0.8):
    """Smallest doc_id of each group, over all pairs."""
    root, sets = {i: i for i, _ in rows}, {i: plain_set(t) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(root, 2):
        if similarity(sets[a], sets[b]) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in root}


def test_stage_finds_copies_of_similarity_08(spark):
    a, b = copies(3, 60, (2, 4, 6, 20))
    rows = [*enumerate(a), *((100 + i, t) for i, t in enumerate(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_of(rows)
    assert 60 < len(want) < 90
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, None).collect()} == want


def test_large_buckets_are_dealt_as_tiles(spark):
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(120), 1 + i % 4):
            t[at] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, t) for i, t in enumerate(copies(5, 20, (1,))[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_of(rows)
    for few, tile_rows in ((16, 8192), (2, 8), (3, 25)):
        assert {r.doc_id for r in near_copies.near_dedup(docs, few=few, tile_rows=tile_rows).collect()} == want
    # Tiles of few bytes: many to a bucket.
    assert {r.doc_id for r in near_copies.near_dedup(docs, few=2, tile_bytes=2000).collect()} == want


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 30, 25).astype(np.uint64)) for _ in range(80)] + [np.empty(0, np.uint64)] * 2
    for tile in (7, 512):
        root = near_copies.forest(sets, np.zeros(len(sets), np.int8), 0.6, tile)
        plain = list(range(len(sets)))
        for _ in sets:
            for i, j in itertools.combinations(range(len(sets)), 2):
                if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6:
                    plain[i] = plain[j] = min(plain[i], plain[j])
        assert [[a == b for b in root] for a in root] == [[a == b for b in plain] for a in plain]


def test_near_copies_without_doc_id_go(spark):
    a, b = copies(7, 6, (2,))
    docs = spark.createDataFrame([(None, t) for t in a + b + a] + [(5, b[0])], "doc_id long, text string")
    got = near_copies.near_dedup(docs).collect()
    assert len(got) == 6 and [r.text for r in got if r.doc_id == 5] == [b[0]]


def test_odd_tables(spark):
    kept = near_copies.near_dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and max(ids(kept.where("doc_id is not null")).values()) == 1
    assert near_copies.near_dedup(none(spark)).count() == 0


def test_bands_reach_similarity_08():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(400):
        both, own = rng.integers(0, 2**63, 240, dtype=np.uint64), rng.integers(0, 2**63, (2, 30), dtype=np.uint64)
        one, two = (near_copies.band_keys(np.unique(np.concatenate([both, x]))) for x in own)
        met += bool((one == two).any())
    print("recall at 0.8:", met / 400)
    assert met >= 396
