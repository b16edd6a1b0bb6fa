"""Near copies take their candidates from SimHash bands and the tile kernel."""

import itertools

import numpy as np
import xxhash
from test_near_copies import copies
from test_operators import ids

from mediacat.llm import near_copies


def test_fingerprint_is_the_majority_of_bits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 255, 256, 700):
        shingles = rng.integers(0, 2**63, n, dtype=np.uint64)
        for w, got in enumerate(near_copies.fingerprint(shingles, 3).tolist()):
            ones = [0] * 64
            for s in shingles.tolist():
                x = (s * int(near_copies.MULTIPLY[w]) + int(near_copies.ADD[w])) % 2**64
                x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 % 2**64
                x ^= x >> 29
                ones = [o + (x >> i & 1) for i, o in enumerate(ones)]
            assert got == sum((2 * o > n) << i for i, o in enumerate(ones))
    assert not near_copies.fingerprint(np.empty(0, np.uint64)).any()


def test_bands_in_sql_equal_band_keys(spark):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(5)]
    for rows in (1, 5_000_000, 15_000_000):
        bits, words = near_copies.layout(rows)
        found = [near_copies.fingerprint(s, words).view(np.int64).tolist() for s in sets]
        nodes = spark.createDataFrame([(bytes([i]), f, 320) for i, f in enumerate(found)], "node binary, words array<long>, size long")
        got = {(bytes(r.node), r.key) for r in near_copies.bands(nodes, bits).collect()}
        assert got == {(bytes([i]), k) for i, s in enumerate(sets) for k in near_copies.band_keys(s, words, bits).tolist()}


def test_candidates_equal_all_pairs():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, (20, 3), dtype=np.uint64)[rng.integers(0, 20, 300)].T.copy()
    fp[0] ^= np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64)
    key, size, side = np.sort(rng.integers(0, 9, 300)), rng.integers(50, 100, 300), rng.integers(0, 3, 300).astype(np.int8)
    for sides in (np.zeros(300, np.int8), np.where(side == 0, 1, side)):
        plain = list(range(300))
        for _ in range(3):
            for i, j in itertools.combinations(range(300), 2):
                near = sum(int(fp[w, i] ^ fp[w, j]).bit_count() for w in range(3)) <= near_copies.RADIUS
                if near and key[i] == key[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and (sides[i] != sides[j] or sides[i] == 0):
                    plain[i] = plain[j] = min(plain[i], plain[j])
        while plain != [plain[p] for p in plain]:
            plain = [plain[p] for p in plain]
        for tile in (5, 256):
            root = near_copies.candidates(fp, key, size, sides, 0.8, tile)
            assert [[a == b for b in root] for a in root] == [[a == b for b in plain] for a in plain]


def test_every_copy_comes_through_the_tile_kernel(spark, monkeypatch):
    a, b = copies(7, 6, (1,))
    nodes = [(xxhash.xxh128_digest(t), near_copies.fingerprint(s := near_copies.shingle_set(t)).view(np.int64).tolist(), 8 * len(s)) for t in a + b]
    nodes = spark.createDataFrame(nodes, "node binary, words array<long>, size long")
    rows = [bytes(r.node) for r in near_copies.candidate_groups(nodes).collect()]
    assert sorted(rows) == sorted(bytes(r.node) for r in nodes.collect())  # groups of two, each once however many bands they share
    cells = [np.array(c) for c in zip(*((r.key, r.size, r.w0, r.w1, r.w2) for r in near_copies.bands(nodes).collect()), strict=True)]
    fp, side = np.stack(cells[2:]).view(np.uint64), np.zeros(len(cells[0]), np.int8)
    assert (near_copies.candidates(fp, cells[0], cells[1], side) != np.arange(len(side))).any()
    monkeypatch.setattr(near_copies, "compare", lambda x, y: np.zeros((x.shape[1], y.shape[1]), bool))
    assert (near_copies.candidates(fp, cells[0], cells[1], side) == np.arange(len(side))).all()


def test_copies_of_few_words_meet(spark):
    """Five of four and of five shingles: the least alike bits of all texts of similarity 0.8."""
    words = [[f"w{k}x{i}" for i in range(9)] for k in range(300)]
    docs = spark.createDataFrame([row for k, w in enumerate(words) for row in ((k, " ".join(w[:8])), (1000 + k, " ".join(w)))], "doc_id long, text string")
    assert set(ids(near_copies.near_dedup(docs))) == set(range(300))
