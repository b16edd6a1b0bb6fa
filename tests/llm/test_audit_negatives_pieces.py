"""Source divergence, hard negatives and sentence pieces against SQL, brute force and the library; and on odd tables."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediacat.llm import divergence, hard_negatives, pieces, queries, whole

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, p long, zero long, ids long, term string"
VECTORS = "vec_id long, embedding array<double>, label int, leaf int, v string"


def docs(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "dé", "x", "naïve", "日本", "ÄÖ"]) + rng.choice(["", "s", "1", "-t"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(90, None, "en", "z"), (91, "", "fr", "only"), (92, "one two", "fr", "both"), (93, "12 !! 34", None, None), (94, "w " * 30_000 + "y" * 50_000, "en", "a"), (94, "Alpha", "en", "a"), (None, "Alpha beta", "en", "b")]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "t") for r in rows], DOCS)


# 11
def plain_audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        count[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        own = {g[1]: c for g, c in count.items() if g[0] == lang}
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in own.items()}
        n = sum(total.values())
        q = {t: 1 + 10**9 * (sum(c[t] for c in own.values()) + 1) // (n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            tell = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(tell)[:200])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_audit_equals_plain_version(spark):
    df = docs(spark)
    want = plain_audit([(r.text, r.lang, r.source) for r in df.collect()])
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(df.limit(0)).collect() == []


def test_audit_with_a_hot_source_and_many_blocks(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'abcdefghij'[w % 10]}{chr(97 + w // 10 % 26)}{chr(97 + w // 260)}" for w in (int(rng.paretovariate(0.6)) % 2000 for _ in range(80))), "en", "hot" if i % 3 else f"s{i % 9}", 1, 2, 3, 4, "t") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit([(r[1], r[2], r[3]) for r in rows])


def test_shares_beyond_a_long(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 5)], "n long, total long, v long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17 + 5)


def test_joint_cells_are_bitmaps(spark):
    counts = spark.createDataFrame([("en", s, f"t{t}", n, 10 * n, 1, 100 - t) for s, t, n in (("a", 1, 2), ("a", 2, 2), ("a", 70, 2), ("b", 1, 5))], "lang string, source string, term string, n long, p long, zero long, total long")
    rows = {(r.source, r.n): r.bits for r in divergence.bitmaps(counts).collect()}
    assert sum(b.bit_count() for b in rows["a", 2]) == 3 and sum(b.bit_count() for b in rows["b", 5]) == 1


# 12
def plain_negatives(rows):
    part = []
    for i, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256.0 * x)) for x in e]))
    out, last = [], lambda i: float("inf") if i is None else i
    for i, label, v in part:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), j, lab) for j, lab, w in part if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for s, _, j, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, r, x[2], -s, -x[0]) for r, x in enumerate(fit, 1)]
    clamp = lambda n: max(whole.LEAST, min(whole.MOST, n))
    return sorted(((a, b, c, d, clamp(e), clamp(f)) for a, b, c, d, e, f in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "v") for i, e, label in rows], VECTORS)


def negatives(df, **more):
    rows = hard_negatives.labelled(df)
    return sorted(map(tuple, hard_negatives.mine(rows, rows.where(f"vec_id <> {whole.NAMELESS} and vec_id % 100 = 0"), **more).collect()), key=repr)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 6))
    x[::5] = x[5]  # a fifth of all rows are one vector
    rows = [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(3000)]
    rows += [(3000, [float("nan")] * 6, 1), (3001, None, 1), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3003, [0.5] * 6, None), (3100, [0.0] * 6, 2), (3200, [-1.0] * 6, 3), (None, x[0].tolist(), 1), (3300, [1.0, 2.0], 1), (3301, [1.0, 2.0], 1), (3302, [1.0, 1.9], 2), (3400, [], 1)]
    df = vectors(spark, rows)
    want = plain_negatives(rows)
    assert negatives(df) == want
    assert negatives(df, block=7) == want  # many blocks
    monkeypatch.setattr(hard_negatives, "HELD", 100)
    assert negatives(df) == want
    assert negatives(df.limit(0)) == []


def test_negatives_of_any_size(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1e16, 1.0], 1), (2, [1e16, 2.0], 1), (3, [9e15, 1.0], 2), (4, [9e15, 2.0], 2), (100, [1e200, 1.0], 1), (5, [1e199, 5.0], 1), (6, [1e199, 4.0], 3), (8, [0.5, 0.5], 1), (9, [0.45, 0.5], 2), (10, [1e300, 1.0], 3)]
    assert negatives(vectors(spark, rows)) == plain_negatives(rows)


def test_tree_leaves_out_what_can_hold_nothing(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 8))))
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, v array<double>")
    file, tree = hard_negatives.build(rows)
    leaf = {r.vec_id: r.leaf for r in file.collect()}
    assert len(leaf) == 4000 and len(set(leaf.values())) > 30
    scores = x[:50] @ x.T
    high = np.sort(scores, axis=1)[:, -2:-1]
    low = 0.95 * high
    reach = tree.reach(x[:50], low, high)
    for i in range(50):
        assert all(reach[i, leaf[j]] for j in np.flatnonzero((scores[i] >= low[i]) & (scores[i] <= high[i])).tolist())
    assert reach.mean() < 0.5


@pytest.mark.parametrize("n", [0, 5, -5, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**300, -(10**300), 2**64])
def test_sort_keys_come_back(n):
    assert whole.from_key(*whole.sort_key(n)) == n


def test_sort_keys_sort():
    numbers = sorted([0, 1, -1, 2**63, 2**63 + 1, 2**70, 10**300, -(2**63) - 1, -(2**70), -(10**300), 255 * 2**64, 2**72])
    keys = [(b, k or b"", s) for b, k, s in map(whole.sort_key, numbers)]
    assert keys == sorted(keys)


def test_scaled_is_floor(spark):
    x = [0.5, -0.3, -1e-9, -1e-300, 1e30, -2.0, 1e16 + 2, 0.0, -0.0, 1 / 256]
    df = spark.createDataFrame([(x,), ([float("inf")],), ([1e307],), (None,), ([None],), ([],)], "e array<double>")
    got = [r[0] for r in df.select(whole.scaled(F.col("e"), 256)).collect()]
    assert got[0] == [float(np.floor(256 * c)) for c in x] and got[1:] == [None, None, None, None, []]


# 13
ODD = ["a", "b", "e", "t", "h", " ", "  ", "▁", "1", "2", "é", "😀", "\n", "\t", "\0", "　", "x", "ing", "the", " the", "</s>", "<s>", "<unk>", "<0x0A>", "你", "好", "​", "�", "'", ".", "A", " ", "\r"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.model_path())


def encoded(own, texts):
    ids, counts = own.encode(pa.array(texts))
    return ids, counts, [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("kind", ["odd", "letters", "runs", "blanks", "pieces", "characters", "long"])
def test_pieces_equal_the_library(own, library, kind):
    rng = random.Random(kind)
    some = {
        "odd": lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(40))), "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(60))), "runs": lambda: "".join(rng.choice("aab") for _ in range(rng.randrange(60))),
        "pieces": lambda: "".join(rng.choice(names) for _ in range(rng.randrange(12))), "characters": lambda: "".join(chr(rng.choice([rng.randrange(1, 0x2000), rng.randrange(0x3000, 0xA000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(30))),
    }
    names = list(own.normal)
    if kind == "blanks":
        texts = [" " * n + w for n in range(70) for w in ("", "a", "the", "1", "😀", " é", "\n")]
    elif kind == "long":
        texts = [" " * 20_000 + "x" * 20_000, "word " * 20_000, "ab" * 5000, "".join(rng.choice("abcdefghij") for _ in range(5000)), ""]
    else:
        texts = [some[kind]() for _ in range(4000)]
    ids, counts, got = encoded(own, texts)
    want = library.encode(texts, num_threads=1)
    assert got == want
    assert [t.decode() for t in own.decode(ids, counts)] == library.decode(want)


def test_any_ids_are_decoded_as_the_library_does(own, library):
    rng = random.Random(3)
    lists = [[rng.randrange(own.size) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(14))] for _ in range(5000)]
    got = own.decode(np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert [t.decode() for t in got] == library.decode(lists)


def test_what_a_worker_remembers_changes_nothing(library):
    texts = ["the cat sat on the mat", "a b c d e f g", "the dog", "z" * 100] * 3
    small = pieces.Pieces(pieces.model_path(), cached=2)
    for t in texts:
        assert encoded(small, [t])[2] == library.encode([t])


def test_piece_columns(spark, library, monkeypatch):
    df = docs(spark)
    rows = {(r.doc_id, r.text): r for r in pieces.encode(df).collect()}
    assert Counter(r.ids is None for r in rows.values()) == {False: len(rows)}
    for (_, text), r in rows.items():
        assert r.ids == library.encode(text or "")
    back = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert pieces.encode(df.limit(0)).collect() == [] and pieces.decode(spark.createDataFrame([(None,), ([None, 5],)], "ids array<int>")).collect()[0].decoded is None
    monkeypatch.setattr(pieces, "BATCH_BYTES", 50)  # many slices; workers that live already keep theirs
    for r in pieces.digests(df).collect():
        assert len(r.ids_sha256) == 64


def test_piece_digests(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op13_merge_rounds"](spark, DATA).collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = library.encode(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_count_bitmaps", "op12_gnat"])
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    r = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(r.fetchall())


# 10
def test_words_are_letters_only():
    from mediacat.llm import language

    assert language.words_of("x² ½ ① 12 ab_c Ⅳ 一二 é٣") == {"x": 1, "ab": 1, "c": 1, "一二": 1, "é": 1}
    long = "ab" * 2000
    assert language.words_of(long) == {long: 1}
    for w in language.words_of("²½ naïve straße 日本語 ⑨z x́"):
        assert w.isalpha()


def test_all_pieces_of_the_vocabulary_count():
    import sentencepiece

    from mediacat.llm import language

    vocabulary = language.vocabulary()
    n, known = vocabulary
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    names = {model.id_to_piece(i).lower() for i in range(259, model.get_piece_size())}
    assert n == len(names) and names == {p for p, i in known.items() if i >= 0}
    logp = np.full((n + 1, 1), -np.log(n + 1))
    words = ["responsibilities", "ab" * 3000]
    found = language.forward(words, vocabulary, logp)
    for w, got in zip(words, found[:, 0], strict=True):  # the sum over all segmentations, plainly
        s, total = "▁" + w, [0.0]
        for j in range(1, len(s) + 1):
            arcs = [total[i] + logp[0, 0] for i in range(max(0, j - 20), j) if j - i == 1 or known.get(s[i:j], -1) >= 0]
            total.append(np.logaddexp.reduce(arcs))
        assert abs(total[-1] - got) < 1e-6 * abs(total[-1])


# 3
def test_expectation_maximisation_equals_the_plain_one(spark):
    import math

    from mediacat.llm import pii

    rng = random.Random(2)
    rows = [(no, *(rng.choice([-1, 0, 1]) if rng.random() < 0.4 else (1 if i % 3 else -1) for _ in range(3)), rng.randrange(3), rng.randrange(3), rng.randrange(2)) for no in (4, 5) for i in range(400)]
    names = ("no", *pii.VOTES, *pii.SHAPE)

    def ratios(y, cols):
        out = {}
        for no in (4, 5):
            for c in cols:
                at, sums = names.index(c), {}
                for r, p in zip(rows, y, strict=True):
                    if r[0] == no:
                        s = sums.setdefault(r[at], [1.0, 1.0])
                        s[0] += p
                        s[1] += 1 - p
                yes, no_ = (sum(s[k] for s in sums.values()) for k in (0, 1))
                out |= {(no, c, v): math.log(s[0] / yes) - math.log(s[1] / no_) for v, s in sums.items()}
                if c == cols[0]:
                    out[no, "prior"] = math.log(yes / no_)
        return out

    y = [1 / (1 + math.exp(1 - 2 * sum(r[1:4]))) for r in rows]
    for _ in range(pii.ROUNDS):
        known = ratios(y, pii.VOTES)
        y = [1 / (1 + math.exp(-known[r[0], "prior"] - sum(known[r[0], c, r[names.index(c)]] for c in pii.VOTES))) for r in rows]
    want = ratios(y, (*pii.VOTES, *pii.SHAPE))
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).select(F.array(F.struct(*names)).alias("spans"))
    got = pii.train(df)
    assert {k: round(v, 9) for k, v in got.items()} == {":".join(map(str, k)): round(v, 9) for k, v in want.items()}
