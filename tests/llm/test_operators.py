"""The training-data operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import itertools
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mediacat.llm import curriculum, decontaminate, importance, language, near_copies, pii, queries, secrets, simhash, simple8b, suffix_dedup, token_files, va_file

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, score double, target double, w array<string>, item_id long, spans string, rid long"
LONG = "word " * 30_000 + "x" * 150_000


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with names that the operators use."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("the of and to in that it is was for on are as with his they at be this".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))
    texts = [prose(rng.randrange(5, 80)) for _ in range(12)]
    rows = [(i, texts[i % 12], "en", f"s{i % 3}") for i in range(20)]
    rows += [(20, None, "en", "s0"), (21, "", None, None), (22, " \n\t ", "de", "s1"), (23, LONG, "de", None), (24, "12345 67 !!", "en", "s9"), (None, texts[0], None, None), (None, None, None, None), (3, texts[3], "en", "s0"), (3, texts[4], "en", "s0"), (25, "é" * 50 + " 😀 naïve", "fr", "s2"), (26, "der und die das ist nicht ein zu " * 9, "de", "s2")]
    return spark.createDataFrame([(*r, None, 1, 2, 3.0, 4.0, ["a"], 5, "b", 6) for r in rows], SCHEMA)


def none(spark):
    return odd_docs(spark).limit(0)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


# 1
def test_wand_equals_full_scoring():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30)))) for i in range(90)]
    df = Counter(w for _, t in items for w in set(decontaminate.words(t)))
    index = decontaminate.Index(items, df, len(items), 15.0)
    for threshold in (0.2, 0.4, 0.7):
        for _ in range(60):
            terms = sorted({index.term[w] for w in rng.sample(vocabulary, 25) if w in index.term})
            want = Counter()
            for t in terms:
                for at in range(index.ends[t], index.ends[t + 1]):
                    want[index.docs[at]] += index.impact[at]
            got = dict(index.find(np.array(terms), threshold))
            assert set(got) == {d for d, x in want.items() if x >= threshold - 1e-9}
            assert all(abs(got[d] - min(1, want[d])) < 1e-9 for d in got)


def test_index_of_a_full_portion_stays_small():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40_000, 60))) for i in range(decontaminate.BLOCK_ITEMS)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, df, len(items), 60.0)
    assert len(pickle.dumps(index)) < 64e6
    assert [d for d, *_ in index.hits(("a b " + items[77][1] + " c").split(), 0.6, 0.8)] == [77]


def plain_leaks(text, items, threshold, overlap):
    """Item ids that the text leaks, by the definition."""
    ws = {i: decontaminate.words(t) for i, t in items if decontaminate.words(t)}
    df, n, mean = Counter(x for w in ws.values() for x in set(w)), len(ws), sum(map(len, ws.values())) / len(ws)
    out = set()
    w = decontaminate.words(text)
    for span in (4, 16, 64):
        for a in range(0, max(1, len(w) - span), span):
            passage = w[a : a + 2 * span]
            have = decontaminate.shingles(passage)
            for i, t in items:
                if i not in ws or not span // 4 < max(len(ws[i]), 2) <= span:
                    continue
                tf = Counter(ws[i])
                own = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws[i]) / mean)) for x, c in tf.items()}
                q, x = (decontaminate.shingles(part) for part in decontaminate.parts(ws[i], t))
                share = lambda s: len(s & have) / len(s) if s else 0
                if sum(v for k, v in own.items() if k in set(passage)) / sum(own.values()) >= threshold and share(q) >= overlap and share(x) >= overlap:
                    out.add(i)
    return out


def test_leaks_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SPAN", 4)  # items of this test in three spans
    rng = random.Random(9)
    words = [f"t{i}" for i in range(40)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(1, 25))) + rng.choice(["", ". " + " ".join(prose(6))])) for i in range(50)] + [(60, ""), (61, None)]
    docs = []
    for i in range(150):
        t = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):  # a passage, more or less changed
            own = (items[rng.randrange(50)][1]).split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randrange(len(t) + 1)
            t[at:at] = own
        docs.append((i, " ".join(t)))
    for threshold, overlap in ((0.6, 0.8), (0.3, 0.5)):
        want = {(i, x) for i, t in docs for x in plain_leaks(t, items, threshold, overlap)}
        df = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold, overlap)
        assert {(r.doc_id, r.item_id) for r in df.collect()} == want and len(want) > 30
    # Portions, and long items beside, change nothing but weights.
    d, b = spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(d, b).collect())
    one = found()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert found() == one and one


def test_a_long_item_doesnt_hide_a_short_one(spark):
    rng = random.Random(12)
    some = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    short, long = some(20), some(800)
    text = some(70) + " " + " ".join(short.split()[:18]) + " " + some(70)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    alone = decontaminate.leaks(docs, spark.createDataFrame([(1, short)], "item_id long, text string")).count()
    both = decontaminate.leaks(docs, spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")).count()
    assert alone == both


def test_leaks(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 50)))) for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    planted = {(i, i % 30) for i in range(0, 60, 4)}
    docs = [(i, t[:400] + " " + items[i % 30][1] + " " + t[400:]) if (i, i % 30) in planted else (i, t) for i, t in docs]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (40, None), (41, ""), (0, items[0][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == planted
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in planted}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0
    kept = decontaminate.decontaminate(odd_docs(spark), b)
    assert ids(kept) == ids(odd_docs(spark)) and kept.columns == odd_docs(spark).columns


# 2
def base_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 32]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(found)]


def test_secrets(spark):
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", "abcdefgh1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, " ", "é", "😀", "\n", "ſecret=abcdefgh12"]
    texts = [None, "", LONG] + ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(500)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base_secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert got[i].n_assign == sum(k == "assign" for _, k, _ in want)
    assert "random" in secrets.joined(secrets.spans("key kD9x7QpZ3vL8sT2mW5yR1aB6 end"))
    for plain in ("internationalisationalism", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "aaaa1aaaa1aaaa1aaaa1aaaa1"):
        assert "random" not in secrets.joined(secrets.spans(plain))
    assert ids(secrets.scan(odd_docs(spark))) == ids(odd_docs(spark)) and secrets.scan(none(spark)).count() == 0


def test_many_secrets_in_one_text():
    text = " ".join(f"token={i:08}abc kD9x7QpZ3vL8sT2mW5yR1aB{i}" for i in range(4000))
    secrets.spans(text[:100])
    began = time.process_time()
    found = secrets.spans(text)
    assert time.process_time() - began < 3 and sum(k == "assign" for _, k, _ in found) == sum(k == "random" for _, k, _ in found) == 4000


# 3
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    found = []
    for no, (k, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            luhn = sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 14 <= len(digits) <= 19 and luhn or k == "phone" and 10 <= len(digits) <= 15:
                found.append((m.start(), no, m.end()))
    return [(a, list(PII)[k], b) for a, k, b in sorted(found)]


def test_pii(spark):
    rng = random.Random(5)
    bits = [*"ab1234567890..-- @@++()_%é😀\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "a.b@c.de", "James Smith", "call "]
    texts = [None, "", "7" * 3000, "a@" + "b." * 2000, "x_" * 3000 + "@"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(800)]
    df = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        want = base_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in PII]
        assert {f"{k}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(","))
    texts = ["".join(f"a{i}@b.de James Smith Peter {i} " for i in range(n)) for n in (3, 20_000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 150 and got[1].n_email == 20_000 and got[1].spans.startswith(got[0].spans[:60])
    sums = spark.createDataFrame([(list(range(1500)),)], "x array<long>").select(pii.running(F.col("x"))).first()[0]
    assert sums == list(itertools.accumulate(range(1500)))
    assert ids(pii.scan(odd_docs(spark))) == ids(odd_docs(spark)) and pii.scan(none(spark)).count() == 0


# 4
def test_importance(spark):
    good, bad = "the cat sat on a mat and it was warm", "zzq $$$ ### qqx !!! zzq"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f" n{i}") for i in range(200)] + [(None, None), (500, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels, keep=0.5).collect()
    assert len(got) == 202 and sum(r.selected for r in got) == 101
    assert sum(bool(r.selected and r.doc_id is not None and r.doc_id % 2) for r in got) >= 97  # the noise may draw a few others
    ratios = importance.log_ratios(docs, labels)
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i in range(200):
        one = np.bincount(importance.grams((good if i % 2 else bad) + f" n{i}"), minlength=importance.BUCKETS)
        raw += one
        target += one * (i < 100 and i % 2)
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    keys = sorted((r.sample_key for r in got), reverse=True)
    df = importance.resample(docs, labels)
    assert [importance.kth_largest(df, "sample_key", k) for k in (1, 50, 202, 203)] == [keys[0], keys[49], keys[201], None]
    assert ids(importance.resample(odd_docs(spark), labels)) == ids(odd_docs(spark)) and importance.resample(none(spark), labels).count() == 0


# 5
def test_mix(spark):
    rows = curriculum.mix(odd_docs(spark)).select("doc_id", "source", "__mix.*").collect()
    assert Counter(r.doc_id for r in rows) == ids(odd_docs(spark))
    by, goal = defaultdict(int), {}
    for r in rows:
        by[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
    for s, t in goal.items():
        assert by[s] == int(t)
    sizes = {r.source: r.source_size for r in rows}
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-3 and all(goal[s] <= 3 * sizes[s] + 1e-6 for s in goal)
    copies = curriculum.mixed_copies(odd_docs(spark))
    words = copies.groupBy("source").agg(F.sum(curriculum.n_words(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: n for s, n in by.items() if n} and copies.columns == odd_docs(spark).columns
    assert curriculum.mix(none(spark)).count() == 0 and curriculum.mixed_copies(none(spark)).count() == 0


def test_mix_leaves_columns_of_any_name_and_spreads_rows_without_ids(spark):
    rows = [(None, f"w{i} x y", "s", i, "k", 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key long, __size string, ___p int")
    got = curriculum.mix(docs).collect()
    assert sorted((r.text, r["__key"], r["__size"], r["___p"]) for r in got) == sorted((t, k, z, p) for _, t, _, k, z, p in rows)
    key = F.md5(F.concat_ws(":", F.lit("null"), F.md5("text")))
    assert docs.groupBy(F.substring(key, 1, 3)).count().agg(F.max("count")).first()[0] < 10
    kept = curriculum.mixed_copies(docs)
    assert kept.columns == docs.columns and {r["__key"] for r in kept.collect()} <= set(range(3000))


def test_targets_reshare_the_excess(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 1), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in curriculum.targets(s).collect()}
    want, weight, total = {}, dict(zip("abcd", (1, 2, 3, 1), strict=True)) | {None: 2}, 1021.0
    cap, left = {"a": 3000, "b": 30, "c": 30, "d": 0, None: 3}, set(weight)
    while True:
        share = {k: (total - sum(want.values())) * weight[k] / sum(weight[x] for x in left) for k in left}
        over = {k for k in left if share[k] > cap[k]}
        if not over:
            break
        want |= {k: float(cap[k]) for k in over}
        left -= over
    assert got == pytest.approx(want | share)


# 6
def plain_search(rows):
    known = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for a, (i, e) in enumerate(known):
        if i is not None and i % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), j is None, j) for b, (j, f) in enumerate(known) if b != a and len(f) == len(e))[:5]
            yield from ((i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, _, j) in enumerate(near))


def test_search(spark):
    nan, rng = float("nan"), np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(300)]
    rows += [(300, None), (350, [nan, 1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (450, [0.5, 0.5]), (None, [1.0] * 4), (50, rows[50][1]), (500, []), (501, []), (550, [3.0, None, 1.0, 1.0]), (600, [float("inf")] * 4)]
    want = sorted(plain_search(rows), key=repr)
    v = va_file.quantised(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, v int, cid int"))
    for block in (4096, 3):
        assert sorted(map(tuple, va_file.search(v, v.where("vec_id % 50 = 0"), 5, block).collect()), key=repr) == want
    assert va_file.search(v.limit(0), v.limit(0)).count() == 0


def test_search_beyond_longs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 10.0 ** rng.integers(-3, 12), 3)]) for i in range(200)]
    rows += [(200, [1e15, 0.0, 0.0]), (201, [1e16, 0.0, 0.0]), (250, [1.0, 0.0, 0.0]), (202, [1e35, 1.0, 0.0]), (203, [1e35, -1e30, 2.0])]  # far beyond a long
    v = va_file.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, va_file.search(v, v.where("vec_id % 50 = 0")).collect()), key=repr) == sorted(plain_search(rows), key=repr)


# 7
def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n, top in itertools.product((0, 1, 5, 1023, 1024, 1025, 6000), (1, 2, 100, 32766, 32767, 50257, 2**32 - 1)):
        x = rng.integers(0, top, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
        x[rng.random(n) < 0.3] = 0
        words, escapes, starts, _ = simple8b.encode(x)
        assert (simple8b.decode(words, escapes, n, starts) == x).all()


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(token_files.vocabulary_path()), random.Random(6)
    coder = token_files.encoder(token_files.vocabulary_path())
    alphabet = [*"ab1      bcd \n\t\r'.,é日\x1c\x85　​\x0b'", "'s", "<|endoftext|>", "  ", "ÿ", "×", "Ж", "ñ", "😀", "-", "(", "À", "3", "٣", "ʼ", "ﬁ", "क"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for known in (10**6, 50):  # with few pieces remembered, all are forgotten now and then
        coder = token_files.Encoder(token_files.vocabulary_path(), known)
        for at in range(0, 4000, 500):
            ids_, n = coder.encode(pa.array(texts[at : at + 500]))
            for t, got in zip(texts[at : at + 500], np.split(ids_, np.cumsum(n)[:-1]), strict=True):
                assert own.encode(t, add_special_tokens=False).ids == got.tolist(), repr(t)


def test_token_files(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_files.vocabulary_path())
    rows = sorted(((r.doc_id, r.text) for r in odd_docs(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(token_files.token_output(odd_docs(spark)).collect(), key=lambda r: r.start)
    at = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids_ = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (doc_id, at, len(ids_), zlib.crc32(ids_.tobytes()))
        at += len(ids_)
    assert token_files.token_output(none(spark)).count() == 0


# 8
def removed(rows, length=100):
    seen, out = set(), {}
    for rid, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            else:
                seen.add(b[i : i + length])
        out[rid] = (len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_column_bwt_sorts_all_suffixes():
    rng = random.Random(0)
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
        ends = np.cumsum([len(p) for p in parts])
        want = sorted((p[o:], i, int(e) - len(p) + o) for i, (p, e) in enumerate(zip(parts, ends, strict=True)) for o in range(len(p) + 1))
        assert suffix_dedup.column_bwt(np.frombuffer(b"".join(parts), np.uint8), ends).tolist() == [w[2] for w in want]


def test_pieces_are_told_apart():
    texts = [bytes(random.Random(i % 40).choices(b"ab \xc3\xa9", k=300 + i % 40)) for i in range(60)]
    h, f, d, start, n = suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    begins = np.cumsum([0] + [len(t) for t in texts])
    assert {i: int(n[d == i].sum()) for i in range(60)} == {i: len(t) - 99 for i, t in enumerate(texts)}
    piece = [texts[i][s - begins[i] : s - begins[i] + k + 99] for i, s, k in zip(d, start, n)]
    of = {}
    for key, p in zip(zip(h.tolist(), f.tolist()), piece):
        assert of.setdefault(key, p) == p
    assert len(of) == len(set(piece)) < len(piece)


def test_suffix_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randrange(5)):
            a = rng.randrange(300)
            t += rng.choice(base)[a : a + rng.randrange(60, 300)] + rng.choice(["é", "", "ab" * rng.randrange(150)])
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "x" * 300), (203, "xy" * 700), (204, "".join(rng.choice("klmnop") for _ in range(300_000)) + base[0])]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == removed(rows)
    hot = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=3, local=1)
    assert {r.doc_id: tuple(r)[1:] for r in hot.collect()} == got
    assert ids(suffix_dedup.dedup(odd_docs(spark))) == ids(odd_docs(spark)) and suffix_dedup.dedup(none(spark)).count() == 0


# 9
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(rows):
    """Smallest doc_id reached from each row, over links of 3 or fewer bits."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fp = [slow_fingerprint(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return sorted((repr(d), f"{fp[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def test_simhash(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(60)]
    rows += [(100 + i, t.replace(t.split()[k % 70], "zz", 1)) for k, (i, t) in enumerate(rows[:40])] + [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == linked(rows)
    fps = simhash.fingerprints(df)
    assert sorted(simhash.classes(fps, 3, 4).collect()) == sorted(simhash.classes(fps, 3).collect())
    kept = simhash.near_dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and max(ids(kept.where("doc_id is not null")).values()) == 1
    assert simhash.near_duplicates(none(spark)).count() == 0 and simhash.near_dedup(none(spark)).count() == 0


def test_tiles_equal_all_pairs():
    rng = np.random.default_rng(3)
    fp = np.concatenate([rng.integers(0, 2**63, 40, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64))])
    for (radius, tile), key in itertools.product(((0, 8), (3, 8), (10, 512)), (np.zeros(100, np.int64), np.sort(rng.integers(0, 30, 100)))):
        root = simhash.tiles(fp, key, np.zeros(len(fp), np.int8), radius, tile)
        for i, j in itertools.combinations(range(len(fp)), 2):
            if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                assert root[i] == root[j]
        assert (key[root] == key).all()
        sides = np.tile([1, 2], 50).astype(np.int8)
        root = simhash.tiles(fp, key, sides, radius, tile)
        for i, j in itertools.combinations(range(len(fp)), 2):
            if key[i] == key[j] and sides[i] != sides[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                assert root[i] == root[j]


def test_every_bucket_goes_through_the_tiles(monkeypatch):
    """Buckets of two rows too: what the tile kernel doesn't link stays alone."""
    key = np.repeat(np.arange(50), 2)
    fp = np.repeat(np.arange(50, dtype=np.uint64) << np.uint64(8), 2) ^ np.tile([0, 1], 50).astype(np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(np.zeros(100, np.int8))], ["key", "fp", "side"])
    assert sum(b.num_rows for b in simhash._groups(iter([batch]), 3)) == 50
    monkeypatch.setattr(simhash, "compare", lambda x, y, radius: np.zeros((len(x), len(y)), bool))
    assert sum(b.num_rows for b in simhash._groups(iter([batch]), 3)) == 0


def test_near_dedup_keeps_map_columns(spark):
    docs = odd_docs(spark).withColumn("extra", F.create_map(F.lit("a"), F.col("doc_id")))
    for how in (simhash.near_dedup, near_copies.near_dedup):
        kept = how(docs)
        assert kept.columns == docs.columns and kept.schema["extra"].dataType == docs.schema["extra"].dataType and 0 < kept.count() < docs.count()


# 10
def test_forward_sums_all_segmentations():
    trie = language.trie(["▁", "a", "b", "ab", "▁a", "ba"])
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(7), 2).T)
    known = trie[1]

    def total(s, k):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, len(s) + 1):
            p = known.get(s[:n], -1)
            if p >= 0 or n == 1:
                out += np.exp(logp[p if p >= 0 else 6, k]) * total(s[n:], k)
        return out

    words = ["abba", "a", "bab", "aqb", "bbbbb"]
    got = language.forward(words, trie, logp)
    assert np.allclose(got, [[np.log(total("▁" + w, k)) for k in (0, 1)] for w in words])


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_on_odd_tables(spark):
    model = language.fit(odd_docs(spark))
    found = {r.doc_id: r for r in language.identify(odd_docs(spark).select("doc_id", "text"), model).collect()}
    assert [found[i].lang_pred for i in (20, 21, 22, 24)] == ["und"] * 4 and found[26].lang_pred == "de"
    assert language.identify(odd_docs(spark).withColumn("lang_pred", F.lit(1)), model).where("lang_pred = 'de'").count() > 0
    kept = language.known_language(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and 26 in ids(kept) and 24 not in ids(kept)
    assert language.fit(none(spark))[0] == [] and language.known_language(none(spark), model).count() == 0
    assert language.identify(odd_docs(spark).select("doc_id", "text"), language.fit(none(spark))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    r = c.execute(queries.ORACLE_SQL[name])
    cols = sorted(x[0] for x in r.description)
    want = sorted(repr(tuple(dict(zip((x[0] for x in r.description), v, strict=True))[k] for k in cols)) for v in r.fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == cols and sorted(repr(tuple(x[k] for k in cols)) for x in df.collect()) == want
