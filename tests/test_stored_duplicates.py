"""Duplicates of files already stored, the index of fingerprints, and keys that many fingerprints share, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediacat.operators import dedup
from mediacat.plans import jobs


def matches(a, b, t=0.9):
    if not a or not b or len(a.split(":")) != len(b.split(":")):
        return False
    return any(len(x) == len(y) > 0 and sum(p == q for p, q in zip(x, y, strict=True)) * 10 >= len(x) * t * 10 for x, y in zip(a.split(":"), b.split(":"), strict=True))


def plain(files, known):
    """The rule, file by file: (id, keeper, duplicate_of, score)."""
    out, kept = [], []
    for i, digest, fp, t in sorted(files, key=lambda f: (f[3], f[0])):
        old = [k[0] for k in known if k[1] is not None and k[1] == digest]
        same = [k for k in kept if k[1] is not None and k[1] == digest]
        if old:
            out.append((i, False, min(old), 1.0))
        elif same:
            out.append((i, False, same[0][0], 1.0))
        elif near := [k[0] for k in known if matches(k[2], fp)]:
            out.append((i, False, min(near), 0.9))
        elif near := [k[0] for k in kept if matches(k[2], fp)]:
            out.append((i, False, min(near), 0.9))
        else:
            kept.append((i, digest, fp))
            out.append((i, True, None, None))
    return sorted(out)


def some_files(rng, n, first, contents):
    """Files of few contents (a content has one fingerprint); fingerprints drift, so that chains of near ones arise."""
    return [(first + i, *contents[rng.randrange(len(contents))], rng.randrange(50)) for i in range(n)]


def some_contents(rng, n):
    out, fp = [], ["0" * 16, "f" * 16]
    for i in range(n):
        fp = [("".join(rng.choice("0123456789abcdef") for _ in range(16)) if rng.random() < 0.1 else p[: (at := rng.randrange(16))] + rng.choice("0123456789abcdef") + p[at + 1 :]) for p in fp]
        out.append((None if rng.random() < 0.05 else f"h{i}", rng.choice([None, "", fp[0], ":".join(fp), ":".join(fp), ":".join(fp)])))
    return out


SCHEMA = "id long, file_hash string, perceptual_hash string, mtime long"


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_files_are_decided_first(spark, seed):
    rng = random.Random(seed)
    contents = some_contents(rng, 120)
    known, files = some_files(rng, 60, 1000, contents[:70]), some_files(rng, 150, 1, contents[20:])
    # A copy of a content that has no hash is compared by its fingerprint alone.
    k, f = spark.createDataFrame(known, SCHEMA), spark.createDataFrame(files, SCHEMA)
    want = plain([(i, d, p, t) for i, d, p, t in files], known)
    got = sorted(tuple(r) for r in dedup.duplicates(f, ["mtime"], known=k).select("id", "keeper", "duplicate_of", "score").collect())
    by_class = {}
    for i, d, p, _ in files:
        by_class.setdefault(d or f"own{i}", set()).add(p)
    assert all(len(p) == 1 for p in by_class.values())
    assert got == want
    base = dedup_index(spark, k)
    assert sorted(tuple(r) for r in dedup.duplicates(f, ["mtime"], known=k, index=base).select("id", "keeper", "duplicate_of", "score").collect()) == want


def dedup_index(spark, known):
    from mediacat.storage import fresh_dir

    base = fresh_dir(spark, "index")
    half = known.where("id % 2 = 0")
    dedup.write_fingerprints(half, base)
    dedup.write_fingerprints(known.where("id % 2 = 1"), base)  # added later
    return base


def test_two_runs_of_ingest_keep_what_one_would(spark):
    rng = random.Random(7)
    contents = some_contents(rng, 60)
    files = [(f"/a/{i}.jpg", 10 + i, t, False, d or f"x{i}", p) for i, d, p, t in some_files(rng, 120, 1, contents)]
    files.sort(key=lambda f: f[2])
    schema = "path string, size long, mtime long, is_dir boolean, hash string, perceptual_hash string"
    as_of = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "id long, file_path string, file_hash string, perceptual_hash string")
    first, _, s1 = jobs.ingest(spark.createDataFrame(files[:60], schema), empty, as_of)
    rows = jobs.stored_rows(first, as_of)
    second, tasks, s2 = jobs.ingest(spark.createDataFrame(files, schema), rows, as_of)  # the first half is known by its paths
    kept = {r.file_path for r in first.where("keeper").collect()} | {r.file_path for r in second.where("keeper").collect()}
    seen, want = [], set()
    for path, _, t, _, d, p in sorted(files[:60], key=lambda f: (f[2], f[0])) + sorted(files[60:], key=lambda f: (f[2], f[0])):
        if not any(d == e or matches(p, q) for e, q in seen):
            seen.append((d, p))
            want.add(path)
    assert kept == want
    assert tasks.count() == second.where("keeper").count()
    assert s1.first().errors == 0 and s2.first().ingested == second.where("keeper").count()


def test_unreadable_files_are_errors(spark):
    schema = "path string, size long, mtime long, is_dir boolean, hash string, perceptual_hash string, error string"
    rows = [("/a.jpg", 1, 1, False, None, None, "denied"), ("/b.jpg", 2, 2, False, None, "ff", None), ("/c.jpg", 3, 3, False, "h", None, None)]
    empty = spark.createDataFrame([], "id long, file_path string, file_hash string, perceptual_hash string")
    as_of = F.lit("2024-01-01").cast("timestamp")
    elected, tasks, summary = jobs.ingest(spark.createDataFrame(rows, schema), empty, as_of)
    assert {r.file_path: (r.keeper, r.error) for r in elected.collect()} == {"/a.jpg": (False, "denied"), "/b.jpg": (False, "content could not be read"), "/c.jpg": (True, None)}
    assert summary.first().asDict() == {"ingested": 1, "duplicates": 0, "errors": 2, "total_size": 3} and tasks.count() == 1
    log = jobs.ingestion_log(summary, as_of, as_of).first()
    assert (log.errors, log.details["errors"], log.total_size) == (2, 2, 3)


def test_hot_keys_are_cut_up(spark):
    rng = random.Random(3)
    hexes = "0123456789abcdef"
    tail = lambda n: "".join(rng.choice(hexes) for _ in range(n))
    prints = {("0" * 8 + tail(8)) for _ in range(600)} | {tail(16) for _ in range(1200)} | {"0" * 14 + a + b for a in hexes for b in hexes}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "id long, fp string")
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i:] if sum(x != y for x, y in zip(a, b, strict=True)) <= 1}
    rows = dedup.banded(df)
    got = Counter(tuple(sorted((r.left_fp, r.right_fp))) for r in dedup.near_links(rows, rows, hot=40).collect())
    assert set(got) == want and all(n == (1 if a == b else 2) for (a, b), n in got.items())
    # No key is left that more than the bound share, but those whose rows all match.
    cut, left = rows, []
    for _ in range(4):
        n = {r.key: r["count"] for r in cut.groupBy("key").count().collect()}
        hot = [k for k, c in n.items() if c > 40]
        left.append(max(n.values()))
        cut = dedup._cut(cut.where(F.col("key").isin(hot)).where("size(free) > d")).select(rows.columns)
        if cut.isEmpty():
            break
    assert left[0] > 600 and left[-1] <= 256


def test_no_fingerprints_no_work(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 2), (3, None, None, 3)], SCHEMA)
    assert sorted(map(tuple, dedup.duplicates(df, ["mtime"]).collect()), key=lambda r: r[0]) == [(1, True, None, None), (2, False, 1, 1.0), (3, True, None, None)]
    assert dedup.duplicates(df.limit(0), ["mtime"]).collect() == []
