"""Chains, and what is elected and clustered over them."""

import itertools
import random

from pyspark.sql import functions as F

from mediacat import storage
from mediacat.operators import dedup
from mediacat.streaming import watch


def chains(n):
    rng = random.Random(1)
    order = list(range(n))
    shuffled = rng.sample(order, n)
    zigzag = [x for pair in zip(order[: n // 2], reversed(order[n // 2 :]), strict=True) for x in pair]
    return {"sorted": order, "random": shuffled, "zigzag": zigzag}


def test_components_of_long_chains(spark, monkeypatch):
    """A sorted, a random and a zigzag chain of 1,000 nodes each, in one graph."""
    edges, want = [(50_000, 50_001), (7, 7), (None, 3)], {50_000: 50_000, 50_001: 50_000}
    for k, nodes in enumerate(chains(1000).values()):
        edges += [(10_000 * k + nodes[i], 10_000 * k + nodes[i + 1]) for i in range(999)]
        want |= dict.fromkeys(range(10_000 * k, 10_000 * k + 1000), 10_000 * k)
    rounds, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, what: (rounds.append(what), stored(df, what))[1])
    got = {r.node: r.root for r in storage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want and rounds.count("links") < 20
    assert storage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(260)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in storage.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def greedy(order, links):
    """{id: (keeper, duplicate_of)} file by file."""
    near, kept, out = {}, set(), {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in order:
        hits = near.get(i, set()) & kept
        out[i] = (not hits, min(hits, default=None))
        if not hits:
            kept.add(i)
    return out


def test_keepers_of_long_chains(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(999)]
    other = rng.sample(range(2000, 3000), 1000)
    links += [(other[i], other[i + 1]) for i in range(999)]
    ids = [*range(1003), *range(2000, 3000)]
    files = spark.createDataFrame([(i, i) for i in ids], "id long, t long")
    edges, want = spark.createDataFrame(links, "left_id long, right_id long"), greedy(ids, links)
    for most_links in (10**6, 500):  # by one scan; 600 files at a time
        got = {r.id: (r.keeper, r.duplicate_of) for r in dedup.elect_keepers(files, edges, ["t"], most_links, 600).collect()}
        assert got == want


def test_duplicates_equal_file_by_file(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(6)]

    def changed(fp):
        at = rng.randrange(16)
        return fp[:at] + rng.choice("0123456789abcdef") + fp[at + 1 :]

    rows = [(i, f"h{rng.randrange(90)}" if i % 9 else None, rng.choice([None, "", *base, *map(changed, base * 3)])) for i in range(150)]
    rows = [(i, h, next((fp for _, g, fp in rows if h and g == h), fp), rng.randrange(40)) for i, h, fp in rows]
    near = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) * 10 >= 9 * len(a)
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    first = {}
    firsts = [r for r in order if r[1] is None or first.setdefault(r[1], r[0]) == r[0]]
    links = [(a[0], b[0]) for a, b in itertools.combinations(firsts, 2) if a[2] and b[2] and near(a[2], b[2])]
    want = greedy([r[0] for r in firsts], links)
    for i, h, _, _ in rows:
        if i not in want:
            kept, of = want[first[h]]
            want[i] = (False, first[h] if kept else of)
    df = spark.createDataFrame(rows, "id long, file_hash string, perceptual_hash string, t long")
    got = {r.id: (r.keeper, r.duplicate_of) for r in dedup.duplicates(df, ["t"]).collect()}
    assert got == want and any(not k and want[i][1] is not None for i, (k, _) in want.items())


def test_batches_equal_event_by_event(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None]), f"/f{rng.randrange(6)}", rng.choice(["created", "modified"]), rng.randrange(4000)) for _ in range(700)]
    want = {}
    for key in {r[0] for r in rows}:
        last = start = n = None
        for _, path, kind, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1], r[2])):
            if last is None or t - last > 5:
                start, n = t, 0
            cell = want.setdefault((key, start, n // 10, path, kind), [0, 0])
            cell[0] += 1
            cell[1] = t
            last, n = t, n + 1
    want = {(*k, *v) for k, v in want.items() if k[4] != "modified" or v[0] >= 2}
    df = spark.createDataFrame(rows, "source string, src_path string, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for seconds in (3, 50, 100_000):
        out = watch.batch_events(df, size=10, least_modified=2, bucket_seconds=seconds)
        got = {tuple(r) for r in out.select("source", F.unix_seconds("start"), "chunk", "src_path", "event_type", "n", F.unix_seconds("last_seen")).collect()}
        assert got == want, seconds


def test_no_target_repeats(spark):
    from mediacat.functions import paths

    rng = random.Random(6)
    names = [rng.choice(["x.jpg", "x.jpg", "x_1.jpg", "x_1_1.jpg", "x_2.jpg", "x_3.png", "x_07.jpg", "y_.jpg"]) for _ in range(60)]
    rows = [(f"/{i:02}/{n}", "image") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "p string, kind string").withColumn("t", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    got = [r.target for r in paths.organization_path(df, "p", "t", "kind").collect()]
    assert len(set(got)) == 60 and {f"Images/2024/01/31/{n}" for n in names} <= set(got)
    four = spark.createDataFrame([(f"/{i}/{n}",) for i, n in enumerate(["x.jpg", "x.jpg", "x_1.jpg", "x_1.jpg"])], "p string").select("p", F.lit("image").alias("kind"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("t"))
    got = {r.p: r.target.rsplit("/", 1)[1] for r in paths.organization_path(four, "p", "t", "kind").collect()}
    assert got == {"/0/x.jpg": "x.jpg", "/1/x.jpg": "x_2.jpg", "/2/x_1.jpg": "x_1.jpg", "/3/x_1.jpg": "x_1_1.jpg"}


def test_answers_in_fences(spark):
    from mediacat.functions import records

    data = '{"caption": "c", "mood": "m"}'
    answers = [f"```json\n{data}\n```", f"```json\n{data}", f"```\nplan\n```\n```json\n{data}\n```", f"```\n{data}\n```", data, f"```\n{data}"]
    df = spark.createDataFrame([(a,) for a in answers] + [('```json\n{"caption": "c', ), (None,)], "answer string")
    got = [r.parsed.caption for r in records.parse_model_answers(df).collect()]
    assert got == ["c"] * 6 + ["```json", None]
