"""Hand cases of the rules that are easy to get wrong."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from mediacat.functions import geo, paths, records, text
from mediacat.operators import bursts, catalog, clustering, dedup, ignore, images, places, queue, sensitivity, vectors, video
from mediacat.plans import jobs
from mediacat.sources import library
from mediacat.streaming import watch

T0 = dt.datetime(2024, 1, 31, 1, 2, 3)


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_burst_gap_is_inclusive(spark):
    rows = [(at(0), "a"), (at(1), "b"), (at(2.000001), "c"), (at(2.000001), "d"), (at(9), "e")]
    found = bursts.detect_bursts(spark.createDataFrame(rows, "ts timestamp, path string"), gap=1.0).collect()
    assert sorted((r.path, r.burst) for r in found) == [("a", 1), ("b", 1), ("c", 2), ("d", 2)]


def test_bucketed_sessions_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(at(rng.uniform(0, 40_000)), f"p{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, path string")
    small = {r.path: r.burst for r in bursts.detect_bursts(df, gap=60.0, bucket_seconds=100).collect()}
    whole = {r.path: r.burst for r in bursts.detect_bursts(df.withColumn("k", F.lit(1)), gap=60.0, partition="k").collect()}
    assert small == whole and small


def test_keepers_are_greedy(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "left_id long, right_id long")
    for order, keep in (((1, 2, 3), {1, 3}), ((2, 1, 3), {1, 3}), ((2, 3, 1), {1, 3})):
        files = spark.createDataFrame([(i + 1, o) for i, o in enumerate(order)], "id long, t int")
        kept = {r.id for r in dedup.elect_keepers(files, edges, ["t"]).where("keeper").collect()}
        by_time = sorted((o, i + 1) for i, o in enumerate(order))
        want = []
        for _, i in by_time:
            if not any(abs(i - k) == 1 for k in want):
                want.append(i)
        assert kept == set(want), (order, keep)


def test_near_join_equals_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(30)]
    rows = [(i, None if i % 17 == 0 else f"{base[rng.randrange(30)][:15]}{rng.choice('01')}:{base[rng.randrange(30)]}" if i % 5 else base[i % 30]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, perceptual_hash string")
    got = {tuple(r) for r in dedup.near_duplicate_join(df, df).collect()}

    def match(a, b):
        a, b = a.split(":"), b.split(":")
        return len(a) == len(b) and any(sum(x == y for x, y in zip(p, q, strict=True)) * 10 >= 9 * len(p) for p, q in zip(a, b, strict=True))

    assert got == {(i, j) for (i, a), (j, b) in itertools.permutations(rows, 2) if a and b and match(a, b)}


def test_search_limits_before_threshold_and_files(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "file_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id long, embedding array<float>")
    files = spark.createDataFrame([(1, "/a"), (4, "/d")], "id long, file_path string")
    assert [r.file_id for r in vectors.search_similar(q, v, k=2, files=files).collect()] == [1]
    assert sorted(r.file_id for r in vectors.search_similar(q, v, k=3, threshold=0.5).collect()) == [1, 2]


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in (0, 3, 6)] + [rng.uniform(-4, 10, (12, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id long, embedding array<double>")
    got = {r.id: r.cluster for r in clustering.cluster_vectors(df, 0.25, 3).collect()}
    z = (x - x.mean(0)) / x.std(0)
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) <= 0.25
    core, label, k = near.sum(1) >= 3, {}, 0
    for i in range(len(z)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = k
                    todo += [m for m in np.flatnonzero(near[j] & core) if m not in label]
            k += 1
    noise = 0
    for i in range(len(z)):
        if i not in label:
            around = [label[j] for j in np.flatnonzero(near[i] & core)]
            if around:
                want = min(around)
            else:
                noise -= 1
                want = noise
            assert got[i] == want
        else:
            assert got[i] == label[i]
    alone = spark.createDataFrame([(5, [1.0, 2.0])], "id long, embedding array<double>")
    assert clustering.cluster_vectors(alone, 0.5).collect()[0].cluster == 0


def test_radius_join_equals_cross_join(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, 89.9, 10.0), (901, 89.9, -170.0), (902, 0.0, 179.99), (903, 0.0, -179.99), (904, -90.0, 0.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.center_id, r.point_id) for r in places.within_radius(df, df, 800.0).collect()}
    d = df.alias("a").crossJoin(df.alias("b")).where(geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 800)
    assert got == {tuple(r) for r in d.select("a.id", "b.id").collect()}


@pytest.mark.parametrize(("name", "time"), [("IMG_20240131_010203.jpg", T0), ("IMG_20241331_010203.jpg", None), ("20240131010203.jpg", T0), ("x.jpg", None)])
def test_capture_time(spark, name, time):
    mtime = F.lit("2020-05-05 00:00:00").cast("timestamp")
    got = spark.createDataFrame([(f"/a/{name}",)], "p string").select(F.date_format(paths.capture_time(F.col("p"), mtime), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == (time or dt.datetime(2020, 5, 5)).strftime("%Y-%m-%d %H:%M:%S")


def test_names(spark):
    brand = lambda n: one(spark, paths.camera_brand, n)
    assert [brand(f"/x/{n}") for n in ("IMG_1.JPG", "DSC_1.nef", "DSCF1.JPG", "P1010001.RW2", "VID_1.mp4", "a.png")] == ["canon", "nikon", "sony", "panasonic", "samsung", None]
    assert [one(spark, paths.is_burst_name, f"/x/{n}") for n in ("IMG_1234 2.JPG", "DSC_0001-2.NEF", "IMG_12.JPG", "20240131_010203_001.jpg")] == [True, True, False, True]
    assert one(spark, paths.file_type, "/a/.jpg") == "other" and one(spark, paths.file_type, "/a/b.tar.GZ") == "archive"


def test_ignore_rules(spark):
    rows = [("/a/b.jpg", False), ("/a/.hidden/b.jpg", False), ("/a/x.TMP", False), ("/a/lost+found", True), ("Thumbs.db", False), ("/a/Thumbs.db", False)]
    kept = ignore.filter_ignored(spark.createDataFrame(rows, "path string, is_dir boolean")).collect()
    assert sorted(r.path for r in kept) == ["/a/Thumbs.db", "/a/b.jpg", "/a/lost+found"]


def test_sensitivity_order(spark):
    rows = [("a 123-45-6789 b@c.de", "x", True, False), ("1\n2\n3\n4\n5\n6", "x", True, False), ("1\n2\n3\n4\n5", "my_Passport.png", True, False), ("a@b.cd", "x", False, False), ("a@b.cd", "x", True, True)]
    got = sensitivity.detect_sensitive(spark.createDataFrame(rows, "text string, name string, contains_text boolean, is_sensitive boolean")).select("result.*").collect()
    assert [(r.category, r.confidence) for r in got] == [("ssn", 0.3), ("document", 0.7), ("id", 0.8), ("safe", 0.0), ("ai_flagged", None)]


def test_retries(spark):
    rows = [(1, "No such file or directory", 0), (2, "CUDA out of memory", None), (3, "odd", 1), (4, "odd", 2)]
    got = queue.apply_retry_policy(spark.createDataFrame(rows, "id long, error string, retry_count int"), 3, F.lit("2024-01-01 00:00:00").cast("timestamp")).orderBy("id").collect()
    assert [(r.status, r.retry_count, r.next_allowed_at and r.next_allowed_at.second) for r in got] == [("failed_final", 1, None), ("failed_temp", 1, 3), ("failed_temp", 2, 9), ("failed_final", 3, None)]


def test_scenes_and_stability(spark):
    frames = spark.createDataFrame([(1, 0.0, [0, 0]), (1, 1.0, [200, 200]), (1, 2.0, [200, 210])], "video_id long, frame_ts double, luma array<int>")
    assert video.scene_changes(frames).collect()[0].scene_changes == [1.0]
    sizes = [5, 5, 6, 6, 6, 6, 6]
    s = spark.createDataFrame([("p", at(i), x) for i, x in enumerate(sizes)], "path string, ts timestamp, size long")
    assert video.stable_files(s).select(F.date_format("stable_at", "ss")).collect()[0][0] == "08"


def test_images(spark):
    df = spark.createDataFrame([(1, [0, 0, 0, 0, 255, 0, 0, 0, 0], 3, 3), (2, None, 3, 3)], "id int, luma array<int>, width int, height int")
    v, e = (images.sharpness(df, form=f).orderBy("id").collect() for f in ("variance", "energy"))
    assert v[0].sharpness == 1.0 and v[0].blur == 0.0 and v[1].sharpness is None and e[0].sharpness == 1.0
    grid = spark.createDataFrame([([float(i % 7) for i in range(1024)],)], "luma array<double>")
    assert len(images.fingerprint(grid, parts=4).collect()[0].perceptual_hash) == 67
    hue = spark.createDataFrame([([[255, 0, 0], [0, 255, 0]],)], "p array<array<int>>").select(images.average_hue(F.col("p"))).first()[0]
    assert hue == 60.0
    px = spark.createDataFrame([(1, [10, 10, 10])] * 5 + [(1, [200, 0, 0])] * 3, "image_id long, rgb array<int>")
    assert images.dominant_colors(px, 2).collect()[0].colors == [[10, 10, 10], [200, 0, 0]]
    marks = spark.createDataFrame([([[0.0, 0.0], [30.0, 40.0]] + [[0.0, 0.0]] * 3,), ([[0.0, 0.0]],)], "m array<array<double>>").select(images.eye_openness(F.col("m")).alias("e")).collect()
    assert [r.e for r in marks] == [0.5, 0.5]


def test_answers(spark):
    rows = [('```json\n{"caption": "c", "tags": ["t"]}\n```',), ('A "red" car\nmore',), ("plain #one #two",)]
    got = records.parse_model_answers(spark.createDataFrame(rows, "answer string")).select("parsed.*").collect()
    assert [(r.caption, r.tags) for r in got] == [("c", ["t"]), ('A "red" car', ["red"]), ("plain #one #two", ["one", "two"])]


def test_tags_and_mood(spark):
    assert one(spark, text.caption_tags, "The Cat, (cat) and 12 123 dogs!") == ["cat", "dogs"]
    assert one(spark, text.caption_mood, "sad but happy") == "positive" and one(spark, text.caption_mood, "x") is None


def test_destinations(spark):
    df = spark.createDataFrame([("/1/x.jpg",), ("/2/x.jpg",), ("/3/x_1.jpg",)], "p string").withColumns({"t": F.lit("2024-01-02").cast("timestamp"), "k": F.lit("image")})
    got = sorted(r.target for r in paths.organization_path(df, "p", "t", "k").collect())
    assert len(set(got)) == 3 and "Images/2024/01/02/x.jpg" in got


def test_scores_keep_going(spark):
    def make():
        def fn(b):
            if (b["x"] == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"x": b["x"], "y": b["x"] * 2.0})

        return fn

    schema = StructType([StructField("x", LongType()), StructField("y", DoubleType())])
    got = {r.x: (r.y, r.error) for r in jobs.score_with(spark.createDataFrame([(i,) for i in range(5)], "x long"), make, schema).collect()}
    assert got[2] == (4.0, None) and got[3] == (None, "three")


def test_tables_round_trip(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(1, 2, 3)], "event_id long, file_id long, sequence int")
    library.write_table(df, base, "event_files")
    library.write_table(library.read_table(spark, base, "event_files").unionByName(df), base, "event_files")
    assert library.read_table(spark, base, "event_files").count() == 2


def test_scan(spark, tmp_path):
    for n in ("a.jpg", "b.JPG", "c.txt", "~d.jpg"):
        (tmp_path / n).write_bytes(b"xyz")
    df = library.clean_listing(library.scan_library(spark, str(tmp_path), extensions=["jpg"]))
    assert df.count() == 2
    assert jobs.hash_contents(df).where("file_hash is not null").count() == 2


def test_merge_keeps_what_is_absent(spark):
    old = spark.createDataFrame([(1, "c", 1.0, 5.0), (2, "d", 2.0, None)], "file_id long, caption string, sharpness double, video_duration double")
    new = spark.createDataFrame([(1, None, 9.0, None), (3, "n", 3.0, 4.0)], old.schema)
    got = {r.file_id: tuple(r)[1:] for r in catalog.merge_analysis(old, new).collect()}
    assert got == {1: ("c", 9.0, 5.0), 2: ("d", 2.0, None), 3: ("n", 3.0, 4.0)}


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["created", "modified", "deleted"]), f"/w/{rng.randrange(5)}.jpg", None, False, at(rng.uniform(0, 100))) for _ in range(200)] + [("created", "/w/last.jpg", None, False, at(1_000_000))]
    df = spark.createDataFrame(rows, "event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = library.event_stream(spark, str(tmp_path / "log"), df.schema)
    parts = []
    q = watch.on_batch(watch.debounce(watch.filter_events(stream)), lambda b, _: parts.extend(b.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    key = lambda r: (r.event_type, r.src_path, r.first_seen, r.last_seen, r.n)
    want = sorted(map(key, watch.debounce(watch.filter_events(df)).where("src_path <> '/w/last.jpg'").collect()))
    assert sorted(map(key, parts)) == want and want


def test_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['mediacat.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_content_classes_hold_every_file(spark):
    hashes = ["a"] * 300 + ["b", "c", "b", None, None]
    rows = [(i + 1, h) for i, h in enumerate(hashes)]
    got = catalog.content_classes(spark.createDataFrame(rows, "id long, file_hash string")).collect()
    first, n = {}, {h: hashes.count(h) for h in "abc"}
    for i, h in rows:
        first.setdefault(h, i)
    assert sorted(map(tuple, got)) == sorted((i, h, first[h] if h else None, n.get(h)) for i, h in rows)


def test_the_vault_key_is_in_no_plan(spark):
    key = "0123456789abcdef"
    docs = spark.createDataFrame([(1, "ssn 123-45-6789", "a.txt", True, False), (2, "hello", "b.txt", True, False)], "id long, text string, name string, contains_text boolean, is_sensitive boolean")
    safe, vault = sensitivity.quarantine(sensitivity.detect_sensitive(docs), key)
    back = sensitivity.restore(vault, vault.select("id"), key)
    assert [r.text for r in back.collect()] == ["ssn 123-45-6789"] and safe.count() == 1
    assert key not in vault._jdf.queryExecution().toString() + back._jdf.queryExecution().toString()


def test_image_rows_from_pixels(spark):
    rng = np.random.default_rng(1)
    rgb = np.concatenate([rng.integers(0, 60, (300, 3)), np.tile([200, 30, 40], (500, 1))])
    pixels = spark.createDataFrame([(1, [int(c) for c in p]) for p in rgb], "image_id long, rgb array<int>")
    df = spark.createDataFrame([(1, [float(x) for x in range(64)], 8, 8)], "image_id long, luma array<double>, width int, height int")
    row = images.image_rows(df, pixels).first()
    assert row.color_palette[0] == [200, 30, 40] and 0 < row.aesthetic < 1 and row.lab_spread > 10
    grey = spark.createDataFrame([(1, [v, v, v]) for v in range(0, 250, 10)], "image_id long, rgb array<int>")
    assert images.lab_spread(grey).first().lab_spread < 1


def recall_of(got, q, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {int(i): set(np.argsort(-(u @ u[i]), kind="stable")[:k].tolist()) for i in q}
    return sum(r.file_id in want[r.query_id] for r in got) / (k * len(want))


def test_approximate_search_reads_few_lists_where_there_is_structure(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (40, 64))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.3, (4000, 64))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "file_id long, embedding array<double>")
    q = v.where("file_id % 100 = 0").select(F.col("file_id").alias("id"), "embedding")
    centres, probes = vectors.fit_lists(v)
    filed = vectors.file_in_lists(v, centres)
    sizes = {r.list: r["count"] for r in filed.groupBy("list").count().collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    read = sum(sizes.get(int(c), 0) for i in range(0, 4000, 100) for c in np.argsort(-(u[i] @ centres.T))[:probes])
    assert sum(sizes.values()) == 4000 and read < 0.1 * 40 * 4000
    assert recall_of(vectors.search_approx(q, v, 10).collect(), range(0, 4000, 100), x, 10) >= 0.9


def test_approximate_search_of_the_test_tables(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("file_id"), "embedding")
    q = v.where("file_id % 50 = 0").select(F.col("file_id").alias("id"), "embedding")
    x = np.array([r.embedding for r in v.orderBy("file_id").collect()])
    centres, probes = vectors.fit_lists(v)
    pairs = vectors.approx_candidates(q, vectors.file_in_lists(v, centres), centres, probes, 4 * 10)
    assert pairs.count() < 0.1 * q.count() * v.count()  # compared exactly; without structure most lists are read, as codes
    assert recall_of(vectors.search_approx(q, v, 10).collect(), range(0, len(x), 50), x, 10) >= 0.9
    assert vectors.search_approx(q.limit(0), v, 10).collect() == [] and vectors.search_approx(q, v.limit(0), 10).collect() == []


def test_faces_and_persons_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (9, 8))
    make = lambda n: [(i, [float(c) for c in centre[i % 9] + rng.normal(0, 0.6, 8)]) for i in range(n)]
    faces, gallery = spark.createDataFrame([*make(300), (300, [0.0] * 8)], "id long, embedding array<double>"), spark.createDataFrame([(i % 20, e) for i, e in make(200)] + [(77, [1.0, 2.0])], "person_id long, embedding array<double>")
    for best in (True, False):
        want = sorted(map(tuple, vectors.match_persons(faces, gallery, 0.5, best).collect()))
        assert sorted(map(tuple, vectors.match_persons(faces, gallery, 0.5, best, block_bytes=2000).collect())) == want and len(want) > 100
    plan = vectors.match_persons(faces, gallery, 0.5)._jdf.queryExecution().executedPlan().toString()
    build = plan.split("BroadcastExchange")[1]
    assert "person_id" in build.split("BroadcastExchange")[0] and "BuildRight" in plan  # the gallery is smaller


def test_vectors_without_values_have_no_cluster(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [9.0, 9.0]), (7, [9.0, 9.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.cluster for r in clustering.cluster_vectors(df, 0.5).collect()}
    assert got == {1: 0, 2: 0, 3: None, 4: None, 5: None, 6: 1, 7: 1}
