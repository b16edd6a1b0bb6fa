"""The vault's ledger, models that are loaded once a worker, fingerprints bit by bit, image files, and the filters of pending work."""

import os
import struct
import zlib
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from mediacat.operators import catalog, images, sensitivity, vault
from mediacat.plans import jobs
from mediacat.sources import library

KEY = "0123456789abcdef"
DOCS = "id long, text string, name string, contains_text boolean, is_sensitive boolean"


def when(day):
    return F.lit(f"2024-01-0{day}").cast("timestamp")


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "vault")
    docs = spark.createDataFrame([(1, "ssn 123-45-6789", "a.txt", True, False), (2, "hello", "b.txt", True, False), (3, "hi", "c.txt", True, True), (4, None, "passport.png", False, False)], DOCS)
    scanned = sensitivity.detect_sensitive(docs)
    files = lambda: {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    there = lambda c=None: {r.id for r in vault.listing(vault.read_ledger(spark, path), c).collect()}
    assert there() == set()
    assert [r.id for r in vault.deposit(scanned, path, KEY, when(1)).collect()] == [2]
    held, before = there(), files()
    assert held == {1, 3, 4}
    vault.deposit(scanned, path, KEY, when(1)).collect()
    assert files() == before and there() == held  # a second run adds nothing
    assert {d.split("=")[1] for d in os.listdir(path) if d.startswith("category=")} == {r.category for r in vault.listing(vault.read_ledger(spark, path)).collect()}
    assert there("ai_flagged") == {3}
    ids = spark.createDataFrame([(1,), (99,)], "id long")
    back = vault.take_out(ids, path, KEY, when(2)).collect()
    assert [(r.id, r.text, r.name, r.processed, r.error) for r in back] == [(1, "ssn 123-45-6789", "restored_a.txt", False, None)]
    assert there() == {3, 4}
    assert vault.take_out(ids, path, KEY, when(3)).collect() == [] and there() == {3, 4}
    vault.deposit(scanned, path, KEY, when(4))
    assert there() == {1, 3, 4}  # put in again
    plan = vault.contents(vault.read_ledger(spark, path))._jdf.queryExecution().toString()
    assert KEY not in plan and not any(b"123-45" in open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")
    os.mkdir(loads)

    def make():
        open(os.path.join(loads, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()

        def predict(v, y):
            if (y == 13).any():
                raise ValueError("thirteen")
            return v.sum(axis=1) + y

        return predict

    df = spark.range(500).repartition(20).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("y"))
    got = {r.id: (r.prediction, r.error) for r in jobs.predict_with(df, make, ["v", "y"], batch_size=10).collect()}
    assert len(got) == 500 and got[13] == (None, "thirteen") and got[7] == (None, "a null input")
    assert all(got[i] == (2.0 * i + 1, None) for i in range(500) if i not in (7, 13))
    names = os.listdir(loads)
    assert 0 < len(names) == len({n.split("-")[0] for n in names}) < 20  # once in each process, whatever the tasks


def bits(hexes):
    return [int(b) for b in f"{int(hexes, 16):064b}"]


def test_fingerprints_bit_by_bit(spark):
    rng = np.random.default_rng(4)
    pictures = [rng.integers(0, 256, (32, 32)).astype(float) for _ in range(4)] + [np.add.outer(np.arange(32.0), np.arange(32.0) * 3), np.full((32, 32), 9.0)]
    df = spark.createDataFrame([(i, [float(x) for x in p.ravel()]) for i, p in enumerate(pictures)] + [(9, None), (10, [1.0])], "id long, luma array<double>")
    four = {r.id: r.perceptual_hash for r in images.fingerprint(df, parts=4).collect()}
    two = {r.id: r.perceptual_hash for r in images.fingerprint(df).collect()}
    assert four[9] is None and four[10] is None and two[9] is None
    for i, p in enumerate(pictures):
        assert two[i] == ":".join(four[i].split(":")[:2])
        a, q, d, w = map(bits, four[i].split(":"))
        blocks = [[sum(p[4 * r + y][4 * c + x] for y in range(4) for x in range(4)) / 16 for c in range(8)] for r in range(8)]
        flat = [b for row in blocks for b in row]
        mean, middle = sum(flat) / 64, sorted(flat)[31:33]
        if i == 5:
            assert a == d == w == [0] * 64 and q == [1] + [0] * 63
            continue
        assert a == [int(b > mean) for b in flat] and w == [int(b > sum(middle) / 2) for b in flat]
        cos = [[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
        low = [sum(p[y][x] * cos[r][y] * cos[c][x] for y in range(32) for x in range(32)) for r in range(8) for c in range(8)]
        half = sum(sorted(low)[31:33]) / 2
        assert all(int(v > half) == b for v, b in zip(low, q, strict=True) if abs(v - half) > 1e-5)  # terms of a plain slope are zero but for rounding
        assert i == 4 or sum(q) == 32

        def area(r, c, p=p):  # the mean of row r's strip between the edges of the c-th of nine columns
            lo, hi = c * 32 / 9, (c + 1) * 32 / 9
            return sum(p[4 * r + y][x] * max(0, min(x + 1, hi) - max(x, lo)) for y in range(4) for x in range(32))

        assert d == [int(area(r, c + 1) > area(r, c)) for r in range(8) for c in range(8)]


def test_image_files(spark, tmp_path):
    def png(w, h, value):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + bytes([value]) * w for _ in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(3, 2, 77))
    (tmp_path / "b.png").write_bytes(b"no picture")
    rows = library.read_images(spark, str(tmp_path)).select("image.width", "image.height", "image.data").collect()
    assert [(r.width, r.height, set(bytes(r.data))) for r in rows] == [(3, 2, {77})]


def test_filters_of_pending_work(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, False, t(1), t(3), None), (2, True, t(2), t(4), "Vaulted: pii"), (3, False, t(5), None, "bad"), (4, False, None, t(5), "Vaulted: x")], "id long, processed boolean, ingested_at timestamp, analyzed_at timestamp, error string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    at = F.lit("2024-01-01 04:00:00").cast("timestamp")
    assert ids(catalog.unprocessed(df)) == [1, 3, 4] and ids(catalog.unprocessed(df, F.lit("2024-01-01 05:00:00").cast("timestamp"))) == [3]
    assert ids(catalog.recent(df, at)) == [1, 2] and ids(catalog.recent(df, at, 0)) == [2]
    assert ids(catalog.vaulted(df)) == [2, 4] and ids(catalog.vaulted(df, False)) == [1, 3]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "x"}, "p"), (2, {"b": "y"}, "q")], "file_id long, metadata map<string,string>, source string")
    library.export_metadata(df, str(tmp_path / "out"), ["source"])
    back = spark.read.schema("file_id long, metadata map<string,string>, source string").json(str(tmp_path / "out")).orderBy("file_id").collect()
    assert [(r.file_id, r.metadata, r.source) for r in back] == [(1, {"a": "x"}, "p"), (2, {"b": "y"}, "q")]
