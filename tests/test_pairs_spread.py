"""Joins that give pairs spread their work and find every pair once."""

import itertools

from pyspark.sql import functions as F

from mediacat.operators import catalog, dedup, places


def test_equal_contents_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_A_SHARE", 100)
    rows = [(i, f"/p{i % 50}", "a" if i < 60 else "b" if i < 70 else None if i < 73 else f"h{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, file_path string, file_hash string")
    want = sorted((a[0], b[0]) for a, b in itertools.product(rows, rows) if a[2] is not None and a[2] == b[2] and a[1] != b[1])
    pairs = catalog.exact_matches(df, df)
    assert sorted(map(tuple, pairs.collect())) == want
    assert "share" in pairs._jdf.queryExecution().executedPlan().toString()


def test_places_of_many_rows(spark, monkeypatch):
    calls = []
    measure = places.haversine_km
    monkeypatch.setattr(places, "haversine_km", lambda *a: calls.append(a) or measure(*a))
    points = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(120)], "id long, lat double, lon double")
    found = places.within_radius(points, points, 120.0)
    plain = points.select(F.col("id").alias("a"), F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(points).withColumn("d", measure(F.col("x"), F.col("y"), F.col("lat"), F.col("lon"))).where("d <= 120")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select("a", "id", F.round("d", 6), F.round(1 - F.col("d") / 120.0, 6)).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "ASIN" not in plan.upper()  # distances are known before the rows meet


def test_fingerprint_pairs_come_once(spark):
    rows = [(i, "ab" * 7 + f"{i % 3:02d}") for i in range(30)] + [(5, "cd" * 8), (6, "cd" * 8), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "id long, perceptual_hash string")
    alike = lambda x, y: x and y and len(x) == len(y) and sum(a == b for a, b in zip(x, y, strict=True)) * 10 >= 9 * len(x)
    want = sorted({(a, b) for (a, x), (b, y) in itertools.product(rows, rows) if a != b and alike(x, y)})
    assert sorted(map(tuple, dedup.near_duplicate_join(df, df).collect())) == want
    once = df.where("id < 5 or id > 8")
    assert "HashAggregate" not in dedup.near_duplicate_join(once, once)._jdf.queryExecution().executedPlan().toString()  # pairs aren't sorted out afterwards
