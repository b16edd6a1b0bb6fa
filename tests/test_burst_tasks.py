"""Bursts are sorted in tasks of bounded size."""

import datetime

from pyspark.sql import functions as F

from mediacat.operators import bursts


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    t0 = datetime.datetime(2024, 1, 1)
    photos = spark.createDataFrame([(t0 + datetime.timedelta(minutes=10 * (i // 3), seconds=i % 3), f"p{i}", float(i % 2)) for i in range(300)], "ts timestamp, path string, score double")
    monkeypatch.setattr(bursts, "TASK_ROWS", 10)
    found = bursts.detect_bursts(photos, gap=1.0)
    culled = bursts.cull_actions(found, ["burst"])
    assert culled.rdd.getNumPartitions() == bursts.select_best(found, ["burst"]).rdd.getNumPartitions() == 31
    rows = culled.collect()
    assert sorted(r.burst for r in rows) == sorted(i // 3 + 1 for i in range(300))
    for r in rows:
        n = 3 * (r.burst - 1)
        best = f"p{n + 1}" if n % 2 == 0 else f"p{n}"
        assert r.best == best and (r.action == "keep") == (r.path == best)


def test_single_photos_and_runs_over_buckets(spark):
    t0 = datetime.datetime(2024, 1, 1, 0, 59, 59)
    steps = [0, 0.5, 1.4, 90, 7200, 7201, 20000]
    photos = spark.createDataFrame([(t0 + datetime.timedelta(seconds=s), f"p{n}", u) for u in (None, "a") for n, s in enumerate(steps)], "ts timestamp, path string, who string")
    one = bursts.detect_bursts(photos.where("who = 'a'"), gap=1.0).select("path", "burst").collect()
    assert sorted(map(tuple, one)) == [("p0", 1), ("p1", 1), ("p2", 1), ("p4", 3), ("p5", 3)]
    each = bursts.detect_bursts(photos, gap=1.0, partition="who").groupBy("who").agg(F.sort_array(F.collect_list("path")).alias("p")).collect()
    assert {r.who: r.p for r in each} == {k: ["p0", "p1", "p2", "p4", "p5"] for k in (None, "a")}  # rows without a key are one group, as in SQL
