"""One query for each operator, over the given tables, with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import geo, paths, records, text, vectors
from mediacat.operators import bursts, catalog, clustering, dedup, ignore, images, places, queue, sensitivity, vault, video
from mediacat.operators import vectors as search
from mediacat.plans import jobs
from mediacat.sources import library
from mediacat.sources.versioned import Catalog
from mediacat.storage import fresh_dir, table
from mediacat.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


# Inputs derived from the tables, in SQL that Spark and DuckDB both run.
FILES = """SELECT id, concat('/lib/d', CAST(q % 7 AS STRING), '/', CASE kind
    WHEN 0 THEN concat('IMG_', lpad(CAST(q % 10000 AS STRING), 4, '0'), '.JPG')
    WHEN 1 THEN concat('IMG_2024', lpad(CAST(q % 14 AS STRING), 2, '0'), '15_1020', lpad(CAST(q % 60 AS STRING), 2, '0'), '.jpg')
    WHEN 2 THEN concat('DSC_', CAST(q AS STRING), '.NEF')
    WHEN 3 THEN concat('DSC_', CAST(q AS STRING), '.JPG')
    WHEN 4 THEN concat('P10', lpad(CAST(q % 100000 AS STRING), 5, '0'), '.ORF')
    WHEN 5 THEN concat('clip_', CAST(q AS STRING), '.MOV')
    WHEN 6 THEN concat('clip_', CAST(q AS STRING), '.heic')
    WHEN 7 THEN concat(replace(p_name, ' ', '_'), '_', CAST(id AS STRING), '.pdf')
    WHEN 8 THEN concat(replace(p_name, ' ', '_'), '.tmp')
    WHEN 9 THEN concat('~invoice ', CAST(q AS STRING), '.docx')
    ELSE concat('IMG_', lpad(CAST(q % 10000 AS STRING), 4, '0'), ' 2.JPG') END) AS file_path,
  CAST(p_size * 1000 AS BIGINT) AS file_size, md5(p_name) AS file_hash, CAST(1704067200 + id * 37 AS BIGINT) AS mtime
FROM (SELECT CAST(p_partkey AS BIGINT) AS id, p_name, p_size, CAST(p_partkey % 11 AS INT) AS kind, CAST(floor(p_partkey / 11) AS BIGINT) AS q FROM {part}) x"""
TASKS = """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey AS BIGINT) AS file_id, CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END) END AS status,
  o_orderdate AS created_at, CAST(o_orderkey % 3 AS INT) AS retry_count,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'No such file or directory: x' WHEN 1 THEN 'CUDA out of memory' WHEN 2 THEN 'odd' ELSE NULL END AS error FROM {orders}"""
FACES = """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS file_id, l_discount * 10 AS confidence,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 10 END AS eye_open_prob, CAST(l_suppkey % 20 AS BIGINT) AS person_id FROM {lineitem}"""
POINTS = """SELECT CAST(c_custkey AS BIGINT) AS id, CAST((37 * c_custkey) % 170 - 85 AS DOUBLE) AS lat, CAST((91 * c_custkey) % 360 - 180 AS DOUBLE) AS lon FROM {customer}"""
CENTERS = """SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((37 * s_suppkey) % 170 - 85 AS DOUBLE) AS lat, CAST((91 * s_suppkey) % 360 - 180 AS DOUBLE) AS lon FROM {supplier}"""
DOCS = """SELECT d.doc_id AS id, d.text, concat(d.source, CASE CAST(d.doc_id % 6 AS INT) WHEN 0 THEN '/Invoice.txt' WHEN 1 THEN '/passport.png' WHEN 2 THEN '/lab_notes.txt' ELSE '/note.md' END) AS name,
  d.doc_id % 2 = 0 AS contains_text, coalesce(l.toxic = 1, false) AS is_sensitive, coalesce(l.quality = 1, false) AS processed
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_of(fixture: str) -> str:
    return "(" + fixture.format(**{t: t for t in _ALL}) + ")"


def fixture(spark: SparkSession, d: str, sql: str) -> DataFrame:
    used = {t: table(spark, d, t) for t in _ALL if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


_FILES, _TASKS, _FACES, _POINTS, _CENTERS, _DOCS = map(sql_of, (FILES, TASKS, FACES, POINTS, CENTERS, DOCS))


def files(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, FILES)


def case_map(expr: str, values: dict[str, list[str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {expr} IN ({', '.join(repr(x) for x in xs)}) THEN '{k}'" for k, xs in values.items()) + f" ELSE {default} END"


_EXT = "lower(regexp_extract(file_path, '[.]([^./]*)$', 1))"


@query("file_type", f"SELECT id, {case_map(_EXT, {'image': paths.IMAGE + paths.IMAGE_EXTRA, 'video': paths.VIDEO, 'audio': paths.AUDIO, 'document': paths.DOCUMENT, 'archive': paths.ARCHIVE}, repr('other'))} AS file_type FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.file_type(F.col("file_path")).alias("file_type"))


@query("glob_type", f"SELECT id, {case_map(_EXT, {'image': paths.IMAGE, 'video': paths.VIDEO, 'audio': paths.AUDIO, 'document': paths.DOCUMENT, 'archive': paths.ARCHIVE})} AS file_type FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.glob_type(F.col("file_path")).alias("file_type"))


@query("mime_type", f"SELECT id, CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MIME.items()) + f" ELSE 'application/octet-stream' END AS mime FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.mime_type(F.col("file_path")).alias("mime"))


_NAME = "regexp_extract(file_path, '[^/]*$')"


@query("camera_brand", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(upper({_NAME}), '{v}') THEN '{k}'" for k, v in paths.CAMERAS.items()) + f" END AS brand FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.camera_brand(F.col("file_path")).alias("brand"))


_STEM = f"regexp_replace({_NAME}, '[.][^.]*$', '')"


@query("burst_name", f"SELECT id, regexp_matches(upper({_STEM}), '{paths.BURST_NAME}') AS burst FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.is_burst_name(F.col("file_path")).alias("burst"))


@query("capture_time", f"""SELECT id, CAST(epoch(coalesce(try_strptime(regexp_replace(nullif(regexp_extract({_STEM}, '([0-9]{{8}}_[0-9]{{6}})', 1), ''), '_', ''), '%Y%m%d%H%M%S'), make_timestamp(mtime * 1000000))) AS BIGINT) AS captured FROM {_FILES}""")
def _(spark, d):
    return files(spark, d).select("id", F.unix_timestamp(paths.capture_time(F.col("file_path"), F.timestamp_seconds("mtime"))).alias("captured"))


@query("normalize_path", "SELECT page_id, regexp_replace(regexp_replace(replace(concat('C:\\', url), '\\', '/'), '^.:', ''), '^/', '') AS path_key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", paths.normalize_path(F.concat(F.lit("C:\\"), "url")).alias("path_key"))


@query("should_reprocess", f"SELECT id, {_EXT} IN ({', '.join(map(repr, paths.REPROCESSED))}) AS again FROM {_FILES}")
def _(spark, d):
    return files(spark, d).select("id", paths.should_reprocess(F.col("file_path")).alias("again"))


_ORGANISED = f"(SELECT id, strftime(make_timestamp(mtime * 1000000), '%Y/%m/%d') AS day, concat('/d', CAST(id AS STRING), '/') AS dir, CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN concat('a_', CAST(id % 40 AS STRING)) ELSE concat('b', CAST(id AS STRING)) END AS s FROM {_FILES})"


@query("organization_path", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY day, s ORDER BY dir) - 1 AS n FROM {_ORGANISED}),
  t AS (SELECT day, 'a' AS s, list(CAST(substr(s, 3) AS BIGINT)) AS taken FROM r WHERE n = 0 AND regexp_matches(s, '^a_[1-9]') GROUP BY day)
  SELECT id, concat('Others/', day, '/', s, CASE WHEN n > 0 THEN concat('_', CAST([x for x in range(1, n + 1 + len(coalesce(taken, []))) if NOT list_contains(coalesce(taken, []), x)][n] AS STRING)) ELSE '' END, '.jpg') AS target FROM r LEFT JOIN t USING (day, s)""")
def _(spark, d):
    name = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.concat(F.lit("a_"), (F.col("id") % 40).cast("string"))).otherwise(F.concat(F.lit("b"), F.col("id").cast("string")))
    f = files(spark, d).select("id", F.timestamp_seconds("mtime").alias("t"), F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/"), name, F.lit(".jpg")).alias("file_path"), F.lit("other").alias("kind"))
    return paths.organization_path(f, "file_path", "t", "kind").select("id", "target")


@query("find_files", f"SELECT id FROM {_FILES} WHERE (regexp_matches({_NAME}, '^IMG_.*[.]JPG$') OR regexp_matches({_NAME}, '[.]pdf$')) AND file_size BETWEEN 5000 AND 30000")
def _(spark, d):
    return library.find_files(files(spark, d).withColumnsRenamed({"file_path": "path", "file_size": "size"}), ["IMG_*.JPG", "*.pdf"], 5000, 30000).select("id")


@query("clean_listing", f"SELECT DISTINCT file_path AS path FROM {_FILES} WHERE NOT starts_with({_NAME}, '.') AND NOT starts_with({_NAME}, '~')")
def _(spark, d):
    return library.clean_listing(files(spark, d).withColumnRenamed("file_path", "path")).select("path")


@query("filter_ignored", f"SELECT id FROM {_FILES} WHERE NOT regexp_matches(lower(file_path), '[.](tmp|temp|bak|backup|lnk|url|swp|swo|cache|thumb)$')")
def _(spark, d):
    return ignore.filter_ignored(files(spark, d).withColumn("is_dir", F.lit(False)), "file_path").select("id")


_RULE_NAMES = "CASE WHEN id % 23 = 0 THEN 'Thumbs.db' WHEN id % 23 = 1 THEN '.old.SWP' WHEN id % 23 = 2 THEN '._x.cache' WHEN id % 23 = 3 THEN '/a/.git' WHEN id % 23 = 4 THEN 'x.mtppp' WHEN id % 23 = 5 THEN 'desktop.ini' ELSE regexp_replace(file_path, '^.*/', '') END"


@query("matching_rules", f"SELECT id, CASE n WHEN 'Thumbs.db' THEN 'Thumbs.db,thumb*.db' WHEN '.old.SWP' THEN '.*,*.swp' WHEN '._x.cache' THEN '.*,*.cache,._*' WHEN '/a/.git' THEN '*/.*' WHEN 'x.mtppp' THEN '.mtp+' WHEN 'desktop.ini' THEN 'desktop.ini' ELSE CASE WHEN n LIKE '%.tmp' THEN '*.tmp' WHEN n LIKE '~%' THEN '~*' ELSE '' END END AS rules FROM (SELECT id, {_RULE_NAMES} AS n FROM {_FILES})")
def _(spark, d):
    return ignore.matching_rules(files(spark, d).withColumn("file_path", F.expr(_RULE_NAMES)), "file_path").select("id", F.array_join("rules", ",").alias("rules"))


@query("new_files", f"SELECT id FROM {_FILES} WHERE id % 3 <> 0 AND file_path NOT IN (SELECT file_path FROM {_FILES} WHERE id % 3 = 0)")
def _(spark, d):
    f = files(spark, d)
    return catalog.new_files(f.where("id % 3 <> 0").withColumnRenamed("file_path", "path"), f.where("id % 3 = 0")).select("id")


@query("mark_orphans", f"SELECT id, id % 2 = 0 OR (file_path LIKE '/lib/d3/%' AND file_path NOT IN (SELECT file_path FROM {_FILES} WHERE id % 3 = 0)) AS processed FROM {_FILES}")
def _(spark, d):
    f = files(spark, d).withColumn("processed", F.col("id") % 2 == 0).withColumn("error", F.lit(None).cast("string"))
    return catalog.mark_orphans(f, f.where("id % 3 = 0").select(F.col("file_path").alias("path")), "/lib/d3").select("id", "processed")


@query("exact_matches", f"SELECT a.id AS left_id, b.id AS right_id FROM {_FILES} a JOIN {_FILES} b ON a.file_hash = b.file_hash AND a.file_path <> b.file_path")
def _(spark, d):
    return catalog.exact_matches(files(spark, d), files(spark, d))


@query("content_classes", f"SELECT a.id, a.file_hash, b.class_id, b.class_size FROM {_FILES} a LEFT JOIN (SELECT file_hash, min(id) AS class_id, count(*) AS class_size FROM {_FILES} GROUP BY file_hash) b ON a.file_hash = b.file_hash")
def _(spark, d):
    return catalog.content_classes(files(spark, d).select("id", "file_hash"))


def _pairs(kind: str) -> str:
    s = f"(SELECT file_path AS path, regexp_replace(file_path, '/[^/]*$', '') AS dir, {_STEM} AS stem, {_EXT} AS ext FROM {_FILES})"
    raw = ", ".join(map(repr, paths.RAW))
    if kind == "raw":
        one = f"SELECT a.path AS x, b.path AS y FROM {s} a JOIN {s} b ON a.dir = b.dir AND a.stem = b.stem WHERE a.ext IN ({raw}) AND b.ext IN ('jpg', 'jpeg')"
        return f"SELECT x AS path, y AS related FROM ({one}) UNION ALL SELECT y, x FROM ({one})"
    if kind == "live":
        return f"SELECT a.path, b.path AS related FROM {s} a JOIN {s} b ON a.dir = b.dir AND a.stem = b.stem WHERE a.ext IN ('heic', 'jpg', 'jpeg') AND b.ext = 'mov'"
    base = lambda x: f"regexp_replace({x}.stem, '( [0-9]+|-[0-9]+|_BURST[0-9]+)$', '')"
    return f"SELECT a.path, b.path AS related FROM {s} a JOIN {s} b ON a.dir = b.dir AND a.ext = b.ext AND {base('a')} = {base('b')} AND a.path <> b.path WHERE regexp_matches(upper(a.stem), '{paths.BURST_NAME}')"


@query("raw_jpeg_pairs", _pairs("raw"))
def _(spark, d):
    return catalog.raw_jpeg_pairs(files(spark, d))


@query("live_photo_pairs", _pairs("live"))
def _(spark, d):
    return catalog.live_photo_pairs(files(spark, d))


@query("burst_siblings", _pairs("burst"))
def _(spark, d):
    return catalog.burst_siblings(files(spark, d))


@query("related_files", " UNION ALL ".join(f"SELECT path, related, '{k}' AS kind FROM ({_pairs(x)})" for k, x in (("raw_jpeg", "raw"), ("live_photo", "live"), ("burst", "burst"))))
def _(spark, d):
    return catalog.related_files(files(spark, d))


@query("compare_manifests", "SELECT coalesce(a.item_id, b.doc_id) AS item, a.item_id IS NOT NULL AS exists_left, b.doc_id IS NOT NULL AS exists_right, coalesce(length(a.text) = length(b.text), false) AS same_size, coalesce(md5(a.text) = md5(b.text), false) AS same_hash, coalesce(length(a.text) = length(b.text), false) AND coalesce(md5(a.text) = md5(b.text), false) AS identical FROM benchmark a FULL JOIN documents b ON a.item_id = b.doc_id")
def _(spark, d):
    m = lambda t, k: table(spark, d, t).select(F.col(k).alias("item"), F.length("text").alias("size"), F.md5("text").alias("hash"))
    return catalog.compare_manifests(m("benchmark", "item_id"), m("documents", "doc_id"), "item")


@query("latest_analysis", f"SELECT f.id, f.file_path, CAST(epoch_us(o_orderdate) AS BIGINT) AS analyzed_us FROM {_FILES} f JOIN orders o ON f.id = o.o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").cast("timestamp").alias("analyzed_at"))
    return catalog.latest_analysis(files(spark, d), a).select("id", "file_path", F.unix_micros("analyzed_at").alias("analyzed_us"))


@query("near_duplicate_join", """SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM (SELECT vec_id, concat(substr(md5(CAST(vec_id % 100 AS STRING)), 1, 15), CAST(vec_id % 10 AS STRING)) AS fp FROM embeddings) a
  JOIN (SELECT vec_id, concat(substr(md5(CAST(vec_id % 100 AS STRING)), 1, 15), CAST(floor(vec_id / 100) AS BIGINT) % 10) AS fp FROM embeddings) b ON a.vec_id <> b.vec_id AND substr(a.fp, 1, 15) = substr(b.fp, 1, 15)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.substring(F.md5((F.col("vec_id") % 100).cast("string")), 1, 15).alias("h"))
    a = e.select("id", F.concat("h", (F.col("id") % 10).cast("string")).alias("fp"))
    b = e.select("id", F.concat("h", (F.floor(F.col("id") / 100) % 10).cast("string")).alias("fp"))
    return dedup.near_duplicate_join(a, b, "fp", 0.9)


@query("average_fingerprint", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, e, list_reduce(e, lambda a, x: a + x) AS total FROM v)
  SELECT vec_id, array_to_string([lower(printf('%x', CASE WHEN e[4 * i + 1] * 64 > total THEN 8 ELSE 0 END + CASE WHEN e[4 * i + 2] * 64 > total THEN 4 ELSE 0 END + CASE WHEN e[4 * i + 3] * 64 > total THEN 2 ELSE 0 END + CASE WHEN e[4 * i + 4] * 64 > total THEN 1 ELSE 0 END)) for i in range(16)], '') AS fingerprint FROM s""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", images.average_hash(F.col("v")).alias("fingerprint"))


#: Files of the documents: a document's text is the content; fingerprints fall into clusters within which all match and across which none do.
_PRINTS = """SELECT doc_id AS id, md5(text) AS file_hash, concat('/lib/', source, '/', CAST(doc_id AS STRING), '.jpg') AS path, n_chars AS size, CAST(1704067200 + doc_id % 97 AS BIGINT) AS mtime,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE concat(substr(md5(CAST(n_chars % 150 AS STRING)), 1, 15), substr('0123456789abcdef', CAST(n_chars % 16 AS INT) + 1, 1)) END AS perceptual_hash,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 150 END AS near FROM {documents}"""
_PRINTED = _PRINTS.replace("{documents}", "documents")


@query("keepers", f"""WITH f AS ({_PRINTED}), h AS (SELECT *, min(id) OVER (PARTITION BY file_hash) AS first FROM f),
  n AS (SELECT *, CASE WHEN near IS NULL THEN first ELSE min(first) OVER (PARTITION BY near) END AS kept FROM h)
  SELECT id, id = kept AS keeper, CASE WHEN id <> kept THEN kept END AS duplicate_of, CASE WHEN id = kept THEN NULL WHEN first = kept THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM n""")
def _(spark, d):
    return dedup.duplicates(fixture(spark, d, _PRINTS), ["id"])


@query("near_duplicate_classes", f"""WITH f AS ({_PRINTED}), c AS (SELECT perceptual_hash AS fp, near, min(id) AS class_id, count(*) AS copies FROM f WHERE perceptual_hash IS NOT NULL GROUP BY ALL)
  SELECT f.id, coalesce(c.class_id, f.id) AS class_id, coalesce(c.copies, 1) AS copies, CASE WHEN c.near IS NULL THEN 0 ELSE (SELECT count(*) FROM c o WHERE o.near = c.near) - 1 END AS links FROM f LEFT JOIN c ON f.perceptual_hash = c.fp""")
def _(spark, d):
    return dedup.near_duplicate_classes(fixture(spark, d, _PRINTS))[0]


@query("first_per_key", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    return dedup.first_per_key(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])


for _a, _f in (("sha256", "sha256(text)"), ("sha1", "sha1(text)"), ("md5", "md5(text)")):

    @query(f"content_hash_{_a}", f"SELECT doc_id, {_f} AS hash FROM documents")
    def _(spark, d, a=_a):
        return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text"), a).alias("hash"))


@query("ingestion_summary", f"SELECT count(*) FILTER (id % 5 > 1) AS ingested, count(*) FILTER (id % 5 = 1) AS duplicates, count(*) FILTER (id % 5 = 0) AS errors, CAST(coalesce(sum(file_size) FILTER (id % 5 > 1), 0) AS BIGINT) AS total_size FROM {_FILES}")
def _(spark, d):
    m = F.col("id") % 5
    return catalog.ingestion_summary(files(spark, d).select(F.when(m > 1, "ingested").when(m == 1, "duplicate").otherwise("error").alias("outcome"), F.col("file_size").alias("size")))


@query("embedding_stats", "SELECT count(*) AS total, count(DISTINCT vec_id % 100) AS files, count(DISTINCT label) AS types FROM embeddings")
def _(spark, d):
    return catalog.embedding_stats(table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("file_id"), F.col("label").alias("embedding_type")))


@query("queue_status", f"SELECT status, count(*) AS tasks FROM {_TASKS} GROUP BY status")
def _(spark, d):
    return queue.queue_status(fixture(spark, d, TASKS))


@query("catalog_status", f"SELECT count(*) AS total, count(*) FILTER (processed) AS analysed, count(*) FILTER (is_sensitive) AS vaulted, count(*) - count(*) FILTER (processed) AS pending FROM {_DOCS}")
def _(spark, d):
    return catalog.catalog_status(fixture(spark, d, DOCS).withColumn("error", F.when(F.col("is_sensitive"), "Vaulted: x")))


@query("processing_stats", f"SELECT count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS errors, round(coalesce(avg(CAST(id % 100 AS DOUBLE)) FILTER (status = 'completed'), 0), 6) AS mean_seconds FROM {_TASKS}")
def _(spark, d):
    t = fixture(spark, d, TASKS).withColumn("started_at", F.col("created_at").cast("timestamp"))
    return queue.processing_stats(t.withColumn("completed_at", F.timestamp_seconds(F.unix_seconds("started_at") + F.col("id") % 100)))


@query("media_stats", f"SELECT count(*) AS processed, count(*) FILTER (k = 'image') AS images, count(*) FILTER (k = 'video') AS videos, CAST(sum(id % 4) AS BIGINT) AS faces, count(*) FILTER (id % 9 = 0) AS errors FROM (SELECT id, {case_map(_EXT, {'image': paths.IMAGE, 'video': paths.VIDEO})} AS k FROM {_FILES})")
def _(spark, d):
    return catalog.media_stats(files(spark, d).select(paths.file_type(F.col("file_path")).alias("file_type"), (F.col("id") % 4).alias("faces"), F.when(F.col("id") % 9 == 0, "x").alias("error")))


@query("predict_with", "SELECT vec_id, round(sqrt(list_inner_product([CAST(x AS DOUBLE) for x in embedding], [CAST(x AS DOUBLE) for x in embedding])) * label, 6) AS prediction FROM embeddings")
def _(spark, d):
    def load():
        return lambda v, label: np.sqrt((v * v).sum(axis=1)) * label

    e = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"), F.col("label").cast("double").alias("label"))
    return jobs.predict_with(e, load, ["v", "label"]).select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("unprocessed", f"SELECT id FROM {_DOCS} WHERE NOT processed")
def _(spark, d):
    return catalog.unprocessed(fixture(spark, d, DOCS)).select("id")


@query("unprocessed_since", f"SELECT id FROM {_TASKS} WHERE status <> 'completed' AND created_at >= TIMESTAMP '1996-01-01'")
def _(spark, d):
    rows = fixture(spark, d, TASKS).select("id", (F.col("status") == "completed").alias("processed"), F.col("created_at").cast("timestamp").alias("ingested_at"))
    return catalog.unprocessed(rows, F.lit("1996-01-01").cast("timestamp")).select("id")


@query("recent", f"SELECT id FROM {_TASKS} WHERE created_at >= TIMESTAMP '1997-06-01' - INTERVAL 720 HOUR AND created_at <= TIMESTAMP '1997-06-01'")
def _(spark, d):
    return catalog.recent(fixture(spark, d, TASKS).select("id", F.col("created_at").cast("timestamp").alias("analyzed_at")), F.lit("1997-06-01").cast("timestamp"), 720).select("id")


@query("vaulted", f"SELECT id, coalesce(error LIKE 'Vaulted:%', false) AS yes FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Vaulted: pii' WHEN id % 3 = 1 THEN error END AS error FROM {_TASKS})")
def _(spark, d):
    rows = fixture(spark, d, TASKS).select("id", F.when(F.col("id") % 3 == 0, "Vaulted: pii").when(F.col("id") % 3 == 1, F.col("error")).alias("error"))
    return catalog.vaulted(rows).select("id", F.lit(True).alias("yes")).unionByName(catalog.vaulted(rows, False).select("id", F.lit(False).alias("yes")))


@query("next_tasks", f"SELECT id, priority FROM {_TASKS} WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 25")
def _(spark, d):
    return queue.next_tasks(fixture(spark, d, TASKS), 25).select("id", "priority")


_AS_OF = "2000-01-01 00:00:00"


@query("purge_queue", f"SELECT id FROM {_TASKS} WHERE NOT (status IN ('completed', 'failed') AND created_at < TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY)")
def _(spark, d):
    t = fixture(spark, d, TASKS).withColumn("completed_at", F.col("created_at").cast("timestamp"))
    return queue.purge_queue(t, F.lit(_AS_OF).cast("timestamp")).select("id")


@query("enqueue", f"SELECT id AS file_id, 30 AS priority, 'pending' AS status FROM {_FILES}")
def _(spark, d):
    return queue.enqueue(files(spark, d), 3, F.lit(_AS_OF).cast("timestamp")).select("file_id", "priority", "status")


@query("requeue_all", f"SELECT row_number() OVER (ORDER BY id) AS id, id AS file_id, 10 AS priority, 'pending' AS status FROM {_FILES}")
def _(spark, d):
    return queue.requeue_all(files(spark, d), F.lit(_AS_OF).cast("timestamp"))[1].select("id", "file_id", "priority", "status")


@query("retry_policy", f"""SELECT id, retry_count + 1 AS retry_count, CASE WHEN coalesce(error LIKE '%No such file%', false) OR retry_count + 1 >= 3 THEN 'failed_final' ELSE 'failed_temp' END AS status,
  CASE WHEN coalesce(error LIKE '%No such file%', false) OR retry_count + 1 >= 3 THEN NULL WHEN retry_count = 0 THEN 3 WHEN retry_count = 1 THEN 9 ELSE 27 END AS wait FROM {_TASKS}""")
def _(spark, d):
    as_of = F.lit(_AS_OF).cast("timestamp")
    t = queue.apply_retry_policy(fixture(spark, d, TASKS), 3, as_of)
    return t.select("id", "retry_count", "status", (F.unix_seconds("next_allowed_at") - F.unix_seconds(as_of)).cast("int").alias("wait"))


@query("classify_error", f"SELECT id, CASE WHEN coalesce(error LIKE '%No such file%', false) THEN 'final' ELSE 'temp' END AS kind FROM {_TASKS}")
def _(spark, d):
    return fixture(spark, d, TASKS).select("id", text.classify_error(F.col("error")).alias("kind"))


@query("close_tasks", f"SELECT id, CASE WHEN status NOT IN ('pending', 'processing') THEN status WHEN id NOT IN (SELECT id FROM {_FILES}) THEN 'failed' WHEN id % 2 = 0 THEN (CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'completed' END) ELSE status END AS status FROM {_TASKS}")
def _(spark, d):
    t = fixture(spark, d, TASKS).withColumn("error", F.lit(None).cast("string")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    r = t.where("file_id % 2 = 0").select("file_id", F.when(F.col("file_id") % 4 == 0, "bad").alias("error"))
    return queue.close_tasks(t, files(spark, d), r, F.lit(_AS_OF).cast("timestamp")).select("id", "status")


@query("upsert_embeddings", "SELECT vec_id AS file_id, label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit("image").alias("embedding_type"), "label")
    return catalog.upsert_embeddings(e, e.where("file_id % 3 = 0").withColumn("label", F.col("label") + 100)).select("file_id", "label")


@query("delete_embeddings", "SELECT vec_id AS file_id FROM embeddings WHERE vec_id % 3 <> 0")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"))
    return catalog.delete_embeddings(e, e.where("file_id % 3 = 0"))


@query("get_embedding", "SELECT vec_id, round(list_inner_product(embedding, embedding), 4) AS norm2 FROM embeddings WHERE vec_id = 17 AND label >= 0")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("file_id", F.col("vec_id")).withColumn("embedding_type", F.lit("image"))
    return catalog.get_embedding(e, 17, "image").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


_MERGED = ", ".join([*(f"CASE WHEN n.doc_id % 2 = 0 THEN {new} WHEN o.doc_id IS NOT NULL THEN {old} END AS {c}" for c, new, old in (("caption", "'new'", "'old'"), ("tags", "'a,b'", "'c'"), ("objects", "'p'", "'q'"), ("mood", "'up'", "'down'"), ("contains_text", "true", "false"), ("is_sensitive", "false", "true"))), "CASE WHEN n.doc_id % 3 = 0 THEN 2.5e0 WHEN o.doc_id IS NOT NULL THEN 1.5e0 END AS video_duration",
  *(f"CASE WHEN n.doc_id % 7 < 3 THEN {new} WHEN o.doc_id IS NOT NULL THEN {old} END AS {c}" for c, new, old in (("latitude", "2e0", "1e0"), ("longitude", "2.5e0", "1.5e0"), ("altitude", "2e2", "1e2"))),
  *(f"CASE WHEN n.doc_id IS NOT NULL THEN {new} ELSE {old} END AS {c}" for c, new, old in (("aesthetic_score", "9e0", "5e0"), ("sharpness", "2e0", "1e0"), ("location_name", "CASE WHEN n.doc_id % 4 > 0 THEN 'there' END", "'here'"), ("scene_changes", "CASE WHEN n.doc_id % 5 = 1 THEN '7' ELSE '' END", "'3'"), ("analysis_version", "'2'", "'1'")))])


@query("merge_analysis", f"SELECT coalesce(n.doc_id, o.doc_id) AS file_id, {_MERGED} FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) n ON o.doc_id = n.doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    i, words = F.col("file_id"), lambda *xs: F.array(*map(F.lit, xs))
    old = docs.where("file_id % 3 <> 0").select(i, *(F.lit(v).alias(c) for c, v in (("caption", "old"), ("mood", "down"), ("contains_text", False), ("is_sensitive", True), ("video_duration", 1.5), ("latitude", 1.0), ("longitude", 1.5), ("altitude", 100.0), ("aesthetic_score", 5.0), ("sharpness", 1.0), ("location_name", "here"), ("analysis_version", "1"))), words("c").alias("tags"), words("q").alias("objects"), F.array(F.lit(3.0)).alias("scene_changes"))
    image, place = i % 2 == 0, i % 7 < 3
    new = docs.where("file_id % 5 <> 0").select(
        i, *(F.when(image, F.lit(v)).alias(c) for c, v in (("caption", "new"), ("mood", "up"), ("contains_text", True), ("is_sensitive", False))), F.when(i % 3 == 0, 2.5).alias("video_duration"), *(F.when(place, v).alias(c) for c, v in (("latitude", 2.0), ("longitude", 2.5), ("altitude", 200.0))),
        F.lit(9.0).alias("aesthetic_score"), F.lit(2.0).alias("sharpness"), F.when(i % 4 > 0, "there").alias("location_name"), F.lit("2").alias("analysis_version"), F.when(image, words("a", "b")).alias("tags"), F.when(image, words("p")).alias("objects"), F.when(i % 5 == 1, F.array(F.lit(7.0))).alias("scene_changes"),
    )
    merged = catalog.merge_analysis(old, new)
    return merged.withColumns({c: F.array_join(c, ",") for c in ("tags", "objects")} | {"scene_changes": F.array_join(F.transform("scene_changes", lambda x: x.cast("int").cast("string")), ",")})


@query("append_faces", f"SELECT id, CAST(confidence * 100 AS INT) AS bbox_x1, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 3 AS INT) END AS age FROM {_FACES}")
def _(spark, d):
    f = fixture(spark, d, FACES).select("id", *((F.round(F.col("confidence") * 100)).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")), (F.col("id") % 3).alias("age"), "eye_open_prob", F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("int").alias("cluster_id"))
    base = f.limit(0).withColumn("age", F.col("age").cast("int")).withColumns({f"bbox_{c}": F.col(f"bbox_{c}").cast("int") for c in ("x1", "y1", "x2", "y2")})
    return catalog.append_faces(base, f).select("id", "bbox_x1", "age")


# Text.
_TAG_STRIP = text.STRIPPED.replace("'", "''")
_STOP = ", ".join(map(repr, text.STOP_WORDS))


@query("caption_tags", f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS i FROM documents),
  c AS (SELECT doc_id, i, lower(trim(w, '{_TAG_STRIP}')) AS w FROM w), f AS (SELECT doc_id, w, min(i) AS i FROM c WHERE length(w) > 2 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY doc_id, w),
  r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
  SELECT d.doc_id, coalesce(t.tags, '') AS tags FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY r) AS tags FROM r WHERE r <= 15 GROUP BY doc_id) t ON d.doc_id = t.doc_id""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.caption_tags(F.col("text")), " ").alias("tags"))


_MOODS = {"p": ["the", "sunny", "happy"], "n": ["sad", "der", "dark"], "c": ["calm", "los", "quiet"]}


@query("caption_mood", "SELECT doc_id, CASE WHEN greatest(p, n, c) = 0 THEN NULL WHEN p >= n AND p >= c THEN 'positive' WHEN n >= c THEN 'negative' ELSE 'calm' END AS mood FROM (SELECT doc_id, " + ", ".join(" + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) + f" AS {k}" for k, ws in _MOODS.items()) + " FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.caption_mood(F.col("text"), *_MOODS.values()).alias("mood"))


@query("caption_sensitive", f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(text.SENSITIVE)}') OR source = 'src3' AS sensitive FROM documents")
def _(spark, d):
    labels = F.array(F.when(F.col("source") == "src3", "Knife").otherwise("cup"))
    return table(spark, d, "documents").select("doc_id", text.caption_sensitive(F.col("text"), labels).alias("sensitive"))


@query("embedding_text", "SELECT doc_id, trim(concat_ws(' ', nullif(lang, ''), source)) AS t FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.embedding_text(F.col("lang"), F.array("source")).alias("t"))


@query("contains_text", "SELECT doc_id, coalesce(length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), 0) > 3 AS has, coalesce(length(trim(lang, ' ')), 0) > 3 AS lang_has FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.contains_text(F.col("text")), F.lit(False)).alias("has"), F.coalesce(text.contains_text(F.col("lang")), F.lit(False)).alias("lang_has"))


@query("event_key", "SELECT event_id, md5(concat(event_type, '|', 'user' || user_id, CASE WHEN event_id % 3 = 0 THEN '|to' || user_id ELSE '' END)) AS k FROM events")
def _(spark, d):
    user = F.col("user_id").cast("string")
    to = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("To"), user)).when(F.col("event_id") % 3 == 1, "")
    return table(spark, d, "events").select("event_id", text.event_key(F.col("event_type"), F.concat(F.lit("User"), user), to).alias("k"))


@query("object_labels", f"""SELECT file_id, string_agg(l, ',' ORDER BY l) AS labels FROM (SELECT DISTINCT file_id, l FROM (SELECT file_id, concat('p', CAST(person_id AS STRING)) AS l, row_number() OVER (PARTITION BY file_id ORDER BY id, concat('p', CAST(person_id AS STRING)), confidence) AS r FROM {_FACES} WHERE confidence >= 0.5) WHERE r <= 3) GROUP BY file_id""")
def _(spark, d):
    objects = fixture(spark, d, FACES).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("p"), F.col("person_id").cast("string")).alias("label"), F.col("confidence").alias("score")))).alias("o"))
    return objects.select("file_id", F.array_join(text.object_labels(F.col("o"), 0.5, 3), ",").alias("labels")).where("labels <> ''")


def _sensitive(col: str) -> str:
    rules = [(k, f"len(regexp_extract_all({col}, '(?i){p}'))".replace("'", "'")) for k, p in sensitivity.PATTERNS.items()]
    case = " ".join(f"WHEN {n} > 0 THEN '{k}'" for k, n in rules)
    conf = " ".join(f"WHEN {n} > 0 THEN least(0.9, {n} * 0.3)" for _, n in rules)
    lines = f"len(string_split(trim({col}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), chr(10)))"
    return f"CASE {case} WHEN {lines} > 5 THEN 'document' END AS c_text, round(CASE {conf} WHEN {lines} > 5 THEN 0.7 END, 6) AS f_text"


_BY_NAME = "CASE " + " ".join(f"WHEN contains(lower(regexp_extract(name, '[^/]*$')), '{w}') THEN '{k}'" for k, ws in sensitivity.NAME_WORDS.items() for w in ws) + " END"


@query("scan_text", f"SELECT doc_id, c_text AS category, CAST(f_text AS DOUBLE) AS confidence FROM (SELECT doc_id, {_sensitive('text')} FROM documents)")
def _(spark, d):
    return sensitivity.scan_text(table(spark, d, "documents"), "text").select("doc_id", F.col("result.category").alias("category"), F.round("result.confidence", 6).alias("confidence"))


@query("scan_name", f"SELECT id, {_BY_NAME} AS category FROM {_DOCS}")
def _(spark, d):
    return sensitivity.scan_name(fixture(spark, d, DOCS), "name").select("id", F.col("result.category").alias("category"))


_CASCADE = f"SELECT id, CASE WHEN is_sensitive THEN 'ai_flagged' WHEN contains_text AND c_text IS NOT NULL THEN c_text WHEN c_name IS NOT NULL THEN c_name ELSE 'safe' END AS category, CASE WHEN is_sensitive THEN NULL WHEN contains_text AND c_text IS NOT NULL THEN f_text WHEN c_name IS NOT NULL THEN 0.8 ELSE 0 END AS confidence FROM (SELECT id, is_sensitive, contains_text, {_BY_NAME} AS c_name, {_sensitive('text')} FROM {_DOCS})"


@query("detect_sensitive", f"SELECT id, category, CAST(confidence AS DOUBLE) AS confidence FROM ({_CASCADE})")
def _(spark, d):
    return sensitivity.detect_sensitive(fixture(spark, d, DOCS)).select("id", F.col("result.category").alias("category"), F.round("result.confidence", 6).alias("confidence"))


@query("sensitivity_summary", f"WITH c AS ({_CASCADE}) SELECT category, count(*) AS files, round(avg(confidence), 6) AS mean_confidence, (SELECT count(*) FROM c) AS scanned, (SELECT count(*) FROM c WHERE category <> 'safe') AS sensitive FROM c GROUP BY category")
def sensitivity_report(spark, d):
    return sensitivity.sensitivity_summary(sensitivity.detect_sensitive(fixture(spark, d, DOCS)))


_KEY = "0123456789abcdef"


@query("quarantine_restore", f"SELECT id, md5(text) AS hash, concat('restored_', name) AS name FROM (SELECT a.id, a.text, a.name FROM {_DOCS} a JOIN ({_CASCADE}) c ON a.id = c.id WHERE c.category <> 'safe' AND a.id % 4 = 0)")
def _(spark, d):
    _, vault = sensitivity.quarantine(sensitivity.detect_sensitive(fixture(spark, d, DOCS)), _KEY)
    back = sensitivity.restore(vault, vault.where("id % 4 = 0").select("id"), _KEY)
    return back.select("id", F.md5("text").alias("hash"), "name")


@query("vault_listing", f"SELECT a.id, a.name, c.category FROM {_DOCS} a JOIN ({_CASCADE}) c ON a.id = c.id WHERE c.category <> 'safe' AND a.id % 4 <> 0")
def _(spark, d):
    base, when = fresh_dir(spark, "vault"), lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    scanned = sensitivity.detect_sensitive(fixture(spark, d, DOCS))
    for _again in range(2):  # what lies there already is not put in again
        vault.deposit(scanned, base, _KEY, when(1))
    vault.take_out(scanned.where("id % 4 = 0").select("id"), base, _KEY, when(2))
    return vault.listing(vault.read_ledger(spark, base)).select("id", "name", "category")


@query("quarantine_safe", f"SELECT id FROM ({_CASCADE}) WHERE category = 'safe'")
def _(spark, d):
    return sensitivity.quarantine(sensitivity.detect_sensitive(fixture(spark, d, DOCS)), _KEY)[0].select("id")


# Bursts.
def captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/c/"), F.col("event_id").cast("string")).alias("path"), "user_id", "value")


def _bursts(gap_us: int, part: str = "") -> str:
    over = f"OVER ({part} ORDER BY epoch_us(ts), '/c/' || event_id)"
    keys = f"{part.replace('PARTITION BY', '') + ', ' if part else ''}burst"
    return f"""(WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) {over} <= {gap_us} THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, CAST(sum(n) {over} AS BIGINT) AS burst FROM s)
  SELECT event_id AS id, user_id, value, ts, burst FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS size FROM b) WHERE size >= 2)"""


@query("bursts_global", f"SELECT id, burst FROM {_bursts(60_000_000)}")
def _(spark, d):
    return bursts.detect_bursts(captures(spark, d), gap=60.0).select("id", "burst")


@query("bursts_per_user", f"SELECT id, user_id, burst FROM {_bursts(600_000_000, 'PARTITION BY user_id')}")
def _(spark, d):
    return bursts.detect_bursts(captures(spark, d), gap=600.0, partition="user_id").select("id", "user_id", "burst")


@query("burst_id", f"""SELECT burst, 'burst_' || strftime(min(ts), '%Y%m%d_%H%M%S') || '_' || substr(md5(string_agg('/c/' || id || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END, '' ORDER BY ts, '/c/' || id)), 1, 8) AS burst_id FROM {_bursts(60_000_000)} GROUP BY burst""")
def _(spark, d):
    return bursts.burst_id(bursts.detect_bursts(captures(spark, d), gap=60.0), ["burst"])


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY burst ORDER BY value DESC, ts, '/c/' || id) AS r FROM {_bursts(60_000_000)})"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return bursts.detect_bursts(captures(spark, d), gap=60.0).withColumnRenamed("value", "score")


@query("select_best", f"SELECT id, burst FROM {_RANKED} WHERE r <= 1")
def _(spark, d):
    return bursts.select_best(ranked(spark, d), ["burst"]).select("id", "burst")


@query("cull_actions", f"SELECT id, burst, CASE WHEN r <= 1 THEN 'keep' ELSE 'mark' END AS action, first_value('/c/' || id) OVER (PARTITION BY burst ORDER BY r) AS best FROM {_RANKED}")
def _(spark, d):
    return bursts.cull_actions(ranked(spark, d), ["burst"]).select("id", "burst", "action", "best")


@query("culling_totals", f"SELECT count(DISTINCT burst) AS bursts, count(*) AS photos, count(*) FILTER (r <= 1) AS kept, count(*) FILTER (r > 1) AS culled FROM {_RANKED}")
def _(spark, d):
    return bursts.culling_totals(bursts.burst_summary(bursts.cull_actions(ranked(spark, d), ["burst"]), ["burst"]))


@query("burst_summary", f"SELECT burst, count(*) AS photos, count(*) FILTER (r <= 1) AS kept, count(*) FILTER (r > 1) AS culled, max('/c/' || id) FILTER (r = 1) AS best FROM {_RANKED} GROUP BY burst")
def _(spark, d):
    return bursts.burst_summary(bursts.cull_actions(ranked(spark, d), ["burst"]), ["burst"])


_FACE = f"(SELECT f.id, coalesce(0.7 * avg(x.confidence) + 0.3 * least(1.0, count(x.id) / 10), 0.3) AS face, coalesce(avg(x.eye_open_prob), 0.5) AS eye FROM {_FILES} f LEFT JOIN {_FACES} x ON f.id = x.file_id GROUP BY f.id)"


@query("face_score", f"SELECT id, round(face, 6) AS face_score FROM {_FACE}")
def _(spark, d):
    return bursts.face_score(files(spark, d), fixture(spark, d, FACES)).select("id", F.round("face_score", 6).alias("face_score"))


@query("eye_score", f"SELECT id, round(eye, 6) AS eye_score FROM {_FACE}")
def _(spark, d):
    return bursts.eye_score(files(spark, d), fixture(spark, d, FACES)).select("id", F.round("eye_score", 6).alias("eye_score"))


@query("photo_score", f"SELECT id, round(5e-2 + 4e-1 * 3e-1 + face * 2.5e-1 + eye * 2e-1 + 6e-1 * 1.5e-1, 6) AS score FROM {_FACE}")
def _(spark, d):
    f, x = files(spark, d), fixture(spark, d, FACES)
    rows = bursts.face_score(f, x).join(bursts.eye_score(f, x), "id")
    return rows.select("id", F.round(bursts.photo_score(F.lit(0.4), F.col("face_score"), F.col("eye_score"), F.lit(0.6)), 6).alias("score"))


# Vectors.
def queries_and_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding", F.when(F.col("label") % 2 == 0, "image").otherwise("face").alias("embedding_type"), "label")
    return e.where("file_id % 50 = 0").select(F.col("file_id").alias("id"), "embedding"), e


_V = "(SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings)"
_COS = "round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6)"
_L2 = "round(1 / (1 + (list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e))), 6)"


def _pairs_sql(score: str, where: str = "true") -> str:
    return f"(SELECT a.vec_id AS query_id, b.vec_id AS file_id, b.label, {score} AS similarity FROM {_V} a, {_V} b WHERE a.vec_id % 50 = 0 AND {where})"


def _top(score: str, k: int, least: float, where: str = "true") -> str:
    return f"SELECT query_id, file_id, rank, similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, file_id) AS INT) AS rank FROM {_pairs_sql(score, where)}) WHERE rank <= {k} AND similarity >= {least}"


_TOP = ["query_id", "file_id", "rank", "similarity"]


@query("search_cosine", _top(_COS, 10, 0.25))
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.search_similar(q, v, 10, 0.25).select(_TOP)


@query("search_typed", _top(_COS, 5, 0.0, "b.label % 2 = 0"))
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.search_similar(q, v, 5, 0.0, "image").select(_TOP)


@query("search_l2", _top(_L2, 10, 0.0))
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.search_similar(q, v, 10, 0.0, metric="l2").select(_TOP)


@query("search_cosine_distance", _top(_COS, 3, 0.0))
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.search_similar(q, v, 3, 0.0, metric="cosine_distance").select(_TOP)


@query("find_similar", f"SELECT query_id, file_id, similarity FROM {_pairs_sql(_COS)} WHERE similarity >= 0.3")
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.find_similar(q, v, 0.3)


@query("search_approx")
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.search_approx(q, v, 10).select(_TOP)


@query("normalize_vectors", "SELECT vec_id, round(2 * CAST(embedding[1] AS DOUBLE) / sqrt(4 * list_inner_product([CAST(x AS DOUBLE) for x in embedding], [CAST(x AS DOUBLE) for x in embedding])), 6) AS first FROM embeddings")
def _(spark, d):
    v = F.transform("embedding", lambda x: x * 2)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(vectors.normalize(v), F.lit(0)), 6).alias("first"))


@query("match_persons", f"SELECT query_id AS face_id, label AS person_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label) AS INT) AS rank FROM (SELECT query_id, CAST(label AS BIGINT) AS label, max(similarity) AS similarity FROM {_pairs_sql(_COS, 'a.vec_id <> b.vec_id')} WHERE similarity >= 0.25 GROUP BY query_id, label)")
def _(spark, d):
    q, v = queries_and_vectors(spark, d)
    return search.match_persons(q, v.where("file_id % 50 <> 0").select(F.col("label").cast("long").alias("person_id"), "embedding").unionByName(v.where("file_id % 50 = 0 and false").select(F.col("label").cast("long").alias("person_id"), "embedding")), 0.25)


ORACLE_SQL["match_persons"] = ORACLE_SQL["match_persons"].replace("a.vec_id <> b.vec_id", "b.vec_id % 50 <> 0")


@query("aesthetic_score", f"SELECT v.vec_id, round(exp({_COS.replace('round(', '(').replace(', 6)', ')')}) / (exp({_COS.replace('round(', '(').replace(', 6)', ')')}) + exp({_COS.replace('round(', '(').replace(', 6)', ')').replace('b.', 'c.')})), 6) AS score FROM {_V} v, (SELECT vec_id, e FROM {_V}) a, {_V} b, {_V} c WHERE a.vec_id = v.vec_id AND b.vec_id = 0 AND c.vec_id = 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("e"))
    prompt = {r.vec_id: F.array(*map(F.lit, r.e)) for r in e.where("vec_id in (0, 1)").collect()}  # two prompts
    return e.select("vec_id", F.round(vectors.aesthetic_score(F.col("e"), prompt[0], prompt[1]), 6).alias("score"))


# Clusters of the standardised vectors: cores by counts, chains of cores by recursion, borders to the lowest cluster, noise by id.
_CLUSTERED = """WITH RECURSIVE x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
  s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS dev FROM x GROUP BY dim),
  v AS (SELECT id, list((x - mean) / CASE WHEN dev > 0 THEN dev ELSE 1 END ORDER BY dim) AS v FROM x JOIN s USING (dim) GROUP BY id),
  near AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON list_distance(a.v, b.v) <= 9.5),
  core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 2),
  link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id WHERE reach.root < link.b),
  root AS (SELECT id, min(root) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)),
  lab AS (SELECT id, cluster FROM root JOIN num USING (root)),
  every AS (SELECT v.id, coalesce(lab.cluster, (SELECT min(l.cluster) FROM near n JOIN lab l ON n.b = l.id WHERE n.a = v.id)) AS cluster FROM v LEFT JOIN lab ON v.id = lab.id),
  clustered AS (SELECT id, CAST(CASE WHEN cluster IS NOT NULL THEN cluster ELSE -row_number() OVER (PARTITION BY cluster IS NULL ORDER BY id) END AS BIGINT) AS cluster FROM every)"""


@query("cluster_vectors", f"{_CLUSTERED} SELECT id, cluster FROM clustered")
def _(spark, d):
    return clustering.cluster_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 9.5)


@query("person_rollup", f"SELECT x.person_id, count(DISTINCT x.file_id) AS photo_count, count(*) AS face_count, CAST(min(f.mtime) AS BIGINT) AS first_seen, CAST(max(f.mtime) AS BIGINT) AS last_seen FROM {_FACES} x JOIN {_FILES} f ON x.file_id = f.id GROUP BY x.person_id")
def _(spark, d):
    r = clustering.person_rollup(fixture(spark, d, FACES), files(spark, d).withColumn("ingested_at", F.timestamp_seconds("mtime")))
    return r.select("person_id", "photo_count", "face_count", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"))


@query("centroids", "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last FROM embeddings GROUP BY label")
def _(spark, d):
    return clustering.centroids(table(spark, d, "embeddings"), "label").select("label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(63)), 6).alias("last"))


@query("assign_clusters", "SELECT DISTINCT CAST(label AS BIGINT) AS cluster, CAST(CASE WHEN label % 3 < 2 THEN 100 + label ELSE 109 + (label + 1) // 3 END AS BIGINT) AS person_id, label % 3 = 2 AS is_new FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"), "embedding")
    return clustering.assign_clusters(e, e.where("cluster % 3 < 2").select((F.col("cluster") + 100).alias("person_id"), "embedding"), 0.999)


# Places.
_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query("within_radius", f"SELECT a.id AS center_id, b.id AS point_id, round({_HAVERSINE}, 6) AS distance_km, round(1 - {_HAVERSINE} / 700, 6) AS confidence FROM {_CENTERS} a, {_POINTS} b WHERE {_HAVERSINE} <= 700")
def _(spark, d):
    return places.within_radius(fixture(spark, d, CENTERS), fixture(spark, d, POINTS), 700.0)


@query("haversine", f"SELECT a.id, round({_HAVERSINE}, 6) AS km FROM {_POINTS} a, (SELECT 48.85 AS lat, 2.35 AS lon) b")
def _(spark, d):
    return fixture(spark, d, POINTS).select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 6).alias("km"))


@query("lookup_places", f"SELECT a.id, b.name AS place FROM {_POINTS} a LEFT JOIN (SELECT lat, lon, max(concat('s', lpad(CAST(id AS STRING), 9, '0'))) AS name FROM {_CENTERS} WHERE id % 10 < 7 OR id % 20 = 17 GROUP BY lat, lon) b ON a.lat = b.lat AND a.lon = b.lon")
def _(spark, d):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    c = fixture(spark, d, CENTERS).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), F.timestamp_micros(F.unix_micros(as_of) - (F.col("id") % 10) * 86_400_000_000 + F.when(F.col("id") % 20 == 7, 0).otherwise(F.col("id"))).alias("timestamp"))  # some are of just that age
    return places.lookup_places(fixture(spark, d, POINTS), c, as_of).select("id", "place")


@query("dms_to_decimal", "SELECT p_partkey, round((p_size + (p_partkey % 60) / 60.0 + 30 / 3600.0) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS deg FROM part")
def _(spark, d):
    v = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double"), F.lit(30.0))
    return table(spark, d, "part").select("p_partkey", F.round(geo.dms_to_decimal(v, F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("N")), 6).alias("deg"))


@query("geo_key", f"SELECT id, printf('%.4f,%.4f', lat, lon) AS k FROM {_POINTS}")
def _(spark, d):
    return fixture(spark, d, POINTS).select("id", geo.geo_key(F.col("lat"), F.col("lon")).alias("k"))


@query("addresses", "SELECT n_nationkey, concat(n_name, ', ', r_name) AS short, concat_ws(', ', nullif(n_name, 'FRANCE'), r_name) AS long FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    address = F.map_from_arrays(F.array(F.lit("town"), F.lit("country")), F.array(F.nullif(F.col("n_name"), F.lit("FRANCE")), F.col("r_name")))
    return rows.select("n_nationkey", geo.short_location(F.col("n_name"), F.col("r_name"), none, F.lit(0.0), F.lit(0.0)).alias("short"), geo.formatted_address(none, address, none, none, none).alias("long"))


# Images and video.
@query("luma_stats", "SELECT vec_id, round(list_avg(l) / 255, 6) AS brightness, round(list_stddev_pop(l) / 255, 6) AS contrast FROM (SELECT vec_id, [CAST(x AS DOUBLE) * 128 + 128 for x in embedding] AS l FROM embeddings)")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 128 + 128).alias("luma"))
    return images.luma_stats(e).select("vec_id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))


_LAPLACE = """(WITH p AS (SELECT vec_id, [CAST(x AS DOUBLE) * 128 + 128 for x in embedding] AS e FROM embeddings), l AS (
  SELECT vec_id, [e[8 * abs(i // 8 - 1) + i % 8 + 1] + e[8 * (CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END) + i % 8 + 1] + e[8 * (i // 8) + abs(i % 8 - 1) + 1] + e[8 * (i // 8) + (CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END) + 1] - 4 * e[i + 1] for i in range(64)] AS v,
    [coalesce(CASE WHEN i // 8 > 0 THEN e[i - 7] END, 0) + coalesce(CASE WHEN i // 8 < 7 THEN e[i + 9] END, 0) + coalesce(CASE WHEN i % 8 > 0 THEN e[i] END, 0) + coalesce(CASE WHEN i % 8 < 7 THEN e[i + 2] END, 0) - 4 * e[i + 1] for i in range(64)] AS z, e FROM p)
  SELECT vec_id, list_var_pop(v) AS variance, list_avg([x / 255 * x / 255 for x in z]) AS energy, list_avg(e) / 255 AS brightness, list_stddev_pop(e) / 255 AS contrast FROM l)"""


@query("sharpness", f"SELECT vec_id, round(least(1.0, variance / 500), 6) AS sharpness, CASE WHEN variance < 100 THEN 1e0 ELSE 0e0 END AS blur, round(least(1.0, energy / 0.02), 6) AS energy_form FROM {_LAPLACE}")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 128 + 128).alias("luma"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    both = images.sharpness(images.sharpness(e).withColumnsRenamed({"sharpness": "s", "blur": "b"}), form="energy")
    return both.select("vec_id", F.round("s", 6).alias("sharpness"), F.col("b").alias("blur"), F.round("sharpness", 6).alias("energy_form"))


@query("image_geometry", "SELECT p_partkey, p_size / 25.0 AS aspect_ratio, CASE WHEN p_size > 25 THEN 'landscape' WHEN p_size < 25 THEN 'portrait' ELSE 'square' END AS orientation FROM part")
def _(spark, d):
    g = images.image_geometry(table(spark, d, "part").withColumn("h", F.lit(25)), "p_size", "h")
    return g.select("p_partkey", "aspect_ratio", "orientation")


@query("palette_hex", "SELECT p_partkey, printf('#%02x%02x%02x', p_size, CAST(p_partkey % 256 AS INT), 7) AS hex FROM part")
def _(spark, d):
    c = F.array(F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 256).cast("int"), F.lit(7)))
    return table(spark, d, "part").select("p_partkey", images.palette_hex(c).alias("hex"))


@query("dominant_colors", """SELECT image_id, concat('[', string_agg(color, ',' ORDER BY red), ']') AS colors FROM (SELECT l_orderkey % 50 AS image_id, CASE WHEN l_linenumber <= 3 THEN '[200,0,17]' WHEN l_linenumber <= 5 THEN '[40,240,9]' ELSE '[0,0,255]' END AS color, CASE WHEN l_linenumber <= 3 THEN 200 WHEN l_linenumber <= 5 THEN 40 ELSE 0 END AS red
  FROM lineitem GROUP BY ALL) GROUP BY image_id""")
def _(spark, d):
    color = lambda *c: F.array(*map(F.lit, c))
    rgb = F.when(F.col("l_linenumber") <= 3, color(200, 0, 17)).when(F.col("l_linenumber") <= 5, color(40, 240, 9)).otherwise(color(0, 0, 255))
    pixels = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image_id"), rgb.alias("rgb"))
    return images.dominant_colors(pixels).select("image_id", F.to_json(F.array_sort("colors")).alias("colors"))


@query("keyframe_times", "SELECT p_partkey, unnest(range(0, p_size, 10)) AS frame_time FROM part WHERE p_size >= 1")
def _(spark, d):
    return video.keyframe_times(table(spark, d, "part"), 10, "p_size").select("p_partkey", F.col("frame_time").cast("long").alias("frame_time"))


@query("middle_time", "SELECT p_partkey, CASE WHEN p_size > 10 THEN (p_size - 10) / 2.0 ELSE 0 END AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", video.middle_time((F.col("p_size") - 10).cast("double")).alias("t"))


@query("scene_changes", """WITH f AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), g AS (SELECT label, vec_id, unnest(e) AS x, unnest(p) AS y FROM f WHERE p IS NOT NULL)
  SELECT v.label AS video_id, count(h.vec_id) AS n, CAST(coalesce(sum(h.vec_id), 0) AS BIGINT) AS total FROM (SELECT DISTINCT label FROM embeddings) v LEFT JOIN (SELECT label, vec_id, avg(abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))) AS diff FROM g GROUP BY label, vec_id) h ON v.label = h.label AND h.diff * 128 > 0.07 * 255 GROUP BY v.label""")
def _(spark, d):
    f = table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").cast("double").alias("frame_ts"), F.transform("embedding", lambda x: x.cast("double") * 128).alias("luma"))
    return video.scene_changes(f, 0.07).select("video_id", F.size("scene_changes").cast("long").alias("n"), F.aggregate("scene_changes", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


@query("stable_files", """WITH s AS (SELECT user_id AS path, epoch_us(ts) AS t, event_id, CAST(floor(value / 40) AS INT) AS size FROM events), c AS (SELECT *, CASE WHEN size = lag(size) OVER w THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY path ORDER BY t, event_id)),
  i AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY t, event_id) AS island FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY path, island ORDER BY t, event_id) AS nth FROM i) SELECT path, min(t) AS stable_us FROM r WHERE nth = 4 GROUP BY path""")
def _(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("path"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("ts"), F.floor(F.col("value") / 40).alias("size"))
    return video.stable_files(s).select("path", F.col("stable_at.t").alias("stable_us"))


# Records.
@query("parse_model_answers", r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN substr(split_part(coalesce(text, ''), chr(10), 1), 1, 200) ELSE coalesce(text, '') END AS caption, CASE WHEN turn % 4 = 1 THEN 'neutral' ELSE 'happy' END AS mood FROM conversations""")
def _(spark, d):
    """By turn: a closed fence, prose, a json fence after another one, a fence that is cut off before its end."""
    said = F.coalesce("text", F.lit(""))
    data, kind = F.to_json(F.struct(said.alias("caption"), F.lit("happy").alias("mood"))), F.col("turn") % 4
    answer = F.when(kind == 0, F.concat(F.lit("Here:\n```\n"), data, F.lit("\n```"))).when(kind == 1, said).when(kind == 2, F.concat(F.lit("```\nplan\n```\n```json\n"), data, F.lit("\n```"))).otherwise(F.concat(F.lit("```json\n"), data))
    return records.parse_model_answers(table(spark, d, "conversations").withColumn("answer", answer)).select("conv_id", "turn", "parsed.caption", "parsed.mood")


@query("parse_probe", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS duration, CAST(p_partkey AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 5 * 1e1 END AS fps FROM part")
def _(spark, d):
    m = F.col("p_partkey") % 5
    s = F.struct(F.lit("video").alias("codec_type"), F.concat((m * 10).cast("string"), F.lit("/"), F.least(m, F.lit(1)).cast("string")).alias("r_frame_rate"))
    probe = F.to_json(F.struct(F.struct(F.col("p_size").cast("string").alias("duration"), F.col("p_partkey").cast("string").alias("size")).alias("format"), F.array(s).alias("streams")))
    return records.parse_probe(table(spark, d, "part").withColumn("probe", probe)).select("p_partkey", "duration", "size", "fps")


@query("metadata_projection", "SELECT doc_id, CASE WHEN text <> '' THEN substr(text, 1, 1000) END AS caption, CASE WHEN lang <> '' THEN concat('Mood: ', lang) END AS mood, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(CAST(floor((doc_id % 11) / 2) AS INT) AS STRING) END AS rating FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), F.array("source").alias("tags"), F.col("lang").alias("mood"), (F.col("doc_id") % 11).cast("double").alias("aesthetic_score"))
    m = records.metadata_projection(docs)
    return m.select("doc_id", F.element_at("metadata", "XPComment").alias("caption"), F.element_at("metadata", "UserComment").alias("mood"), F.element_at("metadata", "Rating").alias("rating"))


@query("verify_metadata", "SELECT doc_id, coalesce(text <> '', false) AS has_description, doc_id % 11 <> 0 AS has_rating FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), F.array("source").alias("tags"), F.col("lang").alias("mood"), (F.col("doc_id") % 11).cast("double").alias("aesthetic_score"))
    return records.verify_metadata(records.metadata_projection(docs)).select("doc_id", F.coalesce("has_description", F.lit(False)).alias("has_description"), F.coalesce("has_rating", F.lit(False)).alias("has_rating"))


@query("analysis_json", "SELECT doc_id, concat('{\"doc_id\":', doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat(',\"lang\":\"', lang, '\"') END, '}') AS json FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", records.analysis_json(["doc_id", "lang"]).alias("json"))


# File events.
def file_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("created"), F.lit("modified"), F.lit("deleted"), F.lit("moved")), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/w/u"), F.col("user_id").cast("string"), F.element_at(F.array(F.lit(".jpg"), F.lit(".tmp"), F.lit(".cr2")), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, d, "events").select("event_id", kind.alias("event_type"), path.alias("src_path"), F.lit(None).cast("string").alias("dest_path"), (F.col("event_id") % 10 == 0).alias("is_directory"), F.col("ts").cast("timestamp").alias("ts"), F.lit("disk").alias("source"))


_EVENTS = "(SELECT event_id, ['created', 'modified', 'deleted', 'moved'][CAST(event_id % 4 + 1 AS INT)] AS event_type, concat('/w/u', user_id, ['.jpg', '.tmp', '.cr2'][CAST(event_id % 3 + 1 AS INT)]) AS src_path, event_id % 10 = 0 AS is_directory, epoch_us(ts) AS t FROM events)"


@query("filter_events", f"SELECT event_id FROM {_EVENTS} WHERE NOT is_directory AND src_path NOT LIKE '%.tmp'")
def _(spark, d):
    return watch.filter_events(file_events(spark, d)).select("event_id")


@query("event_priority", f"SELECT event_id, CASE event_type WHEN 'created' THEN 10 WHEN 'moved' THEN 8 WHEN 'modified' THEN 5 ELSE 3 END AS priority FROM {_EVENTS}")
def _(spark, d):
    return file_events(spark, d).select("event_id", watch.event_priority(F.col("event_type")).alias("priority"))


_DEBOUNCED = f"""(WITH s AS (SELECT *, CASE event_type WHEN 'modified' THEN 0.5 WHEN 'deleted' THEN 2 ELSE 1 END * 600000000 AS gap FROM {_EVENTS}), n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= gap THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY event_type, src_path ORDER BY t)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY event_type, src_path ORDER BY t) AS g FROM n) SELECT event_type, src_path, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM b GROUP BY event_type, src_path, g)"""


@query("debounce", f"SELECT * FROM {_DEBOUNCED}")
def _(spark, d):
    return watch.debounce(file_events(spark, d), 600_000).select("event_type", "src_path", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n")


@query("event_stats", f"SELECT (SELECT count(*) FROM events) AS received, (SELECT count(*) FROM events) - CAST(sum(n) AS BIGINT) AS dropped, CAST(sum(n - 1) AS BIGINT) AS debounced, count(*) AS processed, round(avg(n), 6) AS mean_batch FROM {_DEBOUNCED}")
def _(spark, d):
    e = file_events(spark, d)
    return watch.event_stats(e, watch.debounce(e, 600_000))


@query("batch_events", f"""WITH s AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, src_path, event_type) <= 60000000 THEN 0 ELSE 1 END AS new FROM {_EVENTS}), b AS (SELECT *, sum(new) OVER (ORDER BY t, src_path, event_type) AS g FROM s), r AS (SELECT *, floor((row_number() OVER (PARTITION BY g ORDER BY t, src_path, event_type) - 1) / 100) AS chunk FROM b)
  SELECT src_path, event_type, count(*) AS n, max(t) AS last_us FROM r GROUP BY g, chunk, src_path, event_type HAVING event_type <> 'modified' OR count(*) >= 3""")
def _(spark, d):
    return watch.batch_events(file_events(spark, d), idle="60 seconds").select("src_path", "event_type", "n", F.unix_micros("last_seen").alias("last_us"))


@query("apply_events", f"SELECT event_id, CASE WHEN event_type IN ('created', 'moved') THEN 'ingest' WHEN event_type = 'deleted' THEN 'mark_deleted' WHEN src_path LIKE '%.cr2' THEN 'reingest' ELSE 'none' END AS action FROM {_EVENTS}")
def _(spark, d):
    return watch.apply_events(file_events(spark, d)).select("event_id", "action")


# Sources and sinks: written to the shared folder and read back.
@query("scan_library", "SELECT o_orderstatus AS status, count(*) > 0 AS found, CAST(sum(octet_length(encode(o_orderpriority)) + 1) AS BIGINT) AS bytes FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    base = fresh_dir(spark, "library")
    table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").write.partitionBy("o_orderstatus").text(base)
    found = library.scan_library(spark, base, extensions=["txt"]).select(F.regexp_extract("path", "o_orderstatus=(.)", 1).alias("status"), "size")
    return found.groupBy("status").agg((F.count("*") > 0).alias("found"), F.sum("size").alias("bytes"))


@query("catalog_tables", "SELECT concat('k', CAST(c_custkey AS STRING)) AS key, CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN 'old' END AS value FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.lit(None).cast("timestamp").alias("updated_at"))
    kept = Catalog(spark, fresh_dir(spark, "catalog"), buckets=8)
    kept.commit(upserts={"settings": rows.where("c_custkey % 3 = 0").withColumn("value", F.lit("old"))})
    for _again in range(2):  # a batch given twice
        kept.commit(upserts={"settings": rows.where("c_custkey % 5 = 0").withColumn("value", F.lit("new"))}, stream="s", batch=0)
    return kept.read("settings").select("key", "value")


@query("export_metadata", "SELECT doc_id AS file_id, concat('Mood: ', lang) AS mood FROM documents WHERE lang <> ''")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("").alias("caption"), F.array().cast("array<string>").alias("tags"), F.col("lang").alias("mood"), F.lit(None).cast("double").alias("aesthetic_score"), "source")
    base = fresh_dir(spark, "export")
    library.export_metadata(records.metadata_projection(docs).where(F.size("metadata") > 0), base, ["source"])
    back = spark.read.schema("file_id long, metadata map<string,string>").json(base)
    return back.select("file_id", F.element_at("metadata", "UserComment").alias("mood"))


@query("stream_callbacks", f"SELECT event_type, count(*) AS n, 4 AS most_batches, true AS bounded FROM {_EVENTS} WHERE event_type IN ('created', 'deleted') GROUP BY event_type")
def _(spark, d):
    base, log = fresh_dir(spark, "callbacks"), fresh_dir(spark, "event-log")
    for k in range(4):
        file_events(spark, d).where(F.col("event_id") % 4 == k if k else F.col("event_id") % 4 == 0).coalesce(1).write.mode("append").parquet(log)
    schema = spark.read.parquet(log).schema
    for kind in ("created", "deleted"):
        count = lambda b, n: b.groupBy("event_type").count().withColumn("batch", F.lit(n)).write.mode("append").parquet(base)
        watch.on_batch(library.event_stream(spark, log, schema, max_files=1), count, fresh_dir(spark, "callback-state"), kind).awaitTermination()
    found = spark.read.schema("event_type string, count long, batch int").parquet(base).groupBy("event_type").agg(F.sum("count").alias("n"), F.max("batch").alias("b"))
    return found.select("event_type", "n", F.lit(4).alias("most_batches"), (F.col("b") < 4).alias("bounded"))


@query("burst_windows", """WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 600000000 THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS g FROM s)
  SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM b GROUP BY user_id, g HAVING count(*) >= 2""")
def _(spark, d):
    return watch.detect_bursts_stream(captures(spark, d), "user_id", "600 seconds").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("dedupe_events", f"SELECT DISTINCT event_type, src_path FROM {_EVENTS}")
def _(spark, d):
    return watch.dedupe_stream(file_events(spark, d).select("event_type", "src_path"), ["event_type", "src_path"])


# Jobs.
# A third of the documents is stored; the others are found by a scan, some with a known path, some unreadable.
_STORED_PATH = "CASE WHEN id % 30 = 0 THEN concat('/lib/seen/', CAST(id + 1 AS STRING), '.jpg') ELSE path END"
_FOUND_PATH = "CASE WHEN id % 30 = 1 THEN concat('/lib/seen/', CAST(id AS STRING), '.jpg') WHEN id % 30 = 2 THEN concat('/lib/', CAST(id AS STRING), '.tmp') ELSE path END"
_INGEST = f"""WITH f AS ({_PRINTED}), s AS (SELECT *, {_STORED_PATH} AS p FROM f WHERE id % 3 = 0),
  l AS (SELECT *, {_FOUND_PATH} AS p FROM f WHERE id % 3 <> 0 AND id % 30 <> 2), x AS (SELECT *, id % 31 = 4 AS bad FROM l WHERE p NOT IN (SELECT p FROM s)),
  o AS (SELECT x.*, (SELECT min(s.id) FROM s WHERE s.file_hash = x.file_hash) AS old FROM x WHERE NOT bad),
  e AS (SELECT *, min(struct_pack(m := mtime, p := p)) OVER (PARTITION BY file_hash) AS first FROM o),
  n AS (SELECT e.*, CASE WHEN e.near IS NOT NULL THEN (SELECT min(s.id) FROM s WHERE s.near = e.near) END AS seed FROM e),
  k AS (SELECT *, CASE WHEN near IS NULL THEN first ELSE min(first) FILTER (old IS NULL AND seed IS NULL) OVER (PARTITION BY near) END AS kept FROM n),
  r AS (SELECT p AS file_path, size, bad, NOT bad AND old IS NULL AND seed IS NULL AND kept.p = p AS keeper,
      CASE WHEN old IS NOT NULL THEN (SELECT s.p FROM s WHERE s.id = old) WHEN seed IS NOT NULL THEN (SELECT s.p FROM s WHERE s.id = seed) WHEN kept.p <> p THEN kept.p END AS duplicate_of,
      CASE WHEN old IS NOT NULL THEN 1.0 WHEN seed IS NOT NULL THEN 0.9 WHEN kept.p = p THEN NULL WHEN first = kept THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM k
    UNION ALL SELECT p, size, bad, false, NULL, NULL FROM x WHERE bad)"""


def _ingested(spark, d, index: str | None = None):
    f = fixture(spark, d, _PRINTS)
    known = f.where("id % 3 = 0").withColumn("file_path", F.expr(_STORED_PATH))
    listing = f.where("id % 3 <> 0").select(F.expr(_FOUND_PATH).alias("path"), "size", "mtime", F.lit(False).alias("is_dir"), F.when(F.expr("id % 31 <> 4"), F.col("file_hash")).alias("hash"), "perceptual_hash")
    return known, jobs.ingest(listing, known, F.lit(_AS_OF).cast("timestamp"), index=index)


@query("ingest_job", f"{_INGEST} SELECT count(*) FILTER (keeper) AS ingested, count(*) FILTER (NOT keeper AND NOT bad) AS duplicates, count(*) FILTER (bad) AS errors, CAST(coalesce(sum(size) FILTER (keeper), 0) AS BIGINT) AS total_size FROM r")
def _(spark, d):
    return _ingested(spark, d)[1][2]


@query("ingest_elected", f"{_INGEST} SELECT file_path, keeper, duplicate_of, score, CASE WHEN bad THEN 'content could not be read' END AS error FROM r")
def _(spark, d):
    base = fresh_dir(spark, "fingerprints")
    dedup.write_fingerprints(fixture(spark, d, _PRINTS).where("id % 3 = 0"), base)
    known, (elected, _, _) = _ingested(spark, d, base)
    names = known.select("id", "file_path").union(elected.select("id", "file_path")).select(F.col("id").alias("duplicate_of"), F.col("file_path").alias("of"))
    return elected.join(names, "duplicate_of", "left").select("file_path", "keeper", F.col("of").alias("duplicate_of"), "score", "error")


@query("ingestion_log", f"{_INGEST} SELECT CAST('{_AS_OF}' AS TIMESTAMP) AS started_at, CAST(count(*) FILTER (keeper) AS INTEGER) AS ingested, CAST(count(*) FILTER (bad) AS INTEGER) AS errors, count(*) FILTER (NOT keeper AND NOT bad) AS details_duplicates FROM r")
def _(spark, d):
    log = jobs.ingestion_log(_ingested(spark, d)[1][2], F.lit(_AS_OF).cast("timestamp_ntz"), F.lit(_AS_OF).cast("timestamp_ntz"))
    return log.select("started_at", "ingested", "errors", F.col("details")["duplicates"].alias("details_duplicates"))


@query("culling_job", f"""WITH p AS (SELECT b.id, b.burst, b.ts, round(full_score, 6) AS score, full_score FROM (SELECT b.*, 5e-1 * 1e-1 + b.value / 1000 * 3e-1 + coalesce(f.face, 3e-1) * 2.5e-1 + coalesce(f.eye, 5e-1) * 2e-1 + 5e-1 * 1.5e-1 AS full_score
    FROM {_bursts(60_000_000)} b LEFT JOIN (SELECT file_id, 0.7 * avg(confidence) + 0.3 * least(1.0, count(*) / 10) AS face, coalesce(avg(eye_open_prob), 0.5) AS eye FROM {_FACES} GROUP BY file_id) f ON b.id = f.file_id) b),
  r AS (SELECT *, '/c/' || id AS path, row_number() OVER (PARTITION BY burst ORDER BY full_score DESC, ts, '/c/' || id) AS r FROM p)
  SELECT id, burst, score, CASE WHEN r <= 1 THEN 'keep' ELSE 'mark' END AS action, max(path) FILTER (r = 1) OVER (PARTITION BY burst) AS best FROM r""")
def _(spark, d):
    photos = captures(spark, d).select("id", "path", "ts", (F.col("value") / 1000).alias("sharpness"), F.lit(0.5).alias("aesthetic"))
    return jobs.cull(photos, fixture(spark, d, FACES), gap=60.0).select("id", "burst", F.round("score", 6).alias("score"), "action", "best")


@query("privacy_job", f"SELECT category, count(*) AS files FROM ({_CASCADE}) GROUP BY category")
def _(spark, d):
    return jobs.privacy_scan(fixture(spark, d, DOCS), _KEY)[2].select("category", "files")


@query("enrich_job", f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(text.SENSITIVE)}') AS is_sensitive, length(text) > 3 AS contains_text FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), "text", F.array(F.struct(F.col("source").alias("label"), F.lit(0.9).alias("score"))).alias("objects"))
    return jobs.enrich_captions(docs).select("doc_id", "is_sensitive", "contains_text")


@query("metadata_job", f"SELECT d.id AS file_id, f.file_path FROM {_DOCS} d JOIN {_FILES} f ON d.id = f.id WHERE d.id % 3 <> 0")
def _(spark, d):
    a = fixture(spark, d, DOCS).select(F.col("id").alias("file_id"), F.col("text").alias("caption"), F.array("name").alias("tags"), F.lit("calm").alias("mood"), F.lit(7.0).alias("aesthetic_score"))
    return jobs.metadata_to_write(files(spark, d), a, a.where("file_id % 3 = 0")).select("file_id", "file_path")


@query("maintenance_job", f"SELECT count(*) FILTER (file_path LIKE '/lib/d3/%' AND file_path NOT IN (SELECT file_path FROM {_FILES} WHERE id % 3 = 0)) AS orphans FROM {_FILES}")
def _(spark, d):
    f = files(spark, d).withColumn("processed", F.lit(False)).withColumn("error", F.lit(None).cast("string"))
    t = fixture(spark, d, TASKS).withColumn("completed_at", F.col("created_at").cast("timestamp"))
    return jobs.maintain(f, f.where("id % 3 = 0").select(F.col("file_path").alias("path")), t, "/lib/d3", F.lit(_AS_OF).cast("timestamp"))[0].agg(F.count_if("processed").alias("orphans"))


@query("score_job", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents")
def _(spark, d):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType())])
    make = lambda: lambda b: b.assign(score=b["text"].str.len().astype(float))[["doc_id", "score"]]
    return jobs.score_with(table(spark, d, "documents").select("doc_id", "text"), make, schema).select("doc_id", "score")


@query("face_job", f"""{_CLUSTERED}, unit AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  hit AS (SELECT DISTINCT f.id, CAST(g.label AS BIGINT) AS person FROM unit f JOIN unit g ON g.id % 7 = 0 AND round(list_inner_product(f.e, g.e) / (f.n * g.n), 6) >= 0.7),
  known AS (SELECT c.cluster, min(hit.person) AS person FROM clustered c LEFT JOIN hit ON c.id = hit.id GROUP BY c.cluster),
  named AS (SELECT cluster, coalesce(person, (SELECT max(label) FROM unit WHERE id % 7 = 0) + row_number() OVER (PARTITION BY person IS NULL ORDER BY cluster)) AS person FROM known)
  SELECT c.id, c.cluster, CAST(named.person AS BIGINT) AS person_id FROM clustered c JOIN named USING (cluster)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("file_id"), "embedding", F.col("label").cast("long").alias("person_id"))
    named, _ = jobs.identify_faces(e.drop("person_id"), e.where("id % 7 = 0").select("person_id", "embedding"), files(spark, d).withColumn("ingested_at", F.timestamp_seconds("mtime")), 9.5)
    return named.select("id", "cluster", "person_id")


_HUE = "CASE WHEN label >= 90 THEN (CASE WHEN label = 30 THEN 0 ELSE 60 * (90 - 30) / (label - 30) END) ELSE 60 * (2 + (30 - label) / (90 - least(label, 30))) END"


@query("image_features", f"SELECT vec_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(least(1.0, variance / 500), 6) AS sharpness, 1e0 AS aspect_ratio, round(CAST({_HUE} AS DOUBLE), 6) AS average_hue FROM {_LAPLACE} JOIN embeddings USING (vec_id)")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 128 + 128).alias("luma"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(F.array(F.col("label"), F.lit(90), F.lit(30))).alias("color_palette"))
    return images.image_features(e).select("vec_id", *(F.round(c, 6).alias(c) for c in ("brightness", "contrast", "sharpness", "aspect_ratio", "average_hue")))


@query("average_hue", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 60.0 ELSE 120.0 END * 1e0 AS hue FROM part")
def _(spark, d):
    red, green, blue = ([255, 0, 0], [0, 255, 0], [0, 0, 255])
    two = lambda a, b: F.array(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    return table(spark, d, "part").select("p_partkey", images.average_hue(F.when(F.col("p_partkey") % 2 == 0, two(red, green)).otherwise(two(red, blue))).alias("hue"))


@query("eye_openness", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5e-1 ELSE least(1e0, round(sqrt(p_size * p_size + 1e2) / 1e2, 9)) END AS eye FROM part")
def _(spark, d):
    point = lambda x, y: F.array(x.cast("double"), F.lit(y))
    marks = F.array(point(F.lit(0), 0.0), point(F.col("p_size"), 10.0), *(point(F.lit(0), 0.0) for _ in range(3)))
    return table(spark, d, "part").select("p_partkey", F.round(images.eye_openness(F.when(F.col("p_partkey") % 3 == 0, F.slice(marks, 1, 4)).otherwise(marks)), 9).alias("eye"))


@query("simple_aesthetic", "SELECT p_partkey, round(3e-1 * (1 - list_min([abs(ln(p_size / 25e0 / r)) for r in [4e0 / 3, 3e0 / 2, 16e0 / 9, 1e0]]) / 2) + 4e-1 * (1 - abs(p_size / 1e2 - 5e-1)) + 3e-1 * least(1e0, p_size / 4e1), 6) AS score FROM part")
def _(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(images.simple_aesthetic(s / 25, s / 100, s * 2.5), 6).alias("score"))


@query("fingerprint")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform("embedding", lambda x: x.cast("double") * (i + 1)))).alias("luma"))
    return images.fingerprint(e).select("vec_id", "perceptual_hash")
