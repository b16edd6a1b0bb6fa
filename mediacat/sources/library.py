"""Scans and tables of the library."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediacat.functions.paths import basename, normalize_path
from mediacat.functions.text import content_hash
from mediacat.sources.versioned import Catalog

SYSTEM_NAMES = ("Thumbs.db", "desktop.ini", ".DS_Store")


def scan_library(spark: SparkSession, root: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, content) of the files under root; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        both = sorted({e.lstrip(".").lower() for e in extensions} | {e.lstrip(".").upper() for e in extensions})
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(both) + "}")
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def clean_listing(df: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Without hidden, temporary and system names, one row for each path, oldest first."""
    name = basename(F.col(path))
    kept = df.where(~name.startswith(".") & ~name.startswith("~") & ~name.isin(*SYSTEM_NAMES))
    return kept.withColumn("__key", normalize_path(F.col(path))).dropDuplicates(["__key"]).drop("__key").orderBy(mtime, path)


def glob_to_regex(pattern: str) -> str:
    quote = lambda c: ".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() else c
    return "(?s)^" + "".join(map(quote, pattern)) + "$"


def find_files(df: DataFrame, patterns: list[str], min_size: int = 0, max_size: int | None = None, path: str = "path") -> DataFrame:
    """Files whose name fits any glob and whose size is in range, ends included; each once."""
    name, fits = basename(F.col(path)), F.lit(False)
    for p in patterns:
        fits = fits | name.rlike(glob_to_regex(p))
    size: Column = F.col("size") >= min_size
    return df.where(fits & (size if max_size is None else size & (F.col("size") <= max_size)))


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return Catalog(spark, base).read(name)


def write_table(df: DataFrame, base: str, name: str) -> None:
    """Replace a catalog table, with its fixed schema, by one commit: readers see the old rows or the new ones. df may read the table itself."""
    Catalog(df.sparkSession, base).commit(replaces={name: df})


def describe_files(spark: SparkSession, paths: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(path, size, mtime, is_dir, hash, perceptual_hash, error) of the paths (path) of one batch, read by Spark; files that aren't there carry an error.

    The batch's folders are listed, but only files of the batch's names are opened.
    """
    asked = [r.path for r in paths.select("path").where("path is not null").distinct().collect()]  # a batch, whose size the stream bounds
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    folders = [f for f in sorted({p.rsplit("/", 1)[0] or "/" for p in asked}) if at(f).getFileSystem(conf).exists(at(f))]
    plain = F.regexp_replace("path", "^file:(//)?/", "/")
    wanted = spark.createDataFrame([(p,) for p in asked], "path string").select(plain.alias("path"), F.col("path").alias("asked"))
    rows = wanted.select("asked", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("hash"))
    if folders:
        names = sorted({n for p in asked for n in (p.rsplit("/", 1)[-1], quote(p.rsplit("/", 1)[-1]))})
        found = spark.read.format("binaryFile").load(folders).where(F.col("_metadata.file_name").isin(names))
        found = found.select(plain.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), content_hash(F.col("content"), algorithm).alias("hash"))
        rows = wanted.join(found, "path", "left")
    error = F.when(F.col("hash").isNull(), "File not found")
    return rows.select(F.col("asked").alias("path"), "size", "mtime", F.lit(False).alias("is_dir"), "hash", F.lit(None).cast("string").alias("perceptual_hash"), error.alias("error"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded JPEG, PNG, BMP and GIF files."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def export_metadata(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON record for each analysed file (file_id, metadata)."""
    writer = df.select("file_id", "metadata", *(partition_by or [])).write
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def event_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of file events from an event log; max_files bounds what one batch takes in."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)
