"""The vault's ledger: entries and their ends are only ever added, and what lies in the vault is the latest state of each file.

A ledger is a folder of Parquet files by category: (id, name, payload binary, state, at, category), state stored or restored. Payloads are encrypted before
they are written; the key is in no plan and no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediacat.operators.sensitivity import quarantine, restore
from mediacat.storage import stored

LEDGER = "id long, name string, payload binary, state string, at timestamp, category string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none if nothing was ever put in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _append(rows: DataFrame, path: str) -> None:
    rows.select("id", "name", "payload", "state", "at", "category").write.mode("append").partitionBy("category").parquet(path)


def contents(ledger: DataFrame) -> DataFrame:
    """What lies in the vault: each file's last entry, if that is no restore. Of one time the restore counts as later."""
    last = Window.partitionBy("id").orderBy(F.desc("at"), "state")
    return ledger.withColumn("__r", F.row_number().over(last)).where("__r = 1 and state = 'stored'").drop("__r", "state")


def listing(ledger: DataFrame, category: str | None = None) -> DataFrame:
    """(id, name, category, at) of what lies in the vault, of one category if asked; payloads are not read."""
    rows = ledger.drop("payload").withColumn("payload", F.lit(None).cast("binary"))
    found = contents(rows if category is None else rows.where(F.col("category") == category))
    return found.select("id", "name", "category", "at")


def deposit(scanned: DataFrame, path: str, key: str, at: Column) -> DataFrame:
    """Put the sensitive rows of scanned (id, name, text, result) into the ledger, those that don't lie there yet; the safe rows come back."""
    spark = scanned.sparkSession
    safe, found = quarantine(scanned, key)
    there = listing(read_ledger(spark, path)).select("id")
    fresh = stored(found.join(there, "id", "left_anti").select("id", "name", "payload", F.lit("stored").alias("state"), at.cast("timestamp").alias("at"), "category"), "vault-new")
    if not fresh.isEmpty():
        _append(fresh, path)
    return safe


def take_out(ids: DataFrame, path: str, key: str, at: Column) -> DataFrame:
    """The files of ids (id) that lie in the vault, in the clear as sensitivity.restore() gives them; the ledger gets the end of each entry.

    Ids that lie there no longer give nothing, so doing it again changes nothing. at must be later than the entries' times.
    """
    spark = ids.sparkSession
    held = stored(contents(read_ledger(spark, path)).join(ids.select("id").distinct(), "id", "left_semi"), "vault-out")
    back = restore(held.drop("at"), held.select("id"), key)
    if not held.isEmpty():
        _append(held.select("id", "name", F.lit(None).cast("binary").alias("payload"), F.lit("restored").alias("state"), at.cast("timestamp").alias("at"), "category"), path)
    return back
