"""Sensitive content: text and name rules, the cascade, its summary, and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.paths import basename

# Text patterns in order, keywords of names in order.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "phone": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "medical": r"\b(patient|diagnosis|prescription|medical|health)\b",
    "financial": r"\b(account|routing|balance|transaction|statement)\b",
}
NAME_WORDS = {
    "document": ("document", "contract", "agreement", "invoice", "receipt", "tax", "bank"),
    "id": ("passport", "license", "id_card", "ssn", "social_security"),
    "medical": ("medical", "health", "prescription", "lab", "test", "report"),
    "financial": ("financial", "statement", "account", "transaction", "credit"),
    "personal": ("private", "confidential", "secret", "personal"),
}
RESULT = "struct<category:string,confidence:double,matches:long,sample:string>"


def _result(category: Column | str, confidence: Column | float, matches: Column, sample: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(category).alias("category"), lit(confidence).cast("double").alias("confidence"), matches.cast("long").alias("matches"), sample.cast("string").alias("sample"))


def text_result(text: Column) -> Column:
    """First category with a match: confidence 0.3 a match up to 0.9; else document (0.7) for over five lines; else null."""
    lines = F.size(F.split(F.btrim(text, F.lit(" \t\n\r\f\v")), "\n"))
    found = F.when(lines > 5, _result("document", 0.7, lines, F.lit(None)))
    for category, pattern in reversed(PATTERNS.items()):
        p = F.lit(f"(?i){pattern}")
        n = F.regexp_count(text, p)
        found = F.when(n > 0, _result(category, F.least(F.lit(0.9), n * 0.3), n, F.regexp_extract(text, f"(?i){pattern}", 1 if "(pa" in pattern or "(ac" in pattern else 0))).otherwise(found)
    return found


def name_result(path: Column) -> Column:
    """First category with a keyword in the lower-cased file name, 0.8; else null."""
    name, found = F.lower(basename(path)), F.lit(None)
    for category, words in reversed(NAME_WORDS.items()):
        for w in reversed(words):
            found = F.when(name.contains(w), _result(category, 0.8, F.lit(1), F.lit(w))).otherwise(found)
    return found


def scan_text(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("result", text_result(F.col(col)))


def scan_name(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("result", name_result(F.col(path)))


def detect_sensitive(df: DataFrame, text: str = "text", path: str = "name", contains: str = "contains_text", flagged: str = "is_sensitive", confidence: str | None = None) -> DataFrame:
    """df with result: the model's flag first, then the text (only where it is said to contain any), then the name, else safe."""
    by_model = F.when(F.col(flagged), _result("ai_flagged", F.col(confidence) if confidence else F.lit(None), F.lit(None), F.lit(None)))
    by_text = F.when(F.col(contains), text_result(F.col(text)))
    safe = _result("safe", 0.0, F.lit(0), F.lit(None))
    return df.withColumn("result", F.coalesce(by_model, by_text, name_result(F.col(path)), safe))


def sensitivity_summary(scanned: DataFrame) -> DataFrame:
    """For each category: rows and mean confidence; of the whole: rows scanned and sensitive."""
    by = scanned.groupBy(F.col("result.category").alias("category")).agg(F.count("*").alias("files"), F.round(F.avg("result.confidence"), 6).alias("mean_confidence"))
    every = Window.partitionBy()  # a row for each category
    return by.withColumn("scanned", F.sum("files").over(every)).withColumn("sensitive", F.coalesce(F.sum(F.when(F.col("category") != "safe", F.col("files"))).over(every), F.lit(0)))


def _secret(df: DataFrame, key: str) -> Column:
    """The key as a scalar subquery over one row: plans and event logs show the subquery, not its value."""
    return df.sparkSession.createDataFrame([(key,)], "secret string").scalar()


def quarantine(df: DataFrame, key: bytes | str, payload: str = "text") -> tuple[DataFrame, DataFrame]:
    """(safe rows, vault): sensitive rows carry category and the encrypted payload; the key is in no plan and no table."""
    secret = _secret(df, key if isinstance(key, str) else key.decode())
    sensitive = F.col("result.category") != "safe"
    vault = df.where(sensitive).withColumn("category", F.col("result.category")).withColumn("payload", F.aes_encrypt(F.col(payload).cast("binary"), secret)).drop(payload, "result")
    return df.where(~sensitive).drop("result"), vault


def restore(vault: DataFrame, ids: DataFrame, key: str, id_col: str = "id", payload: str = "text") -> DataFrame:
    """The chosen rows in the clear: error null, processed false, name restored_<name>."""
    rows = vault.join(ids, id_col, "left_semi").withColumn(payload, F.aes_decrypt("payload", _secret(vault, key)).cast("string"))
    return rows.withColumn("name", F.concat(F.lit("restored_"), "name")).withColumn("processed", F.lit(False)).withColumn("error", F.lit(None).cast("string")).drop("payload", "category")
