"""Reading whole text files and chunk streams, writing reports and sanitized text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, text string, error string"


def read_files(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """One row for each file: its path and text, or an error where it is too large or not UTF-8.

    Fails closed by file: a bad one has no text, and the others are read.
    """
    files = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= most_bytes
    text = F.when(small, F.expr("try_validate_utf8(cast(content as string))"))
    error = F.when(~small, "INPUT_TOO_LARGE").when(text.isNull(), "INVALID_UTF8")
    return files.select("path", text.alias("text"), error.alias("read_error"))


def read_chunks(spark: SparkSession, path: str):
    """A stream of chunks (stream_id, seq, chunk, op) from a folder of JSON lines."""
    return spark.readStream.schema("stream_id string, seq long, chunk string, op string").json(path)


def report(findings: DataFrame, *keys: str) -> DataFrame:
    """One JSON line for each text: its keys and findings, never what was matched."""
    public = F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in ("finding_id", "type", "detector", "confidence", "action", "obfuscation", "start", "end")]))
    return findings.select(F.to_json(F.struct(*keys, public.alias("findings"), F.col("error.code").alias("error"))).alias("value"))


def write_report(findings: DataFrame, path: str, *keys: str) -> None:
    report(findings, *keys).write.mode("overwrite").text(path)


def write_text(clean: DataFrame, path: str, text_col: str = "text") -> None:
    """Sanitized text; rows with an error have none and aren't written."""
    clean.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def exit_code(findings: DataFrame) -> int:
    """0: clean, 1: findings, 2: failures, which outrank findings."""
    worst = findings.agg(F.max(F.when(F.col("error").isNotNull() | F.col("findings").isNull(), 2).when(F.size("findings") > 0, 1).otherwise(0))).head()[0]
    return worst or 0
