"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.scratch import materialize
from saltmarsh.llm.skew import filter_of, join_group, maybe_member

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and no other letter. All-ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """The duplicates of each row of ``docs`` whose text is the same but for the case of A-Z.

    1. Rows are grouped by length, and 2. groups of several rows by a hash of the
       first ``prefix_chars`` characters; both are counts, combined before the shuffle.
    3. Only rows whose length and prefix both recur have their full content hashed
       (SHA-256). They are found by a bit filter of fixed size, so texts never move;
       a chance hit in it costs one needless hash and no result.

    Returns one row for each input row: the id, ``keep_id`` (largest id of its
    group), ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text;
    null for rows that stage 2 found unique, unless ``digest_all``).

    A null text counts as empty; empty texts equal each other. A null id is less
    than any other; a group of only null ids has a null ``keep_id``. Of rows with
    the same text and id exactly one is kept. An empty table gives no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars))).alias("_prefix"),
    )
    by_prefix = base.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_prefix = materialize(by_prefix, "prefixes")
    lengths = by_prefix.groupBy("_len").agg(F.sum("_n").alias("_same_length")).where("_same_length > 1")
    survivors = by_prefix.where("_n > 1").join(lengths, "_len", "left_semi")
    slot = F.xxhash64("_len", "_prefix")
    flagged = maybe_member(base, filter_of(survivors, slot), slot, "_survives")
    full = F.unhex(F.sha2(lower_ascii(F.col("_text")), 256))
    hashed = flagged.select(
        "_id",
        "_survives",
        F.monotonically_increasing_id().alias("_row"),
        (full if digest_all else F.when(F.col("_survives"), full)).alias("_sha"),
    )
    hashed = materialize(hashed, "hashes")
    again = hashed.where("_survives")
    groups = again.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_top"))
    decided = join_group(again, groups, ["_sha"], "_n", hashed.count(), "inner")
    alone = hashed.where("not _survives").withColumns({"_n": F.lit(1).cast("long"), "_top": F.struct("_id", "_row")})
    both = decided.unionByName(alone)
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_top._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_top._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
