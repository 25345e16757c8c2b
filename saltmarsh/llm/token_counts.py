"""Token counts by a digest cache: what has been counted once is never encoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.scratch import _path, materialize
from saltmarsh.llm.skew import filter_of, join_group, maybe_member
from saltmarsh.llm.tokens import in_lots, tokenizer, version_of
from saltmarsh.llm.worker import small_batches, task

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Stands for a null id where rows are matched by id.
NO_ID = -(1 << 63)


def collapse_blanks(text: Column) -> Column:
    """ASCII white space at the ends dropped, other runs of it one space: such texts have equal ids in a tokenizer that drops white space."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The counts stored for one tokenizer version; none where there is no table yet."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], CACHE).select("content_digest", "n_tokens")
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer_digest") == version)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(path: str):
    @task("tokens")
    def encode(batches):
        import pyarrow as pa

        for digests, texts in in_lots(batches, "content_digest", "_content"):
            counts = [len(ids) // 4 for ids in tokenizer(path).ids(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, normalise=collapse_blanks, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokens of each row's whole text, from a cache of counts by content and tokenizer.

    1. Each row gets a digest of its normalised content (SHA-256); the distinct ones are
       joined with the counts stored under this tokenizer file's digest.
    2. Only distinct misses are encoded. Texts that a bit filter tells to be neither repeated
       nor stored are encoded where they are read. Of the rest the row with the smallest id
       brings the text: a second filter picks these rows and a join on their keys makes sure,
       so a group of copies moves one text, whatever its size.
    3. The new counts are appended to the cache, a Parquet table by tokenizer digest, and
       all rows are joined with it; groups of copies that are hot meet it by broadcast.

    ``normalise`` must keep the count: pass ``lambda c: c`` for tokenizers to which white
    space matters. (Those also need another encoder than ``ChunkTokenizer``.) Returns
    the id, ``n_bytes`` (UTF-8, as given) and ``n_tokens``, for each row one. A null text
    is empty and has 0 tokens; null and repeated ids are fine; an empty table gives no rows.
    The tokenizer's file must be at the same path on all executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = version_of(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    content = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.octet_length(text).cast("long").alias("n_bytes"), normalise(text).alias("_content"))
    content = content.withColumn("content_digest", F.unhex(F.sha2("_content", 256)))
    rows = materialize(content.select("_id", "_key", "n_bytes", "content_digest"), "digests")
    groups = rows.groupBy("content_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key"))
    stored = read_cache(spark, cache_path, version).select("content_digest", F.lit(True).alias("_stored"))
    groups = groups.join(stored, "content_digest", "left").withColumn("_stored", F.col("_stored").isNotNull())
    groups = materialize(groups, "digest-groups")
    own, bringer = F.xxhash64("content_digest"), F.xxhash64("_key", "content_digest")
    doubtful = filter_of(groups.where("_n > 1 or _stored"), own)
    chosen = maybe_member(groups.where("not _stored"), doubtful, own, "_doubt").where("_doubt").select("_key", "content_digest")
    chosen = materialize(chosen, "chosen")
    texts = maybe_member(content.select("_key", "content_digest", "_content"), doubtful, own, "_doubt")
    brought = maybe_member(texts.where("_doubt"), filter_of(chosen, bringer), bringer, "_hit").where("_hit")
    brought = brought.join(chosen, ["_key", "content_digest"], "left_semi")
    texts = texts.where("not _doubt").select("content_digest", "_content").unionByName(brought.select("content_digest", "_content"))
    counted = texts.mapInArrow(_encoder(tokenizer_path), "content_digest binary, n_tokens long")
    counted = counted.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    known = groups.select("content_digest", "_n").join(read_cache(spark, cache_path, version), "content_digest")
    known = materialize(known, "known-counts")
    out = join_group(rows.select("_id", "n_bytes", "content_digest"), known, ["content_digest"], "_n", rows.count(), "inner")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
