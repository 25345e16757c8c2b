"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all of ``docs``, the documents that the
stage before it kept, and returns a DataFrame; all but the last return the columns of
``docs``. ``ORACLE_SQL`` is None: SQL can't express the language model or the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.langid import UNKNOWN, fit_languages, predict_languages
from saltmarsh.llm.line_dedup import line_dedup
from saltmarsh.llm.ngram_join import ngram_join
from saltmarsh.llm.packing import pack_documents
from saltmarsh.llm.queries import learns_language, mixed, vocabulary
from saltmarsh.llm.scratch import fresh, materialize
from saltmarsh.llm.skew import filter_of, join_group, maybe_member

#: Documents whose language is less sure than this go.
LANGUAGE_LEAST = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those that no language fits; fills in a missing ``lang``.

    Repeated rows share their fate. Other columns, of any names, stay as they are.
    """
    lang, odds = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = predict_languages(docs, fit_languages(docs, learns_language()), keep=tuple(docs.columns), names=(lang, odds))
    known = found.where((F.col(lang) != UNKNOWN) & (F.col(odds) >= LANGUAGE_LEAST))
    return known.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier in the corpus, and documents that have no other lines.

    Documents without lines (null and blank texts) stay. Rows that repeat id and text share
    their fate. Other columns, of any names, stay as they are; ``n_chars`` follows the text.
    """
    n, gone = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    out = line_dedup(docs, counts=(n, gone)).where((F.col(n) == 0) | (F.col(gone) < F.col(n)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents exactly one row stays: the one with the smallest id.

    Rows are numbered and written first, and linked by number, so ids may be null (last)
    or repeated: the hash of the text decides then, and of all columns, and the number
    between rows that are alike in all. A document without words links with nothing and stays.
    Texts whose number can't be one of those that go stay where they are; only the rest are shuffled.
    """
    rows = materialize(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    groups = ngram_join(rows.select(F.col("_doc.text").alias("text"), "_row"), id_col="_row")
    rank = F.struct(F.col("_doc.doc_id").isNull().alias("_last"), F.col("_doc.doc_id").alias("_id"), F.xxhash64("_doc.text").alias("_th"), F.xxhash64("_doc").alias("_dh"), F.col("_row").alias("_at"))
    ranked = materialize(groups.select("_row", "component_id").join(rows.select("_row", rank.alias("_rank")), "_row"), "ranked")
    first = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    linked = join_group(ranked, materialize(first, "first-rows"), ["component_id"], "_n", ranked.count(), "inner")
    gone = materialize(linked.where("_row <> _first._at").select("_row"), "near-duplicates")
    slot = F.xxhash64("_row")
    flagged = maybe_member(rows, filter_of(gone, slot), slot, "_hit")
    stays = flagged.where("not _hit").select("_doc").unionByName(flagged.where("_hit").join(gone, "_row", "left_anti").select("_doc"))
    return stays.select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that their tokens have the target shares of sources, languages and topics.

    Null and unlisted values are a class of their own. A document without words goes or stays
    as its cell does. Rows that repeat an id share their draw. Columns may have any names
    but those that ``mix`` adds.
    """
    return mixed(docs).where("mix_sampled").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row for each piece."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
