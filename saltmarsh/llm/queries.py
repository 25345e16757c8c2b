"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.exact_dedup import LOWER, UPPER, exact_dedup
from saltmarsh.llm.langid import fit_languages, predict_languages
from saltmarsh.llm.line_dedup import line_dedup
from saltmarsh.llm.mixing import mix, mix_sql, word_count
from saltmarsh.llm.ngram_join import ngram_join
from saltmarsh.llm.packing import pack_documents
from saltmarsh.llm.quality import classify_quality
from saltmarsh.llm.scratch import new_path
from saltmarsh.llm.secret_scan import joined, scan_secrets
from saltmarsh.llm.tiff import store_texts, tiff_pages
from saltmarsh.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares of tokens. No listed source has more than a tenth, whatever it has in the corpus;
#: null and the values not listed keep the share that they have (``mixing.rake``).
MIX_SOURCES = {f"src{i}": 0.1 if i == 0 else 0.9 / 19 for i in range(20)}
MIX_LANGS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
MIX_TOPICS = {"legal": 0.05, "contact": 0.05, "code": 0.05, "prose": 0.85}
MIX_FRACTION = 0.5


def _topic() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text.contains("icensed under") | text.contains("opyright"), "legal")
        .when(text.contains("@") | text.contains("+1 ("), "contact")
        .when(text.contains(" = ") | text.contains("{"), "code")
        .otherwise("prose")
    )


_TOPIC_SQL = """CASE WHEN contains(coalesce(text, ''), 'icensed under') OR contains(coalesce(text, ''), 'opyright') THEN 'legal'
    WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '+1 (') THEN 'contact'
    WHEN contains(coalesce(text, ''), ' = ') OR contains(coalesce(text, ''), '{') THEN 'code' ELSE 'prose' END"""
_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS_SQL = f"""(CASE WHEN trim(coalesce(text, ''), {_BLANKS_SQL}) = '' THEN 0
    ELSE len(regexp_split_to_array(trim(coalesce(text, ''), {_BLANKS_SQL}), '[\\x20\\x09-\\x0D]+')) END)::BIGINT"""


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` mixed to the shares above."""
    margins = {"source": (F.col("source"), MIX_SOURCES), "lang": (F.col("lang"), MIX_LANGS), "topic": (_topic(), MIX_TOPICS)}
    return mix(docs, margins, MIX_FRACTION, word_count(F.col("text")))


def mixed_sql(table: str) -> str:
    return mix_sql(table, {"source": ("source", MIX_SOURCES), "lang": ("lang", MIX_LANGS), "topic": (_TOPIC_SQL, MIX_TOPICS)}, MIX_FRACTION, _WORDS_SQL)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_table(spark, sf_dir))
    return out.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_p", 6).alias("mix_p"), "mix_sampled")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so the run encodes every distinct text once."""
    counts = token_counts(_table(spark, sf_dir), vocabulary(), new_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir), vocabulary())


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as TIFF pages of 64 columns, read back by the page decoder."""
    pages = tiff_pages(store_texts(_table(spark, sf_dir)), keep=("doc_id", "n_bytes", "media"))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def _fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def learns_language() -> Column:
    """Documents that language ID learns from."""
    return F.coalesce(_fold(3) != 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    out = predict_languages(docs, fit_languages(docs, learns_language()))
    return out.select("doc_id", (~learns_language()).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), _fold(4) != 2)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = scan_secrets(_table(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("random"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir), digest_all=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_tiff": op3_tiff,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op1_mixing": f"SELECT doc_id, mix_source, mix_lang, mix_topic, mix_tokens, round(mix_p, 6) AS mix_p, mix_sampled FROM ({mixed_sql('documents')})",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}
