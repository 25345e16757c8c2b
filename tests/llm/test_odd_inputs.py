"""Clashing names, nulls, faults and very long texts; what a worker holds."""

import random
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltmarsh.llm import langid, queries
from saltmarsh.llm.line_dedup import line_dedup
from saltmarsh.llm.secret_scan import _encoder, find_secrets, is_known
from saltmarsh.llm.tiff import TiffError, read_tiff, tiff_pages
from saltmarsh.llm.tokens import ChunkTokenizer, cut_at_blanks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, n_lines int, n_dropped string, _text int, _doc int"
WORDS = "the river ran under an old stone bridge while people of the town sold bread and fruit near its banks".split()


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "kept", 1, 2, "also", 3, 4) for r in rows], SCHEMA)


def _rows(n=30):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=40)), "en", "src1", 200) for i in range(n)]
    return [*rows, (n, None, None, None, None), (n + 1, "", "en", "src1", 0), (None, rows[0][1] + " and more", "en", None, 5), rows[1], rows[1]]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_rows_and_clashing_names(spark, name, stage):
    docs = _docs(spark, _rows())
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r.score == "kept" and r.lang_pred == 1 and r.n_lines == 2 and r.n_dropped == "also" for r in rows) and rows
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "language_id":  # null and empty texts have no letters
        assert {r.doc_id for r in rows} == set(range(30)) | {None}
    if name == "ngram_join":  # of the three equal rows one stays, and texts without words stay
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == list(range(32))


def test_packing_stage_takes_odd_rows(spark):
    docs = _docs(spark, _rows())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == docs.count() and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_mixing_replaces_columns_of_its_names(spark):
    docs = _docs(spark, _rows()).withColumn("mix_p", F.lit("mine")).withColumn("mix_tokens", F.lit("mine"))
    out = queries.mixed(docs)
    assert len(set(out.columns)) == len(out.columns) and dict(out.dtypes)["mix_p"] == "double" and out.count() == docs.count()


def test_short_lines_are_compared_too(spark):
    docs = spark.createDataFrame([(0, "ab\nq"), (1, "abc"), (2, "r\nlong line here")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup(docs).collect()} == {0: 0, 1: 1, 2: 1}


def test_ngrams_depend_on_no_neighbour_and_no_cut(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé ñ한글.\n", k=rng.choice((0, 1, 2, 50, 700)))).encode() for _ in range(40)]

    def counts(step):
        monkeypatch.setattr(langid, "STEP", step)
        return [(i, p.tolist(), c.tolist()) for i, p, c in langid._counted(list(enumerate(texts)))]

    whole = counts(1 << 18)
    assert whole == counts(64) == counts(300)
    alone = [next(iter(langid._counted([(i, t)]))) for i, t in enumerate(texts)]
    assert [(i, p.tolist(), c.tolist()) for i, p, c in alone] == whole


def test_long_texts_are_cut_for_the_tokenizer(monkeypatch):
    known = ChunkTokenizer(queries.vocabulary())
    text = " ".join(random.Random(8).choices([*WORDS, "Äpfel", "x1,", "<|endoftext|>"], k=5000)).encode()
    whole = known.ids([text])
    monkeypatch.setattr("saltmarsh.llm.tokens.CUT", 700)
    assert known.ids([text, b"a b"]) == [whole[0], known.ids([b"a b"])[0]]
    assert b"".join(cut_at_blanks(text, 50)) == text


def test_remembered_chunks_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr("saltmarsh.llm.tokens.REMEMBERED", 1 << 16)
    known, rng = ChunkTokenizer(queries.vocabulary()), random.Random(2)
    for _ in range(50):
        known.ids([" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(400)).encode()])
        real = sum(160 + len(c) + len(i) for c, i in known.young.items())
        assert known.held == real <= (1 << 16) + 400 * 400


def test_a_worker_stays_small_on_one_long_text():
    code = """
import numpy as np, pyarrow as pa, resource, random
from saltmarsh.llm import langid
words = ["river", "stone", "bread", "town", "people"]
text = " ".join(random.Random(1).choices(words, k=4_000_000))
assert len(text) > 20_000_000
value = pa.array([text])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
list(langid._counter()([pa.RecordBatch.from_arrays([value], ["_text"])]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
    assert int(out.stdout) < 160


@pytest.mark.parametrize("data", [b"", b"II", b"II*\0\xff\xff\xff\xff", b"II+\0\x08\0\0\0" + struct.pack("<Q", (1 << 63) + 5), b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHII", 256, 3, 0, 0) + b"\0" * 4])
def test_broken_tiff_files_are_errors(spark, data):
    with pytest.raises(TiffError):
        list(read_tiff(data))
    rows = tiff_pages(spark.createDataFrame([(1, data)], "doc_id long, media binary")).collect()
    assert [(r.page, r.pixels) for r in rows] == [(0, None)] and rows[0].error


def test_planted_random_strings_are_found_and_names_are_not():
    import public_tokenizers

    encoder = _encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(11)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    for alphabet, least in zip(alphabets, (0.97, 0.75), strict=True):
        planted = ["".join(rng.choices(alphabet, k=rng.randint(24, 48))) for _ in range(500)]
        found = sum(any(k == 3 for _, k, _ in find_secrets(f"see {p} there".encode(), encoder, 2.2)) for p in planted)
        assert found >= least * len(planted)
    names = ["_".join(rng.choices(WORDS, k=6)) for _ in range(200)] + ["".join(w.title() for w in rng.choices(WORDS, k=6)) for _ in range(200)] + [str(rng.randrange(10**24)) for _ in range(50)]
    assert not [n for n in names if any(k == 3 for _, k, _ in find_secrets(n.encode(), encoder, 2.2))]
    assert is_known(b"1" * 30, frozenset())
