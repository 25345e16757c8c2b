"""The n-gram join, the two classifiers, the pipeline and the queries' SQL."""

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import saltmarsh.llm.ngram_join as join
from saltmarsh.llm import queries
from saltmarsh.llm.components import components
from saltmarsh.llm.langid import fit_languages, predict_languages
from saltmarsh.llm.quality import classify_quality
from saltmarsh.llm.scratch import scratch_root

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    named = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return [(d, len(s), named(i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("paired, block, frequent", [(32, 1024, 8), (2, 3, 3), (10**6, 1024, 10**9)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, paired, block, frequent):
    monkeypatch.setattr(join, "PAIRED", paired)
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "FREQUENT_LEAST", frequent)
    monkeypatch.setattr(join, "LIST_SHARE", 4)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = [rng.choice(vocabulary) for _ in range(40)] + passage
        rows.append((i, " \t\n".join(words).upper() if i % 3 else "  ".join(words)))
    rows += [(None, rows[0][1]), (None, "all alone here"), (1000, ""), (1001, None), (1002, " \n"), (1003, "a b"), (1004, "A\tb"), (1003, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in join.ngram_join(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_force(rows)))


def test_signatures_miss_no_link():
    """Sets around every size at which signatures grow, some longer than the longest signature."""
    rng = np.random.default_rng(3)
    for percent in (50, 75, 90):
        sets = []
        for n in [1, 2, 5, 63, 64, 65, 120, 128, 129, 140, 500, 520] * 3:
            whole = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            sets += [whole, whole[: -(-n * percent // 100)], np.concatenate([whole, rng.integers(0, 1 << 63, n * (100 - percent) // percent, dtype=np.uint64)]), rng.permutation(np.concatenate([whole[n // 8 :], sets[-1][: n // 8]])) if sets else whole]
        n = np.array([len(s) for s in sets])
        for sides in (np.zeros(len(sets), int), rng.integers(0, 2, len(sets))):
            close = join.close_members(np.arange(len(sets)), sides, n, [join.signature(s) for s in sets], [[]] * len(sets), percent)
            links = 0
            for i in range(len(sets)):
                for j in range(len(sets)):
                    common = len(np.intersect1d(sets[i], sets[j]))
                    if i != j and (sides[i] < sides[j] or not sides.any()) and 100 * common >= percent * (n[i] + n[j] - common):
                        links += 1
                        assert close[i] and close[j]
            assert links > 40
    apart = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in range(100, 400)]
    assert join.close_members(np.arange(300), np.zeros(300, int), np.array([len(s) for s in apart]), [join.signature(s) for s in apart], [[]] * 300, 75).sum() < 3


def test_pairs_are_compared_in_one_list_only():
    one = join.signature(np.arange(50, dtype=np.uint64))
    flags = join.close_members(np.arange(4), np.zeros(4, int), np.full(4, 50), [one] * 4, [[7, -3], [-3], [8], [7, 8]], 75)
    assert flags.tolist() == [True, True, True, True]  # 0 with 2, 1 with 2, 1 with 3
    flags = join.close_members(np.arange(3), np.zeros(3, int), np.full(3, 50), [one] * 3, [[7, -3], [-3, 9], [9, 7]], 75)
    assert not flags.any()


def test_whole_sets_of_long_lists_are_not_dealt_for_every_list(spark, monkeypatch):
    """Documents that are not quite alike share many long lists; their sets were dealt to every block of each of these."""
    monkeypatch.setattr(join, "BLOCK", 16)
    dealt, blockwise = [], join._blockwise
    monkeypatch.setattr(join, "_blockwise", lambda rows, *rest: dealt.append(rows.count()) or blockwise(rows, *rest))
    rng = random.Random(5)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(60):
            words = list(base)
            for k in rng.sample(range(100), 3):
                words[k] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = [tuple(r) for r in join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_force(rows))
    assert dealt and dealt[0] < 4 * len(rows)


def test_ngram_join_leaves_no_table_that_nothing_reads(spark):
    held = lambda: {p.name for p in Path(scratch_root(spark)).glob("*")}
    before = held()
    rows = [(i, " ".join(f"w{(i // 4 * 50 + k * k) % 997}" for k in range(60 - i % 4))) for i in range(80)]
    assert len(join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 80
    left = {name.rpartition("-")[0] for name in held() - before}
    assert "signed" in left and not left & {"postings", "open-classes", "lists", "stars", "sets", "placed", "open", "short", "pairs", "signatures", "close"}


def test_ngram_join_of_an_empty_table(spark):
    assert join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multiplicity_grows_with_size():
    least = [join.least_multiplicity(n) for n in range(1, 3000)]
    assert least == sorted(least) and least[0] == 1 and least[-1] == 63


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_language_id(spark, MIDDLE).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.97


def test_language_id_of_odd_rows(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and of to in", "en"), (3, None, "en"), (4, "12 34 !!", "de"), (5, "", None), (None, "the and of", None), (6, "und die " * 30000, None)] + [(10 + i, "the and of to in it is", "en") for i in range(20)] + [(40 + i, "der die das und ist nicht", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(df, fit_languages(df, F.lit(True))).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[None][0] == "en" and got[6][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    nothing = fit_languages(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in predict_languages(df, nothing).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op10_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "BAD!! " * 20000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = classify_quality(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classify_quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert classify_quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        else:
            assert out.columns == columns
            assert 0 < out.count() <= docs.count()
            if name in ("language_id", "ngram_join"):
                assert out.exceptAll(docs.withColumn("lang", F.col("lang"))).count() == 0
            docs = out
    assert n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, got[order].astype(str).values.tolist())) == sorted(map(repr, want[order].astype(str).values.tolist()))


def test_near_duplicates_with_null_and_repeated_ids_leave_one_row_of_each_group(spark):
    rng = random.Random(8)
    text = {k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abcdefg"}
    near = {k: t + " tail" for k, t in text.items()}
    rows = [(3, text["a"], "x"), (7, text["a"], "x"), (7, text["b"], "x")]
    rows += [(None, text["c"], "x"), (None, text["c"], "x"), (None, near["c"], "x"), (None, near["a"], "x"), (None, text["d"], "x")]
    rows += [(5, text["e"], "x"), (5, near["e"], "x"), (5, text["e"], "y"), (5, text["f"], "x"), (5, text["f"], "x"), (6, near["f"], "x")]
    rows += [(7, text["g"], "x"), (9, None, "x"), (9, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = [sorted(map(repr, map(tuple, corpus_pipeline.drop_near_duplicates(spark, d, SMALL).collect()))) for d in (df, df.repartition(5).orderBy("source"))]
    assert results[0] == results[1]
    kept = results[0]
    fixed = [(3, text["a"], "x"), (7, text["b"], "x"), (None, text["d"], "x"), (5, text["f"], "x"), (7, text["g"], "x"), (9, None, "x"), (9, None, "x"), (None, "", "x")]
    for row in fixed:
        assert kept.count(repr(row)) == fixed.count(row)
    for options in ({(None, text["c"], "x"), (None, near["c"], "x")}, {(5, text["e"], "x"), (5, text["e"], "y"), (5, near["e"], "x")}):
        assert sum(kept.count(repr(row)) for row in options) == 1
    assert len(kept) == len(fixed) + 2
