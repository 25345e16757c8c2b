"""Token counts, packing and mixing."""

import random
import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import saltmarsh.llm.tokens as tokens
from saltmarsh.llm import token_counts as counts_module
from saltmarsh.llm.mixing import mix, word_count
from saltmarsh.llm.packing import Shelf, pack_documents, pack_lengths, slots_of
from saltmarsh.llm.queries import mixed, vocabulary
from saltmarsh.llm.scratch import new_path
from saltmarsh.llm.token_counts import token_counts

LIBRARY = Tokenizer.from_file(vocabulary())
PARTS = ["a", "E", "É", "é", "é", "H̱", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "'s", "'T", "'", "..", ".", ",", "!!", "foo!!", "bar,", "é***", "1", "23", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "日本", "ß", "İ", "Σ", "ς", "​", "_", "-", "don't", "한글", "😀", "ﬁ", "K", "ª", "µ", "ǅ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join) | st.text(max_size=20), min_size=1, max_size=4))
def test_chunks_give_the_librarys_ids(texts):
    old, tokens.REMEMBERED = tokens.REMEMBERED, 40
    try:
        got = tokens.tokenizer(vocabulary()).ids([t.encode() for t in texts])
    finally:
        tokens.REMEMBERED = old
    assert got == [struct.pack(f"<{len(ids)}I", *ids) for ids in (LIBRARY.encode(t, add_special_tokens=False).ids for t in texts)]


def _documents(spark):
    rng = random.Random(2)
    texts = ["", None, "Hello  world", "hello world", "x" * 3000, "word " * 9000, "<|endoftext|> a", "é È"]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(None, "lonely text"), (5, "twice"), (5, "twice")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_counts_equal_the_library_and_the_cache_spares_work(spark, monkeypatch):
    rows, df = _documents(spark)
    path = new_path(spark, "test-cache")
    want = sorted(repr((i, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    assert sorted(map(repr, map(tuple, token_counts(df, vocabulary(), path).collect()))) == want
    stored = spark.read.parquet(path).count()
    assert stored == len({" ".join((t or "").split()) for _, t in rows})

    def refuse(path):
        def encode(batches):
            for batch in batches:
                assert batch.num_rows == 0, "encoded again"
                yield from ()

        return encode

    monkeypatch.setattr(counts_module, "_encoder", refuse)
    assert sorted(map(repr, map(tuple, token_counts(df, vocabulary(), path).collect()))) == want
    assert spark.read.parquet(path).count() == stored
    assert token_counts(df.limit(0), vocabulary(), path).count() == 0


def test_packing_is_a_partition_without_gaps(spark):
    rows, df = _documents(spark)
    got = pack_documents(df, vocabulary(), capacity=256).collect()
    bins, pieces = {}, Counter()
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    want = Counter()
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert pieces == want
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(k[3] * n for k, n in pieces.items())
    assert len(bins) <= -(-total // 256) + 1
    assert pack_documents(df.limit(0), vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_combinations_use_every_length_once(counts):
    made = pack_lengths(counts, 64)
    used = Counter()
    for lengths, times in made:
        assert times > 0 and 0 < sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    slots = slots_of(made) if counts else None
    if counts:
        import numpy as np

        places = set()
        for length, n in counts.items():
            bins, offsets = slots.place(np.full(n, length), np.arange(n))
            places |= set(zip(bins.tolist(), offsets.tolist(), strict=True))
        assert len(places) == sum(counts.values())


def test_complements_reach_the_bound():
    rng = random.Random(4)
    counts = Counter(rng.randint(1, 4096) for _ in range(20000))
    total = sum(k * n for k, n in counts.items())
    assert sum(times for _, times in pack_lengths(counts, 4096)) <= -(-total // 4096) * 1.01


def test_mixing_meets_the_margins(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices(["a", "b", "c"], [6, 3, 1])[0], rng.choices(["en", "fr", None], [7, 2, 1])[0], rng.randint(1, 50)) for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n int")
    margins = {"source": (F.col("source"), {"a": 0.4, "b": 0.4, "c": 0.2}), "lang": (F.col("lang"), {"en": 0.6, "fr": 0.3})}
    out = mix(df, margins, 0.2, F.col("n").cast("long")).cache()
    assert out.columns == ["doc_id", "source", "lang", "n", "mix_source", "mix_lang", "mix_tokens", "mix_p", "mix_sampled"]
    kept = out.where("mix_sampled")
    total = kept.agg(F.sum("n")).head()[0]
    assert abs(total / sum(r[3] for r in rows) - 0.2) < 0.01
    for column, want in (("source", {"a": 0.4, "b": 0.4, "c": 0.2}), ("mix_lang", {"en": 0.6, "fr": 0.3, "(other)": 0.1})):
        for r in kept.groupBy(column).agg(F.sum("n").alias("n")).collect():
            assert abs(r.n / total - want[r[column]]) < 0.02
    again = mix(df.repartition(7), margins, 0.2, F.col("n").cast("long"))
    assert again.where("mix_sampled").count() == kept.count()


def test_mixing_of_nothing_and_of_empty_texts(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", None), (2, "a b", "x")], "doc_id long, text string, source string")
    margins = {"source": (F.col("source"), {"x": 1.0})}
    assert {r.doc_id: (r.mix_tokens, r.mix_p) for r in mix(df, margins, 0.5, word_count(F.col("text"))).collect()} == {None: (0, 0.0), 1: (0, 0.0), 2: (2, 0.5)}
    assert mix(df.limit(0), margins, 0.5, word_count(F.col("text"))).count() == 0
    with pytest.raises(ValueError):
        mix(df, {"source": (F.col("source"), {"x": -1.0})}, 0.5, F.lit(1))


def _mixed_rows(spark, source, lang, n=400):
    """Rows of 5 words by (doc_id, source, lang); ``source`` and ``lang`` give each row's value."""
    rows = [(i, "some words of plain prose", lang(i), source(i)) for i in range(n)]
    return {r.doc_id: r for r in mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


@pytest.mark.parametrize("source, lang", [(None, None), ("web", "pt"), (None, "en"), ("src3", None), ("web", "en")])
def test_production_shares_keep_tables_of_null_or_unlisted_values(spark, source, lang):
    got = _mixed_rows(spark, lambda i: source, lambda i: lang)
    assert {round(r.mix_p, 9) for r in got.values()} == {0.5}
    assert 150 < sum(r.mix_sampled for r in got.values()) < 250


def test_production_shares_keep_listed_values_that_meet_in_no_cell(spark):
    got = _mixed_rows(spark, lambda i: "src1" if i % 2 else None, lambda i: "en" if i % 2 == 0 else "pt")
    assert {round(r.mix_p, 9) for r in got.values()} == {0.5}


def test_production_shares_leave_null_and_unlisted_values_their_share(spark):
    rng = random.Random(6)
    sources, langs = [rng.choices([None, "web", "src1", "src2"], [2, 1, 4, 3])[0] for _ in range(4000)], [rng.choices([None, "pt", "en", "fr"], [1, 1, 5, 3])[0] for _ in range(4000)]
    got = _mixed_rows(spark, sources.__getitem__, langs.__getitem__, 4000).values()
    assert all(r.mix_p > 0 for r in got)
    expected = sum(r.mix_p for r in got)
    assert abs(expected / 4000 - 0.5) < 0.001
    for values, column, listed in ((sources, "mix_source", {"src1": 0.5, "src2": 0.5}), (langs, "mix_lang", {"en": 5 / 7, "fr": 2 / 7})):
        other = sum(v not in listed for v in values) / 4000
        for value, want in {"(other)": other, **{v: s * (1 - other) for v, s in listed.items()}}.items():
            assert abs(sum(r.mix_p for r in got if r[column] == value) / expected - want) < 0.02


def test_mixing_drops_others_only_by_a_share_that_names_them(spark):
    df = spark.createDataFrame([(1, 5, "x", "q"), (2, 5, None, "z"), (3, 5, "y", None)], "doc_id long, n long, source string, lang string")
    p = lambda margins: {r.doc_id: round(r.mix_p, 6) for r in mix(df, margins, 0.3, F.col("n")).collect()}
    assert p({"source": (F.col("source"), {"x": 1.0, "(other)": 0.0})}) == {1: 0.9, 2: 0.0, 3: 0.0}
    assert p({"source": (F.col("source"), {"w": 1.0, "(other)": 0.0})}) == {1: 0.0, 2: 0.0, 3: 0.0}
    assert p({"source": (F.col("source"), {"x": 1.0, "(other)": 0.0}), "lang": (F.col("lang"), {"z": 1.0, "(other)": 0.0})}) == {1: 0.0, 2: 0.0, 3: 0.0}


def test_long_chunks_bare_and_with_signs_in_one_portion():
    urls = [f"https://example.org/{i:04d}/a/path/that/is/longer/than/what/is/remembered" for i in range(60)]
    texts = [f"{u} {u}. {u}, word ({u}/) {u}" for u in urls]
    own = tokens.ChunkTokenizer(vocabulary())
    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in (LIBRARY.encode(t, add_special_tokens=False).ids for t in texts)]
    for _ in range(2):
        assert own.ids([t.encode() for t in texts]) == want
        assert max(map(len, own.young)) <= tokens.LONG


def test_index_of_sums_finds_a_filling_while_there_is_one():
    import itertools
    import random

    chance = random.Random(3)
    for _ in range(200):
        counts = {chance.randint(1, 30): chance.randint(1, 3) for _ in range(chance.randint(0, 9))}
        shelf = Shelf(counts, 40)
        for _ in range(30):
            gap = chance.randint(1, 40)
            there = [x for x, n in enumerate(shelf.left) for _ in range(n)]
            found = shelf.fill(gap)
            assert bool(found) == any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(there, k))
            if found:
                assert sum(found) == gap and shelf.allows(found)
                for x in found:
                    shelf.take(x, 1)
