"""TIFF storing and reading, and secret scans."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saltmarsh.llm import tiff
from saltmarsh.llm.queries import op3_tiff, vocabulary
from saltmarsh.llm.secret_scan import _encoder, find_secrets, is_known, scan_secrets


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600) | st.integers(0, 3).flatmap(lambda b: st.integers(0, 9000).map(lambda n: bytes([b]) * n)))
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_lzw_through_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("scheme", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_of_all_layouts(order, scheme, predictor):
    rng = np.random.default_rng(2)
    pages = [
        tiff.Page(rng.integers(0, 9, (37, 50, 1), dtype=np.uint8), scheme, predictor, rows_per_strip=8),
        tiff.Page(rng.integers(0, 60000, (33, 40, 3), dtype=np.uint16), scheme, predictor, tile=(16, 32)),
        tiff.Page(rng.integers(0, 9, (20, 21, 3), dtype=np.uint8), scheme, predictor, planar=2, rows_per_strip=7),
    ]
    got = list(tiff.read_tiff(tiff.write_tiff(pages, order)))
    assert len(got) == 3
    for page, (image, own, p) in zip(pages, got, strict=True):
        assert own == scheme and p == predictor and (image == page.pixels).all()


def test_one_row_for_each_page_and_each_fault(spark):
    two = tiff.write_tiff([tiff.Page(np.full((4, 4, 1), k, np.uint8)) for k in (1, 2)])
    circle = bytearray(two)
    circle[-4:] = circle[4:8]
    rows = [(1, two), (2, None), (3, b"no image"), (4, bytes(circle)), (5, two[:40]), (None, b"")]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = sorted(((r.doc_id or 0, r.page, r.error is None) for r in tiff.tiff_pages(df).collect()))
    assert got == [(0, 0, False), (1, 0, True), (1, 1, True), (3, 0, False), (4, 0, True), (4, 1, True), (4, 2, False), (5, 0, False)]
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_texts_come_back(spark, tmp_path):
    rows = [(1, "abc"), (2, ""), (3, None), (None, "é" * 40), (3, "x" * 300000), (5, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_tiff(spark, str(tmp_path)).collect()
    want = sorted(hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest() for _, t in rows)
    assert sorted(r.payload_sha256 for r in got) == want
    twins = [r for r in got if r.doc_id in (1, 5)]
    assert twins[0].media_sha256 == twins[1].media_sha256 and twins[0].feature == twins[1].feature


ENCODER = _encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_base_patterns():
    text = 'é PassWord="abcdef" api_key:abc token = 123456 AKIA' + "A" * 16 + " AKIAAAA " + "0a" * 12 + " " + "0a" * 11 + " passſword=abcdefgh"
    data = text.encode()
    kinds = [(k, data[s:e].decode()) for s, k, e in find_secrets(data, ENCODER, 2.2) if k < 3]
    assert kinds == [(0, 'PassWord="abcdef'), (0, "token = 123456"), (1, "AKIA" + "A" * 16), (2, "0a" * 12)]


def test_random_strings_and_what_is_known():
    rng = random.Random(6)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    found = find_secrets(f"see {run} there".encode(), ENCODER, 2.2)
    assert found == [(4, 3, 44)]
    for plain in ("the-quick-brown-fox-jumps-over-2024", "SomeVeryLongClassNameOfJava", "123e4567-e89b-12d3-a456-426614174000", hashlib.sha1(b"x").hexdigest().upper(), "internationalization-and-localization"):
        assert is_known(plain.encode(), frozenset()) and not [f for f in find_secrets(plain.encode(), ENCODER, 2.2) if f[1] == 3]
    assert not find_secrets(run.encode(), ENCODER, 2.2, frozenset([run.encode()]))


def test_scan_secrets_rows(spark):
    rows = [(1, "é token=abcdef12 x"), (None, None), (2, ""), (2, ""), (3, "w " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_secrets(df, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    assert [(s.kind, s.start, s.end) for r in got if r.doc_id == 1 for s in r.spans] == [("assign", 2, 16)]
    assert all(not r.spans for r in got if r.doc_id != 1)
