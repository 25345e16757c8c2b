"""Work in Python: keys dealt out evenly whatever the files are like, evidence of many values at once, batches bounded by bytes."""

import hashlib
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from saltmarsh.operators import evidence
from saltmarsh.plans import catalog


def test_evidence_of_many_values_is_that_of_each():
    rng = random.Random(5)
    values = []
    for _ in range(1500):
        n = rng.choice((0, 1, 2, 3, 4, 5, 8, 35, 64, 256, 257, 300))
        letters = rng.choice(("ab", "0123456789abcdef", "aA0_ \x00é漢😀", "".join(map(chr, range(0x4E00, 0x5000)))))
        value = "".join(rng.choice(letters) for _ in range(n))
        values.append((value[: max(1, n // rng.randint(2, 7))] * 300)[:n] if rng.random() < 0.3 else value)
    values += ["".join(chr(40 + i) for i in range(35))] * 8
    assert evidence.features_of(values).tolist() == [evidence.features(v) for v in values]


def test_keys_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_KEYS", 1000)
    keys = list(range(20_000))
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64())}), tmp_path / "orders.parquet", row_group_size=len(keys))
    values = catalog._evidence(spark, str(tmp_path))
    sizes = values.select("o_orderkey").rdd.glom().map(len).collect()
    assert len(sizes) == 20 and max(sizes) <= 1010
    found = {r["o_orderkey"]: r["distinct_symbols"] for r in values.collect()}
    assert found == {k: len({*"Aa-", *hashlib.md5(f"0-{k}".encode()).hexdigest()}) for k in keys}


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 16
    before = spark.conf.get(key)
    monkeypatch.setattr(catalog, "BATCH_BYTES", most)
    pq.write_table(pa.table({"doc_id": pa.array(range(1600), pa.int64()), "text": ["mail me at joe@mail-host.dev " * 70] * 1600}), tmp_path / "documents.parquet")

    @F.pandas_udf("long")
    def bytes_together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    try:
        spark.conf.unset(key)
        texts = catalog._read(spark, str(tmp_path), "documents", "doc_id", "text")
        assert texts.select(bytes_together("text").alias("n")).agg(F.max("n")).first()[0] <= 2 * most
        found = catalog.queries()["pii_identity_addresses"](spark, str(tmp_path)).collect()
        assert {(r["family"], r["n"]) for r in found} == {("email", 70)} and len(found) == 1600
    finally:
        spark.conf.set(key, before)
