"""Exact dedup and line dedup against brute force, with the odd cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm.exact_dedup import exact_dedup
from saltmarsh.llm.line_dedup import LAST_ID, line_dedup

FOLD = {i: i + 32 for i in range(65, 91)}


def test_exact_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "abc", "ABC", "aBÉ", "abé", "abÉ", "x" * 5000, "X" * 5000, "x" * 5000 + "y", "p" * 300 + "a", "p" * 300 + "b"]
    rows = [(i, rng.choice(texts), "other") for i in range(200)] + [(None, "abc", "n"), (None, None, "n"), (7, "dup", "d"), (7, "dup", "d"), (9, "é", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = exact_dedup(df, digest_all=True).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    want = []
    for i, t, _ in rows:
        norm = (t or "").translate(FOLD)
        ids = groups[norm]
        want.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(repr, want))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_hashes_only_survivors(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "One")], "doc_id long, text string")
    got = {r.doc_id: r.text_sha256 for r in exact_dedup(df).collect()}
    assert got[3] is None and got[2] is None
    assert got[1] == got[4] == hashlib.sha256(b"one").hexdigest()


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id long, text string, extra string"])
def test_empty_tables(spark, schema):
    df = spark.createDataFrame([], schema)
    assert exact_dedup(df).count() == 0
    assert line_dedup(df).count() == 0


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup_equals_brute_force(spark, edits):
    rng = random.Random(3)
    alphabet = "abé "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(40)]

    def changed(line):
        i, kind = rng.randrange(len(line) + 1), rng.random()
        return line[:i] + rng.choice(alphabet) + line[i + (kind < 0.3) :] if kind < 0.6 else line[:i] + line[i + 1 :] if kind < 0.9 else line

    rows = [(i if i % 37 else None, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6))), "x") for i in range(120)]
    rows += [(500, None, "x"), (3, "z" * 60, "y"), (3, "z" * 60, "y"), (4, "z" * 30 + "q" + "z" * 29, "y"), (600, "long " * 9000, "l"), (601, "long " * 8999 + "lung ", "l"), (602, "\n \n\t", "blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h1 string")
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    lines, seen = [], set()
    for d, t, h in hashed:
        if t is not None and (d, h) not in seen:
            seen.add((d, h))
            lines += [((LAST_ID if d is None else d, h, p), x.strip(" \t\r")) for p, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    lines.sort()
    gone = {k for i, (k, x) in enumerate(lines) if any(x == y or edits and len(x) >= 10 and len(y) >= 10 and within_one(x, y) for _, y in lines[:i])}
    want = []
    for d, t, h in hashed:
        if t is None:
            want.append((d, None, 0, 0))
            continue
        all_lines = t.split("\n")
        kept = [x for p, x in enumerate(all_lines) if (LAST_ID if d is None else d, h, p) not in gone]
        want.append((d, "\n".join(kept), sum(bool(x.strip(" \t\r")) for x in all_lines), len(all_lines) - len(kept)))
    out = line_dedup(df, max_edits=edits, near_min_chars=10)
    assert out.columns == ["doc_id", "text", "_h1", "n_lines", "n_dropped"]
    assert sorted(map(repr, [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()])) == sorted(map(repr, want))


def test_line_dedup_rejects_other_bounds(spark):
    with pytest.raises(ValueError):
        line_dedup(spark.createDataFrame([], "doc_id long, text string"), max_edits=2)


def test_line_dedup_equals_brute_force_at_the_defaults(spark):
    rng = random.Random(9)
    alphabet = "abé "
    base = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 5, 12, 18, 19, 19, 19, 20, 20, 20, 21, 21, 22, 25, 30, 45, 80)]

    def changed(line):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, kind = rng.randrange(len(line) + 1), rng.random()
            line = line[:i] + rng.choice(alphabet) + line[i + (kind < 0.5) :] if kind < 0.7 else line[:i] + line[i + 1 :]
        return line

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(5))) for i in range(80)]
    lines = [((d, p), x.strip(" \t\r")) for d, t in rows for p, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    gone = {k for i, (k, x) in enumerate(lines) if any(x == y or within_one(x, y) for _, y in lines[:i])}
    # short lines go for near ones too, not for equal ones only
    assert any(k in gone and len(x) < 20 and all(x != y for _, y in lines[:i]) for i, (k, x) in enumerate(lines))
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}
    assert {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
