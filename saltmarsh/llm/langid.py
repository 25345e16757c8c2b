"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.ftrl import Ftrl, probabilities, sums_by
from saltmarsh.llm.hashing import mix
from saltmarsh.llm.quality import sampled
from saltmarsh.llm.scratch import fresh
from saltmarsh.llm.tokens import in_portions
from saltmarsh.llm.worker import cache_of, small_batches, task

BITS = 16
LONGEST = 3
#: At most so many labelled rows are learned from; every fifth of them sets the temperature.
SAMPLE = 6000
EPOCHS = 2
#: The term frequencies of a text add up to this, however long it is.
SCALE = 16.0
UNKNOWN = "und"

#: Bytes that are looked at together; longer texts are cut between characters.
STEP = 1 << 18

_lower: list[np.ndarray] = cache_of([], "language")


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for all that aren't letters."""
    if not _lower:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _lower.append(table)
    return _lower[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of 1 to LONGEST letters of each text in turn, where each text's begin, and letters by text.

    All that isn't a letter counts as the edge of a word, one sign that n-grams may begin or
    end with; those without letters don't count. Rows by length of n-gram, of equal width;
    -1 stands for none. Each text has an edge before it and two after it, so none of its
    n-grams depends on its neighbours.
    """
    joined = "\n" + "\n\n\n".join(texts) + "\n\n"
    return _grams(joined, np.cumsum([0, *(len(t) + 3 for t in texts)]))


def _grams(joined: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams that begin at each character of ``joined`` before the last of ``at``; what follows is only looked at."""
    code = _letters()[np.frombuffer(joined.encode("utf-32-le"), "<u4")].astype(np.uint64)
    found = np.full((LONGEST, int(at[-1])), -1, dtype=np.int32)
    key, some = np.zeros(len(code), dtype=np.uint64), np.zeros(len(code), dtype=bool)
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        some = some[:m] | (code[n - 1 :] > 0)
        if n > 2:  # not across words
            some &= code[1 : m + 1] > 0
        k = min(m, found.shape[1])
        found[n - 1, :k] = np.where(some[:k], (mix(key[:k] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32), -1)
    return found, at, sums_by(code[: int(at[-1])] > 0, at)


def gram_parts(texts: list[bytes]):
    """The n-grams of all texts, of a bounded number of bytes at a time: (index of the first text, found, at, letters).

    A text of up to STEP bytes is in one part, with others; a longer one comes in several parts of its own.
    """
    short, first, held = [], 0, 0
    for i, data in enumerate(texts):
        if len(data) <= STEP and held <= STEP:
            short.append(data.decode())
            held += len(data)
            continue
        if short:
            yield first, *ngrams(short)
        short, first, held = [], i + 1, 0
        if len(data) <= STEP:
            short, first, held = [data.decode()], i, len(data)
            continue
        low = 0
        while low < len(data):
            high = min(len(data), low + STEP)
            while high < len(data) and data[high] & 0xC0 == 0x80:
                high += 1
            own = ("\n" if low == 0 else "") + data[low:high].decode() + ("\n\n" if high == len(data) else "")
            after = data[high : high + 4 * LONGEST].decode(errors="ignore")[: LONGEST - 1] + "\n\n"
            yield i, *_grams(own + after[: LONGEST - 1], np.array([0, len(own)]))
            low = high
    if short:
        yield first, *ngrams(short)


def _counter():
    """In how many texts of a task each n-gram is, as rows (gram, n); gram -1 counts the texts."""

    @task("language")
    def count(batches):
        import pyarrow as pa

        texts, counts = 0, np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for portion in in_portions(batch.column("_text")):
                there, last = np.zeros((1 << BITS) + 1, dtype=bool), None
                for first, found, at, _ in gram_parts([d for _, d in portion]):
                    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        if first + k != last:
                            counts += there[:-1]
                            there[:], last = False, first + k
                        there[found[:, a:b]] = True
                counts += there[:-1]
                texts += len(portion)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[held], texts))], ["gram", "n"])

    return count


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log((1 + texts) / (1 + texts with the n-gram)) + 1 of each hashed n-gram, over all of ``docs``."""
    counts = docs.select(F.col(text_col).alias("_text")).mapInArrow(_counter(), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # 2 ** BITS + 1 rows at most
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    texts, by_gram = int(n[grams == -1].sum()), np.zeros(1 << BITS)
    by_gram[grams[grams >= 0]] = n[grams >= 0]
    return np.log((1 + texts) / (1 + by_gram)) + 1


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """What to divide scores by so that their softmax has the least log loss, between 1/16 and 16."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(probabilities(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, part = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        if loss(2**a) <= loss(2**b):
            high = b
        else:
            low = a
    return float(2 ** ((low + high) / 2))


def _counted(portion):
    """(position, n-grams, how often each is there) of each text of a portion; none for a text without letters."""
    merged: dict[int, list] = {}
    for first, found, at, _ in gram_parts([d for _, d in portion]):
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            grams = found[:, a:b]
            merged.setdefault(first + k, []).append(np.unique(grams[grams >= 0], return_counts=True))
    for k, parts in merged.items():
        if len(parts) > 1:
            places, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            parts = [(places, np.bincount(where, np.concatenate([c for _, c in parts]), len(places)))]
        places, counts = parts[0]
        yield portion[k][0], places.astype(np.uint16), counts.astype(np.int32)


def _trainer(idf, alpha: float, l1: float, l2: float):
    @task("language")
    def train(batches):
        import pyarrow as pa

        examples, scale = [], idf.value
        for batch in batches:
            langs, keys = batch.column("_lang").to_pylist(), batch.column("_key").to_pylist()
            for portion in in_portions(batch.column("_text")):
                for i, places, counts in _counted(portion):
                    if len(places):
                        examples.append((keys[i], langs[i], places, counts))
        values_of = lambda e: e[3] * scale[e[2]] * (SCALE / e[3].sum())
        examples.sort(key=lambda e: (e[0] is None, e[0] or 0, e[1], e[2].tobytes(), e[3].tobytes()))
        langs = sorted({e[1] for e in examples})
        model, order = Ftrl(1 << BITS, max(2, len(langs)), alpha, l1=l1, l2=l2), np.random.default_rng(7)
        learned = [e for i, e in enumerate(examples) if i % 5]
        kept = examples[::5]
        for _ in range(EPOCHS):
            for i in order.permutation(len(learned)):
                model.learn(learned[i][2], values_of(learned[i]), langs.index(learned[i][1]))
        weights = model.weights()
        scores = np.array([weights[:, e[2]] @ values_of(e) + weights[:, -1] for e in kept]).reshape(len(kept), -1)[:, : len(langs)]
        t = temperature(scores, np.array([langs.index(e[1]) for e in kept], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(langs)]), pa.array([t]), pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["langs", "temperature", "weights"])

    return train


def fit_languages(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", most: int = SAMPLE, alpha: float = 0.3, l1: float = 0.02, l2: float = 0.01) -> tuple[list[str], float, np.ndarray]:
    """Languages, temperature and weights (languages x n-grams and a bias, times the inverse frequencies).

    Learned only from rows with text and language for which ``learn`` holds: inverse
    document frequencies from all of them, and the regression from at most ``most`` of
    them, in one task of that bound.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    idf = inverse_frequencies(rows, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    few = sampled(rows, F.col(id_col), rows.select(id_col).count(), most)
    few = few.select(F.col(id_col).cast("long").alias("_key"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    row = few.coalesce(1).mapInArrow(_trainer(shared, alpha, l1, l2), "langs string, temperature double, weights binary").collect()
    langs = json.loads(row[0].langs) if row else []
    if not langs:
        return [], 1.0, np.zeros((0, (1 << BITS) + 1), dtype=np.float32)
    weights = np.frombuffer(row[0].weights, "<f4").reshape(-1, (1 << BITS) + 1)[: len(langs)].astype(np.float64)
    weights[:, :-1] *= idf
    return langs, row[0].temperature, weights.astype(np.float32)


def predict_languages(docs: DataFrame, model: tuple[list[str], float, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` and ``names``: the language and its calibrated probability, for each row.

    ``und`` with score 0 for a text that is null or has no letter, and for any if no
    language was learned. Equal scores: the language that sorts first. Repeated rows each get
    theirs. Columns of ``keep`` with one of ``names`` are replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    langs, t, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = tuple(c for c in keep if c not in names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    column = text_col if text_col in keep else fresh("_text", keep)

    @task("language")
    def predict(batches):
        import pyarrow as pa

        own = [np.append(row[:-1], np.float32(0)) for row in shared.value]  # -1 looks the last one up
        bias = shared.value[:, -1]
        for batch in batches:
            for portion in in_portions(batch.column(column)):
                n = len(portion)
                letters, size, scores = np.zeros(n), np.zeros(n), np.zeros((n, len(langs)))
                for first, found, at, some in gram_parts([d for _, d in portion]):
                    span = slice(first, first + len(at) - 1)
                    letters[span] += some
                    for row in found:
                        size[span] += sums_by(row >= 0, at)
                        for k in range(len(langs)):
                            scores[span, k] += sums_by(own[k][row], at)
                scores = scores * (SCALE / np.maximum(1, size))[:, None] + bias
                known = (letters > 0) & (len(langs) > 0)
                odds = probabilities(scores / t) if len(langs) > 1 else np.ones((n, max(1, len(langs))))
                best = odds.argmax(axis=1)
                best_names = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                kept = [batch.column(c).slice(portion[0][0], n) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best_names, pa.string()), pa.array(np.where(known, odds.max(axis=1), 0.0))], [*keep, *names])

    source = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias(column))
    return source.mapInArrow(predict, ", ".join([*([schema] if schema else []), f"`{names[0]}` string", f"`{names[1]}` double"]))
