"""Quality classifier: logistic regression on hashed word n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.ftrl import Ftrl, probabilities
from saltmarsh.llm.hashing import mix, parts_of
from saltmarsh.llm.tokens import in_portions
from saltmarsh.llm.worker import small_batches, task

BITS = 18
#: At most so many labelled rows are learned from.
SAMPLE = 8000
EPOCHS = 3
#: The features of a text add up to this, however long it is.
SCALE = 24.0


def sampled(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """At most ``most`` of ``rows``, of which there are ``n``, chosen by a hash of ``key`` over all of them."""
    rate = min(1.0, 0.95 * most / max(1, n)) if n > most else 1.0
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(most)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word unigrams and bigrams of each text in turn, and where each text's begin.

    Words are runs of letters and digits, with case, or of signs. A word that repeats the
    one before it gives the bigram of a repeat, whatever the word.
    """
    words, at = parts_of(texts)
    shift = np.uint64(64 - BITS)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    pairs[words[:-1] == words[1:]] = mix(np.array([1], np.uint64))[0]
    both = np.empty(2 * len(words), dtype=np.int64)
    both[0::2] = words >> shift
    both[1::2] = np.append(pairs, np.uint64(0))[: len(words)] >> shift
    return both, 2 * at


def _spans(at: np.ndarray):
    """First and last feature of each text: without the bigram that leads into the next one."""
    return at[:-1], np.maximum(at[:-1], at[1:] - 1)


def _trainer(alpha: float, l1: float, l2: float):
    @task("quality")
    def train(batches):
        import pyarrow as pa

        examples = []
        for batch in batches:
            labels, keys = batch.column("_label").to_pylist(), batch.column("_key").to_pylist()
            for portion in in_portions(batch.column("_text")):
                found, at = features([d for _, d in portion])
                for (i, _), a, b in zip(portion, *_spans(at), strict=True):
                    places, counts = np.unique(found[a:b], return_counts=True)
                    examples.append((keys[i], labels[i], places.astype(np.int32), counts.astype(np.int32), b - a))
        examples.sort(key=lambda e: (e[0] is None, e[0], e[1], len(e[2])))
        model, order = Ftrl(1 << BITS, 1, alpha, l1=l1, l2=l2), np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(examples)):
                _, label, places, counts, n = examples[i]
                model.learn(places, counts * (SCALE / max(1, n)), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights()[0].astype("<f4").tobytes()], pa.binary())], ["weights"])

    return train


def fit_quality(labelled: DataFrame, n: int, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most: int = SAMPLE, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.01) -> np.ndarray:
    """Weights learned from at most ``most`` of the ``n`` rows of ``labelled``, in one task of that bound.

    The rows are put in order of their ids first, so the same rows give the same weights.
    Without any rows all weights are 0, and so all scores 0.5.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1))
    rows = sampled(rows, F.col(id_col), n, most).select(F.col(id_col).cast("long").alias("_key"), F.col(label_col).cast("int").alias("_label"), F.col(text_col).alias("_text"))
    model = rows.coalesce(1).mapInArrow(_trainer(alpha, l1, l2), "weights binary").collect()
    return np.frombuffer(model[0][0], "<f4").astype(np.float64) if model else np.zeros((1 << BITS) + 1)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id and ``score``, the odds that a text is of label 1, for each row.

    The score is the sigmoid of the dot product of the weights and the text's features. A
    null text counts as empty; an empty one gets the bias alone. No shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @task("quality")
    def score(batches):
        import pyarrow as pa

        for batch in batches:
            w, ids = shared.value, batch.column("_id")
            for portion in in_portions(batch.column("_text")):
                found, at = features([d for _, d in portion])
                first, last = _spans(at)
                sums = np.concatenate(([0.0], np.cumsum(w[found], dtype=np.float64)))
                dots = (sums[last] - sums[first]) * SCALE / np.maximum(1, last - first) + w[-1]
                yield pa.RecordBatch.from_arrays([ids.slice(portion[0][0], len(portion)), pa.array(probabilities(dots[:, None])[:, 0])], ["_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(score, "_id long, score double").withColumnRenamed("_id", id_col)


def classify_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most: int = SAMPLE) -> DataFrame:
    """Scores for all ``docs``, learned from the ``labels`` of those for which ``learn`` holds.

    ``learn`` is an expression on the id. The labelled ids learned from are at most ``most``,
    which bounds what is broadcast to fetch their texts. Returns the id, ``held_out`` (not
    learned from, by ``learn``), ``score`` and ``predicted``.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col))
    n = usable.count()
    few = sampled(usable, F.col(id_col), n, most)
    labelled = docs.select(id_col, text_col).join(F.broadcast(few), id_col)
    weights = fit_quality(labelled, docs.select(id_col).join(F.broadcast(few), id_col).count(), text_col, id_col, label_col, most)
    scored = score_quality(docs, weights, text_col, id_col)
    return scored.select(id_col, (~F.coalesce(learn, F.lit(False))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


