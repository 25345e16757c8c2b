"""Evidence about a value: integer features, exclusion, points by group, bands. Never changes a finding."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.placeholders import kind_of_reference

# Names of the features in order.
FEATURES = (
    "byte_len analysed_chars truncated distinct_symbols max_symbol_count shannon_entropy_q16 min_entropy_q16 information_bits_q16 class_lower class_upper class_digit class_symbol "
    "class_space_control class_non_ascii class_count class_transitions class_alphabet_size entropy_efficiency_permille alphabet_efficiency_permille distinct_ratio_permille length_permille "
    "longest_run adjacent_repeat_permille repeated_bigram_permille smallest_period max_autocorrelation_permille max_autocorrelation_lag residual_symbols residual_entropy_q16 residual_min_entropy_q16"
).split()
MOST_SYMBOLS, MOST_LAG = 256, 32
CLASS_SIZES = (26, 26, 10, 32, 34)
# The scoring model.
RAMP_LOW, RAMP_HIGH, RAMP_POINTS = 234123, 263562, 30
CONTEXT_POINTS, EXCLUSION_POINTS = 50, 130
CAPS = {"randomness": 30, "lexical": 0, "contextual": 50, "validation": 50, "negative": 130}
BANDS = (("high", 51), ("medium", 40), ("low", 35))
CREDENTIAL_CONTEXTS = ("credential-name", "authorization-header", "url-userinfo")
DETERMINISTIC = ("private_key", "provider", "structural")


def log2_q16(x: int) -> int:
    """Binary logarithm in 1/65536, by repeated squaring: the same on any machine."""
    if x == 0:
        return 0
    whole = x.bit_length() - 1
    m, fraction = x << (32 - whole), 0
    for _ in range(16):
        m = m * m >> 32
        high = m >> 33
        fraction, m = fraction << 1 | high, m >> high
    return whole << 16 | fraction


def permille(a: int, b: int) -> int:
    return 1000 * a // b if b else 0


def _entropies(symbols: list[int]) -> tuple[int, int]:
    n, counts = len(symbols), Counter(symbols)
    if not n:
        return 0, 0
    return max(0, log2_q16(n) - sum(c * log2_q16(c) for c in counts.values()) // n), max(0, log2_q16(n) - log2_q16(max(counts.values())))


def _class(x: int) -> int:
    if x >= 0x80:
        return 5
    c = chr(x)
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if x <= 0x20 or x == 0x7F else 3


def residual(s: list[int]) -> list[int]:
    """The symbols that no repetition, constant step (of one or two) or earlier copy of three predicts."""
    seen, out = set(), []
    for i, x in enumerate(s):
        known = (
            i >= 1 and x == s[i - 1]
            or i >= 2 and x + s[i - 2] == 2 * s[i - 1]
            or i >= 4 and x + s[i - 4] == 2 * s[i - 2]
            or i >= 2 and (s[i - 2], s[i - 1], x) in seen
        )
        if i >= 2:
            seen.add((s[i - 2], s[i - 1], x))
        if not known:
            out.append(x)
    return out


def features(value: str) -> list[int]:
    """The features of a value, over its first MOST_SYMBOLS characters."""
    s = [ord(c) for c in value[:MOST_SYMBOLS]]
    n, counts, kinds = len(s), Counter(s), [_class(x) for x in s]
    d = len(counts)
    h, low = _entropies(s)
    by_kind = [kinds.count(k) for k in range(6)]
    sizes = (*CLASS_SIZES, len({x for x in s if x >= 0x80}))
    alphabet = sum(size for size, c in zip(sizes, by_kind, strict=True) if c)
    run = longest = 0
    for i in range(n):
        run = run + 1 if i and s[i] == s[i - 1] else 1
        longest = max(longest, run)
    bigrams = list(zip(s, s[1:], strict=False))
    same_at = lambda k: sum(s[i] == s[i + k] for i in range(n - k))
    period = next((p for p in range(1, n // 2 + 1) if s[p:] == s[: n - p]), 0)
    lags = [(permille(same_at(k), n - k), -k) for k in range(2, min(MOST_LAG, n // 2) + 1)]
    best, lag = max(lags, default=(0, 0))
    rest = residual(s)
    return [
        len(value.encode()), n, int(len(value) > MOST_SYMBOLS), d, max(counts.values(), default=0), h, low, n * h, *by_kind, sum(c > 0 for c in by_kind), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), alphabet,
        min(1000, permille(h, log2_q16(d))) if d >= 2 else 0, min(1000, permille(h, log2_q16(alphabet))) if alphabet >= 2 else 0, permille(d, n), permille(n, MOST_SYMBOLS), longest,
        permille(sum(a == b for a, b in bigrams), max(0, n - 1)), permille(len(bigrams) - len(set(bigrams)), max(0, n - 1)), period, best, -lag if best else 0, len(rest), *_entropies(rest),
    ]


#: Fewer values of one length are taken one by one.
LEAST_TOGETHER = 8
#: Values are taken together up to so many characters.
TOGETHER = 1 << 18
#: Binary logarithms of all counts and sizes of alphabets that values have.
LOG2 = np.array([log2_q16(x) for x in range(2 * MOST_SYMBOLS + 1)], dtype=np.int64)
CLASS_OF = np.array([_class(x) for x in range(0x81)], dtype=np.int64)
SIZES = np.array(CLASS_SIZES, dtype=np.int64)


def _permilles(a: np.ndarray, b) -> np.ndarray:
    return 1000 * a // np.maximum(b, 1) * (np.asarray(b) > 0)


class Counts:
    """How often each symbol is in each row of a table; negative ones are none. Rows and symbols in order, as flat arrays."""

    def __init__(self, s: np.ndarray):
        self.rows, n = s.shape
        flat = np.sort(s, axis=1).ravel()
        first = np.empty(flat.size, dtype=bool)
        first[0] = True
        np.not_equal(flat[1:], flat[:-1], out=first[1:])
        first[::n] = True
        at = np.flatnonzero(first)
        counts = np.diff(at, append=flat.size)
        there = flat[at] >= 0
        self.row, self.symbol, self.count = (at // n)[there], flat[at][there], counts[there]

    def added(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` by row; exact, as they stay far below 2^53."""
        return np.bincount(self.row, weights=x, minlength=self.rows).astype(np.int64)

    def entropies(self) -> tuple[np.ndarray, np.ndarray]:
        n, most = self.added(self.count), np.zeros(self.rows, dtype=np.int64)
        np.maximum.at(most, self.row, self.count)
        h = np.maximum(0, LOG2[n] - self.added(self.count * LOG2[self.count]) // np.maximum(n, 1))
        return np.where(n > 0, h, 0), np.where(n > 0, np.maximum(0, LOG2[n] - LOG2[most]), 0)


def _known(s: np.ndarray) -> np.ndarray:
    """What ``residual`` leaves out, for values of one length."""
    known = np.zeros(s.shape, dtype=bool)
    known[:, 1:] = s[:, 1:] == s[:, :-1]
    known[:, 2:] |= s[:, 2:] + s[:, :-2] == 2 * s[:, 1:-1]
    known[:, 4:] |= s[:, 4:] + s[:, :-4] == 2 * s[:, 2:-2]
    if s.shape[1] > 3:
        threes = (s[:, :-2] << 42) | (s[:, 1:-1] << 21) | s[:, 2:]
        order = np.argsort(threes, axis=1, kind="stable")
        ordered = np.take_along_axis(threes, order, axis=1)
        again = np.zeros(threes.shape, dtype=bool)
        np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        known[:, 2:] |= again
    return known


def _features_together(s: np.ndarray) -> np.ndarray:
    """``features``, without the length in bytes and whether there was more, of values of one length, a row of code points each."""
    m, n = s.shape
    own = Counts(s)
    kinds = CLASS_OF[np.minimum(s, 0x80)]
    by_kind = np.stack([(kinds == k).sum(axis=1) for k in range(6)])
    d, most = own.added(np.ones(own.row.size)), np.zeros(m, dtype=np.int64)
    np.maximum.at(most, own.row, own.count)
    h, low = own.entropies()
    alphabet = (SIZES[:, None] * (by_kind[:5] > 0)).sum(axis=0) + own.added(own.symbol >= 0x80)
    beside = s[:, 1:] == s[:, :-1]
    run = np.ones(m, dtype=np.int64)
    longest = run.copy()
    for i in range(n - 1):
        run = np.where(beside[:, i], run + 1, 1)
        np.maximum(longest, run, out=longest)
    twos = np.sort((s[:, :-1] << 21) | s[:, 1:], axis=1)
    repeated = (twos[:, 1:] == twos[:, :-1]).sum(axis=1)
    period, best, lag = (np.zeros(m, dtype=np.int64) for _ in range(3))
    for k in range(1, n // 2 + 1):
        same = (s[:, k:] == s[:, :-k]).sum(axis=1)
        period = np.where((period == 0) & (same == n - k), k, period)
        if 2 <= k <= MOST_LAG:
            share = 1000 * same // (n - k)
            lag, best = np.where(share > best, k, lag), np.maximum(share, best)
    rest = Counts(np.where(_known(s), -1, s))
    even = lambda x: np.full(m, x, dtype=np.int64)
    return np.stack([
        even(n), d, most, h, low, n * h, *by_kind, (by_kind > 0).sum(axis=0), (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1), alphabet,
        np.where(d >= 2, np.minimum(1000, _permilles(h, LOG2[d])), 0), np.where(alphabet >= 2, np.minimum(1000, _permilles(h, LOG2[alphabet])), 0), 1000 * d // n, even(permille(n, MOST_SYMBOLS)), longest,
        _permilles(beside.sum(axis=1), even(n - 1)), _permilles(repeated, even(n - 1)), period, best, lag, rest.added(rest.count), *rest.entropies(),
    ], axis=1)


def features_of(values: list[str]) -> np.ndarray:
    """``features`` of many values, a row each: those of one length are worked out together."""
    out = np.empty((len(values), len(FEATURES)), dtype=np.int64)
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        groups.setdefault(min(len(v), MOST_SYMBOLS), []).append(i)
    for n, group in groups.items():
        if n == 0 or len(group) < LEAST_TOGETHER:
            for i in group:
                out[i] = features(values[i])
            continue
        step = max(1, TOGETHER // n)
        for first in range(0, len(group), step):
            part = group[first : first + step]
            text = "".join([values[i][:n] for i in part])
            s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64).reshape(len(part), n)
            made = _features_together(s)
            out[part, 0] = [len(values[i].encode()) for i in part]
            out[part, 1] = made[:, 0]
            out[part, 2] = [len(values[i]) > MOST_SYMBOLS for i in part]
            out[part, 3:] = made[:, 1:]
    return out


def features_column(value: Column) -> Column:
    """A struct of the features."""

    @F.pandas_udf("struct<" + ", ".join(f"{name}: long" for name in FEATURES) + ">")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(features_of([v or "" for v in values]), columns=FEATURES)

    return run(value)


def excluded(value: Column) -> Column:
    """Whether a whole value stands for a credential instead of being one."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and kind_of_reference(v) is not None)

    return run(value)


def halving_sum(points: Column, cap: int) -> Column:
    """Points from the most on, the k-th (from 0) shifted right by k; their sum up to ``cap``."""
    ordered = F.transform(F.reverse(F.array_sort(points)), lambda p, k: (p / F.pow(F.lit(2), k)).cast("int"))
    return F.least(F.lit(cap), F.aggregate(ordered, F.lit(0), lambda a, p: a + p))


def score(residual_entropy: Column, context: Column, exclusion: Column) -> Column:
    """The score of statistical evidence: capped groups added, the negative one taken off."""
    ramp = F.greatest(F.lit(0), F.least(F.lit(RAMP_POINTS), F.floor(F.lit(RAMP_POINTS) * (residual_entropy - RAMP_LOW) / (RAMP_HIGH - RAMP_LOW)))).cast("int")
    contextual = F.when(context.isin(*CREDENTIAL_CONTEXTS), CONTEXT_POINTS).otherwise(0)
    negative = F.when(exclusion, EXCLUSION_POINTS).otherwise(0)
    return F.greatest(F.lit(0), halving_sum(F.array(ramp), CAPS["randomness"]) + halving_sum(F.array(contextual), CAPS["contextual"]) - halving_sum(F.array(negative), CAPS["negative"]))


def band(points: Column) -> Column:
    out = F.when(points >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(points >= least, name)
    return out.otherwise("none")


def shadow(findings: DataFrame, value: Column, context: Column) -> DataFrame:
    """``findings`` with ``authority``, ``score`` and ``band`` next to their own confidence."""
    sure = F.col("specificity").isin(*DETERMINISTIC)
    scored = findings.withColumn("_p", score(features_column(value)["residual_entropy_q16"], context, excluded(value)))
    return scored.select(
        *findings.columns,
        F.when(sure, "deterministic").otherwise("statistical").alias("authority"),
        F.when(~sure, F.col("_p")).alias("score"),
        F.when(sure, F.col("confidence")).otherwise(band(F.col("_p"))).alias("band"),
    )
