"""Which of overlapping candidates stand: the disjoint set of most weight."""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

# Severity of actions.
SEVERITY = {"block": 3, "redact": 2, "warn": 1, "allow": 0}


class Candidate(NamedTuple):
    start: int
    end: int
    type: str
    detector: str
    confidence: int
    specificity: int
    order: int  # of the detector
    emitted: int  # of the candidate in its detector
    severity: int
    obfuscation: str = "none"


def priority(c: Candidate) -> tuple:
    """Better ones compare less: severity, specificity, confidence, then narrower, then earlier."""
    return -c.severity, -c.specificity, -c.confidence, c.end - c.start, c.order, c.emitted


def _weight(c: Candidate, base: int) -> tuple[int, ...]:
    """Such that no number of lesser ranks outweighs one greater: powers of more than all candidates."""
    return base**c.severity, base**c.specificity, base**c.confidence, -(c.end - c.start), -c.order, -c.emitted


def arbitrate(candidates: list[Candidate]) -> list[Candidate]:
    """The disjoint candidates with the greatest sum of weights, by start.

    Weighted interval scheduling over exact integer vectors, compared in turn; of equal
    sums the one without the later candidate. Overlap-free inputs pass at once.
    """
    by_end = sorted(candidates, key=lambda c: (c.end, priority(c)))
    by_start = sorted(candidates, key=lambda c: c.start)
    if all(a.end <= b.start for a, b in zip(by_start, by_start[1:], strict=False)):
        return by_start
    base, ends = len(candidates) + 1, [c.end for c in by_end]
    zero = (0,) * 6
    best: list[tuple[tuple[int, ...], int | None]] = [(zero, None)]  # sum, and which candidate was taken last
    back: list[int] = [0]
    for k, c in enumerate(by_end):
        before = bisect_right(ends, c.start, 0, k)
        taken = tuple(a + b for a, b in zip(best[before][0], _weight(c, base), strict=True))
        if taken > best[-1][0]:
            best.append((taken, k))
            back.append(before)
        else:
            best.append((best[-1][0], None))
            back.append(k)
    kept, at = [], len(by_end)
    while at:
        if best[at][1] is not None:
            kept.append(by_end[best[at][1]])
        at = back[at]
    return sorted(kept, key=lambda c: c.start)
