"""Logistic regression trained by follow-the-regularised-leader (proximal) updates."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``classes`` sparse linear scores over ``dims`` features and a bias, with L1 and L2 penalties.

    One class: a sigmoid. More: a softmax. State is z and n for each weight; the weights
    themselves follow from these, so that L1 keeps them exactly 0 until there is evidence.
    """

    def __init__(self, dims: int, classes: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.dims, self.alpha, self.beta, self.l1, self.l2 = dims, alpha, beta, l1, l2
        self.z, self.n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example: features ``at`` (each once) with ``values``; a label from 0, or 0 or 1 with one class."""
        at, values = np.append(at, self.dims), np.append(values, 1.0)
        w = self.weights(at)
        error = probabilities((w @ values)[None, :])[0]
        error[0 if len(error) == 1 else label] -= label if len(error) == 1 else 1
        g = error[:, None] * values
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Of rows of scores: a sigmoid of single ones, else a softmax."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] for each i; 0 of none."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]
