"""Isotonic calibration from binned scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2000


def pool(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Rising rates that fit the bins best (pool adjacent violators); empty bins take the last."""
    blocks: list[list[float]] = []
    for n, p in zip(counts, positives):
        blocks.append([float(p), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, n1, w1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + n1, blocks[-1][2] + w1]
    rates, last = [], 0.0
    for p, n, w in blocks:
        last = p / n if n else last
        rates.extend([last] * int(w))
    return np.array(rates)


def fit(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None,
        bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(knots, rates) to interpolate between; scores are cut into bins of equal width."""
    weights = np.ones(len(scores)) if weights is None else weights
    lo, hi = (float(scores.min()), float(scores.max())) if len(scores) else (0.0, 1.0)
    width = (hi - lo) / bins or 1.0
    at = np.clip(((scores - lo) / width).astype(int), 0, bins - 1)
    counts = np.bincount(at, weights, bins)
    positives = np.bincount(at, weights * labels, bins)
    return from_bins(lo, width, counts, positives)


def from_bins(lo: float, width: float, counts: np.ndarray,
              positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.array([0.0]), np.array([0.5])
    return lo + (seen + 0.5) * width, pool(counts[seen], positives[seen])


def fit_frame(scored: DataFrame, score: str, label: str,
              bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The same from a table: only the bins' counts reach the driver."""
    ends = scored.agg(F.min(score), F.max(score)).first()
    if ends[0] is None:
        return np.array([0.0]), np.array([0.5])
    lo, width = ends[0], (ends[1] - ends[0]) / bins or 1.0
    at = F.least(F.floor((F.col(score) - lo) / width), F.lit(bins - 1)).cast("int")
    rows = scored.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).collect()
    counts, positives = np.zeros(bins), np.zeros(bins)
    for r in rows:
        counts[r["bin"]], positives[r["bin"]] = r["n"], r["p"]
    return from_bins(lo, width, counts, positives)
