"""Quality by regularised quadratic discriminant analysis over statistics of a document.

Each text gives a short vector of transformed counts. For both classes the mean and covariance
are summed over all training rows in one Spark aggregation. The covariance of a class is
shrunk towards that of both classes and then towards its diagonal; its Cholesky factor is kept,
so that a score costs two triangular solves. The score is the probability that follows from
the difference of the two Mahalanobis log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, stored

STATISTICS = (
    "word_length", "symbols", "digits", "stops", "capitals", "lines", "distinct",
    "short_words", "bare_marks", "top_word", "repeated_lines",
)
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\x0b\x0c")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True
_LETTERS = _CAPITALS.copy()
_LETTERS[97:123] = True
_LETTERS[128:] = True
_SYMBOLS = ~(_STOPS | _SPACES | _DIGITS | _LETTERS)
_SYMBOLS[list(b"'-")] = False


# Usual shares in plain prose, and how many words, characters or lines of it are
# added to a text, so that a text of a few words isn't taken for an extreme one.
USUAL = {
    "symbols": 0.003, "digits": 0.003, "stops": 0.03, "capitals": 0.03, "lines": 0.05, "distinct": 0.8,
    "short_words": 0.25, "bare_marks": 0.02, "top_word": 0.05, "repeated_lines": 0.05,
}
ADDED = 20.0


def _odds(name: str, part: float, whole: float) -> float:
    """Smoothed log odds of a share, near normal for shares of any size."""
    part, whole = part + ADDED * USUAL[name], whole + ADDED
    return float(np.log(part / (whole - part)))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; an empty or null text has those of no words."""
    text = text or ""
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = int(seen.sum() - seen[_SPACES].sum())
    words = text.split()
    count = len(words)
    lengths = np.fromiter(map(len, words), np.int64, count)
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = text.split("\n")
    return [
        float(np.log((lengths.sum() + 6.0 * ADDED) / (count + ADDED))),
        _odds("symbols", int(seen[_SYMBOLS].sum()), size),
        _odds("digits", int(seen[_DIGITS].sum()), size),
        _odds("stops", int(seen[_STOPS].sum()), size),
        _odds("capitals", int(seen[_CAPITALS].sum()), size),
        _odds("lines", len(lines), count + len(lines)),
        _odds("distinct", len(tally), count),
        _odds("short_words", int((lengths <= 3).sum()), count),
        _odds("bare_marks", int((lengths == 1).sum()), count),
        _odds("top_word", max(tally.values(), default=0), count),
        _odds("repeated_lines", len(lines) - len(set(lines)), len(lines)),
    ]


@F.udf(T.ArrayType(T.DoubleType()), useArrow=True)
def _statistics(text: str):
    return statistics(text)


def with_statistics(docs: DataFrame, text: str = "text", output: str = "statistics") -> DataFrame:
    """Adds ``output``, the statistics of each whole text; a column of that name is replaced."""
    return shipped(docs).withColumn(output, _statistics(F.col(text).cast("string")))


@dataclass
class Discriminant:
    """Means, Cholesky factors and log priors of class 0 and 1; ``constant`` if one class is all there is."""

    means: np.ndarray
    factors: np.ndarray
    priors: np.ndarray
    constant: float | None = None
    spread: float = 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            solved = np.linalg.solve(factor, (rows - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (solved**2).sum(axis=0))
        odds = np.clip((logs[1] - logs[0]) / self.spread, -500, 500)
        return 1.0 / (1.0 + np.exp(-odds))


def fit_discriminant(
    rows: DataFrame, label: str, statistics: str = "statistics", towards_both: float = 0.3,
    towards_diagonal: float = 0.05, spread: float = 2.0,
) -> Discriminant:
    """A model from all rows whose label is 0 or 1.

    ``towards_both`` is the share of the covariance of both classes in that of each,
    ``towards_diagonal`` the share taken off what lies beside the diagonal, and ``spread``
    divides the log odds, since statistics of one text are not as independent as a normal
    density takes them to be. Only sums reach the driver: one row for each class.
    """
    size = len(STATISTICS)
    at = [F.col(statistics)[i] for i in range(size)]
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(at[i]).alias(f"s{i}") for i in range(size)]
    sums += [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(size) for j in range(i, size)]
    found = {r[label]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(*sums).collect()}
    if len(found) < 2:
        only = float(next(iter(found), 0.5))
        return Discriminant(np.zeros((2, size)), np.stack([np.eye(size)] * 2), np.zeros(2), only)
    counts = np.array([found[c]["n"] for c in (0, 1)], float)
    means, spreads = [], []
    for c in (0, 1):
        mean = np.array([found[c][f"s{i}"] for i in range(size)]) / found[c]["n"]
        products = np.array([[found[c][f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        means.append(mean)
        spreads.append(products / found[c]["n"] - np.outer(mean, mean))
    both = (counts[:, None, None] * np.stack(spreads)).sum(axis=0) / counts.sum()
    factors = []
    for own in spreads:
        mixed = (1 - towards_both) * own + towards_both * both
        diagonal = np.diag(np.maximum(np.diag(mixed), 0.0))
        mixed = (1 - towards_diagonal) * mixed + towards_diagonal * diagonal
        factors.append(np.linalg.cholesky(mixed + 1e-4 * np.eye(size)))
    return Discriminant(np.stack(means), np.stack(factors), np.log(counts / counts.sum()), spread=spread)


def score_quality(rows: DataFrame, model: Discriminant, statistics: str = "statistics", output: str = "score") -> DataFrame:
    """Adds ``output``, the probability of class 1 between 0 and 1, for every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(values: pd.Series) -> pd.Series:
        data = np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, len(STATISTICS)))
        return pd.Series(shared.value.scores(data))

    return shipped(rows).withColumn(output, score(F.col(statistics)))


def one_label(labels: DataFrame, label: str, id: str = "doc_id") -> DataFrame:
    """One label for each id, the largest of repeated ones; rows without id or label go."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(id).agg(F.max(label).alias(label))


def quality_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from labels of the others."""
    rows = stored(with_statistics(docs.select("doc_id", "text", held_out.alias("held_out"))).drop("text"), "statistics")
    known = rows.where(~F.col("held_out")).join(one_label(labels.select("doc_id", "quality"), "quality"), "doc_id")
    scored = score_quality(rows, fit_discriminant(known, "quality"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
