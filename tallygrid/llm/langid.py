"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of -1 and 1. One binary logistic classifier over hashed letter
n-grams predicts each bit. A text gets the language whose codeword has the least loss, each
bit weighted by how well its classifier did in training; texts whose two best codewords are
nearly as good are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import hashed_share, shipped

UNDETERMINED = "und"
BITS = 12
STRETCH = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased text, None without a letter.

    Whatever is no letter counts as a space. Long texts are counted stretch by stretch, which
    overlap by two characters, so memory stays bounded and no n-gram is lost.
    """
    letters, size, seen = _letters(), 1 << bits, False
    total = np.zeros(size, np.int64)
    shift = np.uint32(32 - bits)
    for start in range(0, len(text), STRETCH):
        lowered = text[max(0, start - 2) : start + STRETCH].lower()
        codes = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters[codes]
        seen = seen or bool(is_letter.any())
        # Runs of other characters become one space, and the text gets a space at either end.
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        codes = np.concatenate(([32], np.where(is_letter, codes, 32)[keep], [32])).astype(np.uint32)
        one, two, three = codes * np.uint32(0x9E3779B1), codes * np.uint32(0x85EBCA77), codes * np.uint32(0xC2B2AE3D)
        for grams in (one, one[:-1] + two[1:], one[:-2] + two[1:-1] + three[2:]):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> shift, minlength=size)
    return total if seen else None


def features(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Root counts of n-grams at unit length, None for a text without a letter."""
    counts = ngram_counts(text, bits) if text else None
    if counts is None:
        return None
    roots = np.sqrt(counts).astype(np.float32)
    return roots / np.linalg.norm(roots)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 for each class; every column splits the classes in another way.

    Up to six classes get all splits. More get random halves, kept if they are new, until the
    words are long enough to be far apart.
    """
    if classes < 2:
        return np.ones((classes, 0), np.float32)
    columns = []
    if classes <= 6:
        rest = range(1, classes)
        for size in range(1, classes):
            for chosen in combinations(rest, size):
                columns.append([1 if c in chosen else -1 for c in range(classes)])
    else:
        random, seen = np.random.default_rng(seed), set()
        while len(columns) < int(np.ceil(10 * np.log2(classes))):
            column = np.where(random.permutation(classes) < classes // 2, 1, -1) * random.choice((-1, 1))
            column = column * column[0]
            if column.tobytes() not in seen:
                seen.add(column.tobytes())
                columns.append(column.tolist())
    return np.array(columns, np.float32).T


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def losses(self, rows: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword (columns) for every row of features."""
        outputs = rows @ self.weights[:-1] + self.weights[-1]
        agreed = outputs[:, None, :] * self.codes[None, :, :]
        return (np.logaddexp(0.0, -agreed) * self.bit_weights).sum(axis=2)

    def predict(self, texts, ambiguous_below: float) -> pd.DataFrame:
        found = [features(text) for text in texts]
        at = [i for i, row in enumerate(found) if row is not None]
        language = np.full(len(found), UNDETERMINED, dtype=object)
        score, margin = np.zeros(len(found)), np.zeros(len(found))
        if at and self.languages:
            losses = self.losses(np.stack([found[i] for i in at]))
            likely = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
            likely /= likely.sum(axis=1, keepdims=True)
            best = losses.argmin(axis=1)
            ordered = np.sort(likely, axis=1)
            language[at] = np.array(self.languages, dtype=object)[best]
            score[at] = ordered[:, -1]
            margin[at] = ordered[:, -1] - (ordered[:, -2] if ordered.shape[1] > 1 else 0.0)
        return pd.DataFrame({"lang": language, "score": score, "margin": margin, "ambiguous": margin < ambiguous_below})


def _train(rows: np.ndarray, classes: np.ndarray, codes: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights of all bits by accelerated gradient steps, and the weight of each bit."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    targets = codes[classes]
    share = 1.0 / np.bincount(classes, minlength=len(codes))[classes]
    share = (share / share.sum()).astype(np.float32)[:, None]
    weights = np.zeros((rows.shape[1], codes.shape[1]), np.float32)
    ahead, rate = weights, np.float32(1.0 / (0.5 + l2))
    for step in range(steps):
        pull = -targets / (1.0 + np.exp(np.clip(targets * (rows @ ahead), -30, 30)))
        slope = rows.T @ (pull * share) + l2 * ahead
        new = ahead - rate * slope
        ahead = new + np.float32(step / (step + 3)) * (new - weights)
        weights = new
    right = (share * ((rows @ weights) * targets > 0)).sum(axis=0)
    quality = np.log(np.clip(right, 0.51, 0.995) / (1 - np.clip(right, 0.51, 0.995)))
    return weights, quality / quality.sum() * codes.shape[1] if codes.shape[1] else quality


@F.udf(T.ArrayType(T.BinaryType()), useArrow=True)
def _examples(text: str):
    """Features of the text and of two short stretches of it, so that short texts are learnt too."""
    middle = len(text) // 2
    found = [features(part) for part in (text, text[middle : middle + 80], text[middle // 2 : middle // 2 + 24])]
    return [row.astype(np.float16).tobytes() for row in found if row is not None]


def fit_languages(
    docs: DataFrame, training: Column, sample_rows: int = 1600, text: str = "text", lang: str = "lang",
    id: str = "doc_id", l2: float = 1e-5, steps: int = 150,
) -> LanguageModel:
    """A model from the rows where ``training`` holds and text and language are not null.

    Of these about ``sample_rows`` rows are learnt from, the same number of each language,
    chosen by hash of the id; that bounds what reaches the driver. Without such rows the model
    knows no language; with one language it always gives that.
    """
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    languages = sorted(counts)
    each = max(20, sample_rows // max(1, len(languages)))
    share = {name: min(1.0, each / counts[name]) for name in languages}
    chosen = shipped(rows).where(hashed_share(id, share, lang)).select(lang, _examples(F.col(text)).alias("rows"))
    found = chosen.limit(4 * each * max(1, len(languages))).toPandas()
    data = [(languages.index(name), np.frombuffer(row, np.float16)) for name, rows in zip(found[lang], found["rows"]) for row in rows]
    languages_seen = sorted({at for at, _ in data})
    codes = codewords(len(languages_seen))
    if not data:
        return LanguageModel([], codes, np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0))
    classes = np.array([languages_seen.index(at) for at, _ in data])
    weights, quality = _train(np.stack([row for _, row in data]).astype(np.float32), classes, codes, l2, steps)
    return LanguageModel([languages[at] for at in languages_seen], codes, weights, quality)


PREDICTION = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", output: str = "language", ambiguous_below: float = 0.02
) -> DataFrame:
    """Adds ``output``, a struct of lang, score (0 to 1), margin and ambiguous, for every row.

    Null texts and texts without a letter get ``und`` and score 0. Whole texts are read, in
    groups of rows; equal texts get equal results. A column named ``output`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict(texts[at : at + 512], ambiguous_below) for at in range(0, len(texts), 512)]
        return pd.concat(parts, ignore_index=True)

    return shipped(docs).withColumn(output, predict(F.col(text).cast("string")))
