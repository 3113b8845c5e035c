"""Toxicity by a small convolutional text classifier, trained in numpy over shards of all labelled rows.

A word is the sum of rows of three hashed embedding tables: one for the whole word and two for
its first letters, which families of compound words share. Filters of several widths slide over the words of a text, the largest
response of each filter anywhere in the text feeds one logistic unit. Thresholds are set for
each language, which is told from function words of the text itself; scores are bent so that
the threshold of a text's language is always at the same score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, stored
from tallygrid.llm.quality import one_label

WORD = re.compile(r"[^\W\d_]+")
HASH_BITS, SIZE, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
BUCKETS = 1 << HASH_BITS
STRETCH = 1 << 16
CUT = 0.3
PREFIXES = (6, 4)
TABLES = 1 + len(PREFIXES)
PAD = 1 << 62
#: Passes over all texts, texts to a step, texts that a row of a table has to be met in to be learnt, and steps to a unit of the logit.
EPOCHS, BATCH, LEAST_TEXTS, STEPS = 8, 8, 4, 1024
LEAST_SQUARE = np.float32(1e-4)
#: Numbers of a filter below this count as zero in its responses: a filter that no text uses fades out, and products with such numbers are slow.
NOTHING = np.float32(1e-30)
#: So many labels of 16 bytes may be broadcast to the texts; beyond, the join shuffles.
BROADCAST_LABELS = 500_000
#: Numbers to a row of a learner's state: a row of a table and the sum of squares of its slopes.
VALUES = SIZE + 1
_NAMES = [f"v{i}" for i in range(VALUES)]

# Function words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "was", "for", "that", "with", "this", "are", "it"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "dans", "que", "pour", "pas", "qui", "du"),
    "de": ("der", "die", "das", "und", "ist", "ein", "eine", "nicht", "mit", "den", "von", "zu", "auf"),
    "es": ("el", "los", "las", "y", "un", "una", "por", "con", "para", "del", "no", "se", "como"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_LANGUAGE_OF = {word: at + 1 for at, name in enumerate(FUNCTION_WORDS) for word in FUNCTION_WORDS[name]}


class _Words(dict):
    """Packed hashes and language of each word, emptied when full."""

    def __missing__(self, word: str) -> int:
        packed = _LANGUAGE_OF.get(word, 0)
        for part in (word, *(word[:size] for size in PREFIXES)):
            packed = packed << HASH_BITS | zlib.crc32(part.encode("utf-8", "replace")) % BUCKETS
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


_WORDS = _Words()


def word_codes(text: str | None) -> np.ndarray:
    """One whole number for each word of the whole text: its hashes, and the language of function words."""
    return np.array(list(map(_WORDS.__getitem__, WORD.findall((text or "").lower()))), np.int64)


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """The rows of words in each table."""
    return [codes >> at * HASH_BITS & BUCKETS - 1 for at in range(TABLES)]


def language_of(codes: np.ndarray) -> int:
    """The index in ``LANGUAGES`` of the language with most function words, the first of equals."""
    votes = np.bincount(codes >> TABLES * HASH_BITS, minlength=len(LANGUAGES))[1:]
    return int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1


def _filled(value: float, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A table with these rows at their places and one value everywhere else."""
    table = np.full((BUCKETS, rows.shape[1]), value, np.float32)
    table[at] = rows
    return table


@dataclass
class ToxicityModel:
    """Tables, filters and the output unit; thresholds by language on the logit."""

    tables: list[np.ndarray]
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    thresholds: np.ndarray
    constant: float | None = None

    def __getstate__(self) -> dict:
        """Only rows that were learnt are sent to workers; all others are zero."""
        rows = [np.flatnonzero(table.any(axis=1)) for table in self.tables]
        return {**self.__dict__, "tables": [(at, table[at]) for at, table in zip(rows, self.tables)]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.tables = [_filled(0.0, *table) for table in state["tables"]]

    def embed(self, codes: np.ndarray) -> np.ndarray:
        first, *others = zip(self.tables, buckets(codes))
        rows = first[0].take(first[1], axis=0)
        for table, at in others:
            rows += table.take(at, axis=0)
        rows[codes >= PAD] = 0.0
        return rows

    def responses(self, codes: np.ndarray, starts: np.ndarray, stops: Sequence[int] = ()) -> dict[int, np.ndarray]:
        """The responses of the filters of each width at every word; texts begin at ``starts``, pads between.

        No response reaches into the next text. A text that goes on elsewhere has its last word before one of ``stops``: none
        reaches over that either.
        """
        rows, responses = self.embed(codes), {}
        for width in WIDTHS:
            filters = np.where(np.abs(self.filters[width]) < NOTHING, np.float32(0), self.filters[width])
            response = rows[: len(rows) - width + 1] @ filters[:SIZE]
            for step in range(1, width):
                response = response + rows[step : len(rows) - width + 1 + step] @ filters[step * SIZE : (step + 1) * SIZE]
            responses[width] = response + self.biases[width]
            for step in range(1, width):
                responses[width][[*(starts[1:] - step), *(stop - step for stop in stops if stop >= step)]] = -np.inf
        return responses

    def pooled(self, codes: np.ndarray, starts: np.ndarray, stops: Sequence[int] = ()) -> np.ndarray:
        """The largest response of every filter in each text, 0 at least."""
        responses = self.responses(codes, starts, stops)
        return np.maximum(np.hstack([np.maximum.reduceat(responses[width], starts, axis=0) for width in WIDTHS]), 0.0)

    def stretches(self, texts: Sequence[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, list[int]]]:
        """Texts in bounded amounts, long ones cut in stretches: of each piece the text and where it begins, then joined codes, starts and stops."""
        pieces, owner, goes_on, words = [], [], [], 0

        def together() -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, list[int]]:
            codes, starts = joined(pieces)
            ends = starts + [len(piece) for piece in pieces]
            return owner, codes, starts, ends[goes_on].tolist()

        for at, codes in enumerate(texts):
            for start in range(0, max(1, len(codes)), STRETCH):
                begin = max(0, start - max(WIDTHS) + 1)
                piece = codes[begin : start + STRETCH]
                if pieces and words + len(piece) > 2 * STRETCH:
                    yield together()
                    pieces, owner, goes_on, words = [], [], [], 0
                pieces.append(piece)
                owner.append((at, begin))
                goes_on.append(begin + len(piece) < len(codes))
                words += len(piece)
        if pieces:
            yield together()

    def logits(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Logits of whole texts. A long one is run over in stretches, whose best responses are joined."""
        best = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        for owner, codes, starts, stops in self.stretches(texts):
            np.maximum.at(best, [text for text, _ in owner], self.pooled(codes, starts, stops))
        return best @ self.out[:-1] + self.out[-1]

    def peaks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The largest response of every filter in each whole text, and where in it (text, filter) it begins."""
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        places = {width: np.zeros((len(texts), FILTERS), np.int64) for width in WIDTHS}
        units = np.arange(FILTERS)
        for owner, codes, starts, stops in self.stretches(texts):
            responses, ends = self.responses(codes, starts, stops), np.append(starts[1:], len(codes))
            for at, width in enumerate(WIDTHS):
                for (text, moved), begin, end in zip(owner, starts, ends):
                    own = responses[width][begin:end]
                    found = own.argmax(axis=0)
                    held = best[text, at * FILTERS : (at + 1) * FILTERS]
                    more = own[found, units] > held
                    held[more] = own[found, units][more]
                    places[width][text, more] = found[more] + moved
        return best, places

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        own = self.thresholds[[language_of(codes) for codes in texts]]
        moved = np.clip(self.logits(texts).astype(float) - own, -500, 500)
        return 1.0 / (1.0 + np.exp(-(moved + np.log(CUT / (1 - CUT)))))


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with pads behind each, so that no filter sees two texts."""
    pads = np.full(max(WIDTHS), PAD, np.int64)
    starts = np.cumsum([0, *(len(codes) + len(pads) for codes in texts[:-1])])
    return np.concatenate([part for codes in texts for part in (codes, pads)]), starts


@dataclass
class _Learner:
    """A model in training: Adam for filters and output, Adagrad for the rows of the tables.

    Against learning texts by heart, a share ``left_out`` of the words is hidden at every pass. Its whole state can be
    taken as rows (key, VALUES numbers) and set from rows, so that learners of several shards are averaged row by row.
    """

    model: ToxicityModel
    weight: np.ndarray
    squares: list[np.ndarray]
    first: dict
    second: dict
    touched: list[np.ndarray]
    step: int = 0
    left_out: float = 0.3
    pull_rate: float = 0.05

    def __getstate__(self) -> dict:
        rows = [np.flatnonzero(square[:, 0] != LEAST_SQUARE) for square in self.squares]
        return {**self.__dict__, "squares": [(at, square[at]) for at, square in zip(rows, self.squares)], "touched": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.squares = [_filled(LEAST_SQUARE, *square) for square in state["squares"]]
        self.touched = [np.zeros(BUCKETS, bool) for _ in range(TABLES)]

    @classmethod
    def start(cls, known: list[np.ndarray], counts: np.ndarray, seed: int = 11, init: float = 0.01) -> _Learner:
        """``known`` has the rows of each table that may be learnt, ``counts`` the texts of both classes."""
        random = np.random.default_rng(seed)
        tables = [random.normal(0, init, (BUCKETS, SIZE)).astype(np.float32) * rows[:, None] for rows in known]
        filters = {w: random.normal(0, 0.4, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        out = np.append(random.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0).astype(np.float32)
        model = ToxicityModel(tables, filters, biases, out, np.zeros(len(LANGUAGES)))
        squares = [np.full((BUCKETS, 1), LEAST_SQUARE, np.float32) for _ in range(TABLES)]
        learner = cls(model, 0.5 / (counts / counts.sum()), squares, {}, {}, [np.zeros(BUCKETS, bool) for _ in range(TABLES)])
        learner.first = {k: np.zeros_like(v) for k, v in learner.parts().items()}
        learner.second = {k: np.zeros_like(v) for k, v in learner.parts().items()}
        return learner

    def parts(self) -> dict[str, np.ndarray]:
        model = self.model
        return {"out": model.out, **{f"f{w}": model.filters[w] for w in WIDTHS}, **{f"b{w}": model.biases[w] for w in WIDTHS}}

    def learn(self, texts: Sequence[np.ndarray], labels: np.ndarray, random: np.random.Generator, batch: int = BATCH) -> None:
        """One pass over the texts in random order."""
        order = random.permutation(len(texts))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            whole = [texts[i] for i in chosen]
            self._descend([np.where(random.random(len(codes)) < self.left_out, PAD, codes) for codes in whole], labels[chosen])

    def _descend(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        model, out = self.model, self.model.out
        best, places = model.peaks(texts)
        hidden = np.maximum(best, 0.0)
        logit = hidden @ out[:-1] + out[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * self.weight[labels] / len(labels)
        error = error.astype(np.float32)
        slopes = {"out": np.append(hidden.T @ error, error.sum()) + 1e-4 * out}
        back = error[:, None] * out[:-1] * (hidden > 0)
        starts = np.cumsum([0, *(len(codes) + max(WIDTHS) for codes in texts[:-1])])
        codes = joined(texts)[0]
        words, pulls = [], []
        for at, width in enumerate(WIDTHS):
            own, filters = back[:, at * FILTERS : (at + 1) * FILTERS], model.filters[width]
            windows = (starts[:, None] + places[width])[:, :, None] + np.arange(width)
            rows = model.embed(codes[windows].ravel()).reshape(*windows.shape, SIZE)
            slope = np.einsum("tu,tuws->wsu", own, rows).reshape(width * SIZE, FILTERS)
            slopes[f"f{width}"], slopes[f"b{width}"] = slope + 1e-4 * filters, own.sum(axis=0)
            pull = own[:, :, None, None] * filters.reshape(width, SIZE, FILTERS).transpose(2, 0, 1)
            used = (codes[windows] < PAD) & (own != 0)[:, :, None]
            words.append(windows[used])
            pulls.append(pull[used])
        self.step += 1
        for name, part in self.parts().items():
            self.first[name] += 0.1 * (slopes[name] - self.first[name])
            self.second[name] += 0.01 * (slopes[name] ** 2 - self.second[name])
            rate = 0.01 * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            part -= (rate * self.first[name] / (np.sqrt(self.second[name]) + 1e-7)).astype(np.float32)
        # Of each word at its place.
        words, of = np.unique(np.concatenate(words), return_inverse=True)
        pulled = np.zeros((len(words), SIZE), np.float32)
        np.add.at(pulled, of, np.concatenate(pulls))
        for at, rows in enumerate(buckets(codes[words])):
            table, square = model.tables[at], self.squares[at]
            known = table[rows].any(axis=1)
            rows, pull = rows[known], pulled[known]
            np.add.at(square, rows, (pull**2).mean(axis=1, keepdims=True))
            np.subtract.at(table, rows, self.pull_rate * pull / np.sqrt(square[rows]))
            self.touched[at][rows] = True

    def state(self) -> pd.DataFrame:
        """Rows of the tables that were changed, and all other numbers with their moments."""
        keys, values = [], []
        for at in range(TABLES):
            rows = np.flatnonzero(self.touched[at])
            keys.append(at * BUCKETS + rows)
            values.append(np.hstack([self.model.tables[at][rows], self.squares[at][rows]]))
        parts = self.parts()
        flat = [np.concatenate([of[name].ravel() for name in parts]) for of in (parts, self.first, self.second)]
        keys.append(TABLES * BUCKETS + np.arange(len(flat[0])))
        values.append(np.pad(np.stack(flat, axis=1), ((0, 0), (0, VALUES - 3))))
        return pd.DataFrame({"key": np.concatenate(keys), **dict(zip(_NAMES, np.vstack(values).T.astype(float)))})

    def set(self, state: pd.DataFrame) -> None:
        keys, values = state["key"].to_numpy(np.int64), state[_NAMES].to_numpy(np.float32)
        for at in range(TABLES):
            own = keys // BUCKETS == at
            self.model.tables[at][keys[own] % BUCKETS] = values[own, :SIZE]
            self.squares[at][keys[own] % BUCKETS] = values[own, SIZE:]
        own = np.flatnonzero(keys // BUCKETS == TABLES)
        flat, begin = values[own[np.argsort(keys[own])]], 0
        for name, part in self.parts().items():
            for column, of in enumerate((part, self.first[name], self.second[name])):
                of[...] = flat[begin : begin + part.size, column].reshape(part.shape)
            begin += part.size


def _constant(label: float) -> ToxicityModel:
    model = ToxicityModel([], {}, {}, np.zeros(0), np.zeros(len(LANGUAGES)))
    model.constant = label
    return model


def rows_met(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the tables as keys, and in how many of the texts each is met."""
    met = np.zeros(TABLES * BUCKETS, np.int64)
    for codes in texts:
        for at, rows in enumerate(buckets(codes)):
            met[at * BUCKETS + np.unique(rows)] += 1
    keys = np.flatnonzero(met)
    return keys, met[keys]


def _known(keys: np.ndarray) -> list[np.ndarray]:
    known = np.zeros(TABLES * BUCKETS, bool)
    known[keys] = True
    return list(known.reshape(TABLES, BUCKETS))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ToxicityModel:
    """A model of texts that are at hand, the same as ``fit_toxicity`` with one shard."""
    counts = np.bincount(labels, minlength=2)
    if not counts.all():
        return _constant(float(labels[0]) if len(labels) else 0.0)
    keys, met = rows_met(texts)
    learner = _Learner.start(_known(keys[met >= LEAST_TEXTS]), counts, seed)
    for epoch in range(epochs):
        learner.learn(texts, labels, np.random.default_rng((seed, epoch, 0)))
    _calibrate(learner.model, _logit_counts(learner.model, texts, labels))
    return learner.model


def _logit_counts(model: ToxicityModel, texts: Sequence[np.ndarray], labels: np.ndarray) -> pd.DataFrame:
    """How many texts (n) have each language, label and logit, in steps of 1 / ``STEPS``."""
    steps = np.round(np.clip(model.logits(texts).astype(float), -500, 500) * STEPS).astype(np.int64)
    rows = pd.DataFrame({"language": [language_of(codes) for codes in texts], "label": labels.astype(np.int64), "step": steps})
    return rows.groupby(["language", "label", "step"]).size().rename("n").reset_index().astype(np.int64)


def _calibrate(model: ToxicityModel, found: pd.DataFrame, least: int = 10) -> None:
    """A threshold for each language with ``least`` texts of both classes, that of all texts for the rest.

    ``found`` counts all texts by language, label and step of the logit.
    """

    def best(chosen: pd.DataFrame) -> float:
        """The middle of the widest best gap: most right answers, classes weighing the same."""
        tally = chosen.pivot_table(index="step", columns="label", values="n", aggfunc="sum", fill_value=0).sort_index()
        value, clean, toxic = tally.index.to_numpy(float) / STEPS, tally[0].to_numpy(), tally[1].to_numpy()
        below = np.append(0, np.cumsum(clean)) / clean.sum()
        above = 1 - np.append(0, np.cumsum(toxic)) / toxic.sum()
        right = below + above
        edges = np.concatenate(([value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]))
        widths = np.concatenate(([0], np.diff(value), [0]))
        top = np.flatnonzero(right >= right.max() - 1e-9)
        return float(edges[top[widths[top].argmax()]])

    everything = best(found)
    for at in range(len(LANGUAGES)):
        chosen = found[found["language"] == at]
        enough = min(chosen.loc[chosen["label"] == c, "n"].sum() for c in (0, 1)) >= least
        model.thresholds[at] = best(chosen) if enough else everything


@F.udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("codes", T.BinaryType())]), useArrow=True)
def _coded(text: str):
    """The number of words and their codes, packed."""
    codes = word_codes(text)
    return len(codes), zlib.compress(codes.tobytes(), 1)


class _Packed(Sequence):
    """The codes of texts as places in a list of all their words; texts stay packed, each is unpacked when it is asked for."""

    def __init__(self, words: bytes, packed: bytes, sizes: bytes) -> None:
        self.words, self.packed = np.frombuffer(words, np.int64), memoryview(packed)
        self.ends = np.cumsum([0, *np.frombuffer(sizes, np.int64)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, at: int) -> np.ndarray:
        if not 0 <= at < len(self):
            raise IndexError(at)
        return self.words[np.frombuffer(zlib.decompress(self.packed[self.ends[at] : self.ends[at + 1]]), np.uint32)]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", text: str = "text", id: str = "doc_id",
    shard_rows: int = 16_384, shard_words: int = 1 << 23, epochs: int = EPOCHS, seed: int = 11,
) -> ToxicityModel:
    """A model from all labelled rows where ``training`` holds, whole texts.

    Rows are dealt to shards by hash, as many as ``shard_rows`` and ``shard_words`` ask for, each written as one row of packed
    texts, which stay packed in the workers but for those of a step. In every pass
    each shard learns from the model of the pass before, then the numbers that shards changed are averaged. Words are
    counted and thresholds set over all rows. Only numbers of the model reach the driver, however many rows there are.
    """
    # Written out first: where labels are few, texts need no shuffle to meet them.
    known = stored(one_label(labels.select(id, label), label, id).where(F.col(label).isin(0, 1)), "known")
    few = known.count() <= BROADCAST_LABELS
    rows = shipped(docs).where(training).select(id, text).join(F.broadcast(known) if few else known, id)
    coded = rows.select(F.col(label).cast("long").alias("label"), F.xxhash64(id, text).alias("deal"), _coded(F.col(text).cast("string")).alias("coded"))
    coded = stored(coded.select("label", "deal", "coded.*"), "coded")
    totals = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()
    counts = np.zeros(2, np.int64)
    for row in totals:
        counts[row["label"]] = row["n"]
    if not counts.all():
        return _constant(float(counts[1] > 0))
    shards = max(-(-int(counts.sum()) // shard_rows), -(-int(sum(row["words"] for row in totals)) // shard_words))
    dealt = coded.groupBy(F.pmod("deal", F.lit(shards)).alias("shard")).applyInArrow(_shard, _SHARD)
    # A file for each shard, so that a task may have any number of them.
    dealt = stored(dealt, "shards", maxRecordsPerFile=1)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts, _ in _shards(batches):
            keys, n = rows_met(texts)
            yield pd.DataFrame({"key": keys, "n": n})

    often = dealt.mapInPandas(met, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    learner = _Learner.start(_known(often.select("key").toPandas()["key"].to_numpy(np.int64)), counts, seed)
    context = docs.sparkSession.sparkContext
    means = [F.avg(name).alias(name) for name in _NAMES]
    for epoch in range(epochs):
        shared = context.broadcast(pickle.dumps(learner))

        def learn(batches: Iterator[pd.DataFrame], epoch: int = epoch, shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            for shard, texts, classes in _shards(batches):
                own = pickle.loads(shared.value)
                own.learn(texts, classes, np.random.default_rng((seed, epoch, shard)))
                yield own.state()

        numbers = ", ".join(f"{name} double" for name in _NAMES)
        learner.set(dealt.mapInPandas(learn, f"key long, {numbers}").groupBy("key").agg(*means).toPandas())
        learner.step += -(-int(counts.sum()) // (BATCH * shards))
        shared.destroy()
    shared = context.broadcast(learner.model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts, classes in _shards(batches):
            yield _logit_counts(shared.value, texts, classes)

    found = dealt.mapInPandas(count, "language long, label long, step long, n long")
    _calibrate(learner.model, found.groupBy("language", "label", "step").agg(F.sum("n").alias("n")).toPandas())
    return learner.model


_SHARD = "shard long, words binary, sizes binary, labels binary, codes binary"


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    """The texts of a shard as one row, in an order of their own."""
    labels = rows["label"].to_numpy()
    order = np.lexsort((labels, rows["deal"].to_numpy()))

    def texts() -> Iterator[np.ndarray]:
        return (np.frombuffer(zlib.decompress(rows["codes"][at].as_buffer()), np.int64) for at in order)

    words = np.zeros(0, np.int64)
    for some in batched(texts(), 512):
        words = np.union1d(words, np.concatenate(some))
    packed = [zlib.compress(np.searchsorted(words, codes).astype(np.uint32).tobytes(), 1) for codes in texts()]
    sizes = np.array([len(codes) for codes in packed], np.int64)
    parts = {"words": words.tobytes(), "sizes": sizes.tobytes(), "labels": labels[order].tobytes(), "codes": b"".join(packed)}
    shard = {"shard": pa.array([key[0].as_py()], pa.int64())}
    return pa.table(shard | {name: pa.array([part], pa.binary()) for name, part in parts.items()})


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Sequence[np.ndarray], np.ndarray]]:
    """Number, texts and labels of each shard."""
    for batch in batches:
        for row in batch.itertuples():
            yield row.shard, _Packed(row.words, row.codes, row.sizes), np.frombuffer(row.labels, np.int64)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "score") -> DataFrame:
    """Adds ``output`` between 0 and 1 for every row; texts without words get one and the same low score.

    The threshold of a text's language lies at 0.3. A column named ``output`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        parts = []
        for at in range(0, len(texts), 256):
            parts.append(shared.value.scores([word_codes(text) for text in texts[at : at + 256]]))
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return shipped(docs).withColumn(output, score(F.col(text).cast("string")))


def toxicity_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from labels of the others."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = fit_toxicity(docs, labels, training=~F.col("held_out"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
