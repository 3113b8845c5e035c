"""Byte-pair encoding by backtracking, and decoding by an offset table.

A piece of text is covered by the longest tokens first. Two neighbouring tokens are kept only
if merging their text by rank would give exactly these two (the pair-compatibility test over
the split of each token); otherwise the last token gives way to its longest shorter prefix
that is a token, and positions proved to be dead ends are never entered again. The result is
that of merging by rank, in time linear in the piece. An Aho-Corasick automaton over all
tokens finds the longest token at every position in one pass.

Tokenizers of the kind supported here: NFC, lower case, white space dropped, pieces by a fixed
pattern, byte-level symbols and a word-end mark on the last symbol of a piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, text_of

END = "</w>"
#: Texts decoded at once.
TEXTS = 256
# Suffixes that are pieces of their own, and the white space of the vocabulary's pattern.
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# Letters, numbers and small forms that the library knows beyond Unicode 15.1, as first and last code point,
# and for small forms the distance to them.
NEWER_LETTERS = (
    (0x1C8A, 0x1C8A), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D4F), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
NEWER_SMALL = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
SMALL_FORMS = {code: code + step for first, last, step in NEWER_SMALL for code in range(first, last + 1)}
CAPITALS = re.compile("[" + "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last, _ in NEWER_SMALL) + "]")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def piece_pattern() -> re.Pattern:
    """A suffix, a run of letters, one number sign, or a run of other signs but white space.

    Letters and numbers are those of Python's Unicode tables and the newer ones, as ranges.
    """
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    newer = {code: kind for kind, given in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)) for a, b in given for code in range(a, b + 1)}
    for code in range(0x110000):
        found = ranges.get(newer.get(code) or unicodedata.category(chr(code))[0])
        if found is not None:
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    letters, numbers = (
        "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[kind]) for kind in ("L", "N")
    )
    return re.compile(f"{'|'.join(SUFFIXES)}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


# Python splits at these, the pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for extra, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + extra)
    return [names[b] for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizer file: ids of tokens, merges in order, added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model.get("end_of_word_suffix") != END or spec.get("decoder"):
        raise ValueError(f"{path} is not a word-end byte-pair vocabulary without decoder")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    added = {token["content"]: token["id"] for token in spec["added_tokens"]}
    return {"ids": model["vocab"], "merges": merges, "added": added}


class Encoder:
    """Tables of one vocabulary. Inside, a symbol is one character: its byte, plus 256 at a word's end."""

    def __init__(self, vocabulary: dict, remembered: int = 400_000):
        ids = vocabulary["ids"]
        inner = {}
        for byte, symbol in enumerate(byte_symbols()):
            inner[symbol], inner[symbol + END] = chr(byte), chr(byte + 256)
        names = list(inner)
        rank = {name: at for at, name in enumerate(names)}
        self.split = [(at, at) for at in range(len(names))]
        self.merged = {}
        for left, right in vocabulary["merges"]:
            name = left + right
            if name in rank:
                raise ValueError(f"two merges give {name!r}")
            self.merged[rank[left], rank[right]] = rank[name] = len(names)
            self.split.append((rank[left], rank[right]))
            inner[name] = inner[left] + inner[right]
            names.append(name)
        self.ids = np.array([ids[name] for name in names], np.int32)
        self.length = [len(inner[name]) for name in names]
        by_text = {inner[name]: at for name, at in rank.items()}
        self.shorter = [
            next((by_text[t[:end]] for end in range(len(t) - 1, 0, -1) if t[:end] in by_text), -1)
            for t in (inner[name] for name in names)
        ]
        self.automaton = ahocorasick.Automaton()
        for text, at in by_text.items():
            self.automaton.add_word(text, at)
        self.automaton.make_automaton()
        self.pieces = piece_pattern()
        self.added = vocabulary["added"]
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        names = {**{i: n for n, i in ids.items()}, **{i: n for n, i in self.added.items()}}
        spelled = [(names[at] + " ").encode() if at in names else b"" for at in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(piece) for piece in spelled])))
        self.known = _Remembered(self.encode_piece, remembered // 4)
        self.chunks = _Remembered(self._chunk, remembered)
        self.compatible = _Remembered(self._compatible, remembered)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens stay apart when their joint text is merged by rank."""
        left, right = pair
        limit = len(self.split)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.split[left][1]
                if left == limit:
                    limit, right = right + 1, self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.split[right][0]
                if right + 1 == limit:
                    limit, left = left, self.split[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece, as 32-bit numbers."""
        data = piece.encode("utf-8")
        symbols = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        longest = [-1] * (len(symbols) + 1)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, token in self.automaton.iter(symbols):
            longest[end + 1 - length[token]] = token
        alive = bytearray(b"\x01") * (len(symbols) + 1)
        out, at, token = [], 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or compatible[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return self.ids[out].tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of normalised text."""
        pieces = self.pieces.findall(chunk)
        # A stretch of one piece is remembered as such, not twice.
        return self.encode_piece(chunk) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def _section(self, text: str) -> bytes:
        """Ids of a text without added tokens. White space parts pieces, so words are looked up whole."""
        if not text.isascii():
            # Lower case is taken character by character: a capital sigma has one small form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if CAPITALS.search(text):
                text = text.translate(SMALL_FORMS)
        text = text.lower()
        words = [text] if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, words))

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers one after the other."""
        found, done = [], 0
        for match in self.added_pattern.finditer(text):
            found += self._section(text[done : match.start()]), np.int32(self.added[match[0]]).tobytes()
            done = match.end()
        return b"".join([*found, self._section(text[done:])]) if found else self._section(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces."""
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts whose ids lie between two neighbours of ``ends``: slices of one buffer between two offsets each."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        ids = np.where(known, ids, 0)
        starts = self.offsets[ids]
        lengths = np.where(known, self.offsets[ids + 1] - starts, 0)
        last = np.concatenate(([0], np.cumsum(lengths)))[ends]
        # The space after the last token of a text stays out: it is found from the back.
        filled = np.flatnonzero(lengths)
        at = np.searchsorted(filled, ends[1:]) - 1
        some = last[1:] > last[:-1]
        lengths[filled[at[some]]] -= 1
        places = np.concatenate(([0], np.cumsum(lengths)))
        chosen = np.arange(places[-1]) + np.repeat(starts - places[:-1], lengths)
        return pa.StringArray.from_buffers(
            len(ends) - 1, pa.py_buffer(places[ends].astype(np.int32)), pa.py_buffer(self.buffer[chosen])
        )


class _Remembered(dict):
    """Results by argument, in two generations: the newer half is the dictionary itself.

    When that is full it becomes the older half, whose entries come back as they are asked for; what was not asked
    for meanwhile is forgotten. So a worker's memory stays bounded and frequent entries stay.
    """

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most, self.older = work, max(1, most // 2), {}

    def __missing__(self, key):
        result = self.older.get(key)
        if result is None:
            result = self.work(key)
        if not isinstance(key, str) or len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = result
        return result


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, vocabulary) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary.value)
    return _ENCODERS[path]


def _id_lists(encoder: Encoder, texts: pa.Array) -> pa.Array:
    found = [encoder.encode_bytes(value) for value in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _spelled(encoder: Encoder, lists: pa.Array) -> pa.Array:
    """The text of each list of ids; null for a null."""
    found = []
    for at in range(0, len(lists), TEXTS):
        part = lists.slice(at, TEXTS)
        ends = np.concatenate(([0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = encoder.decode_many(ids, ends)
        found.append(pc.if_else(part.is_null(), pa.scalar(None, pa.string()), texts) if part.null_count else texts)
    return pa.concat_arrays(found) if found else pa.array([], pa.string())


def encode_texts(docs: DataFrame, path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Adds ``output``, the token ids of each whole text; a null or empty text has none.

    The vocabulary file at ``path`` is read once and sent to the workers (a few MB whatever the
    table's size). Rows stay as they are; a column already named ``output`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return _id_lists(_encoder(path, shared), texts)

    return shipped(docs).withColumn(output, encode(text_of(text)))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds ``output``, the decoded text of an array of ids; null ids give a null, unknown ids nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        return _spelled(_encoder(path, shared), lists)

    return shipped(rows).withColumn(output, decode(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", output: str = "coded") -> DataFrame:
    """Adds ``output``, a struct of the ids of each text and the text decoded from them, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf("ids array<int>, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, shared)
        lists = _id_lists(encoder, texts)
        return pa.StructArray.from_arrays([lists, _spelled(encoder, lists)], names=["ids", "decoded"])

    return shipped(docs).withColumn(output, both(text_of(text)))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids and of the text decoded from them."""
    coded = round_trip(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("coded.decoded"), 256).alias("decoded_sha256"),
    )
