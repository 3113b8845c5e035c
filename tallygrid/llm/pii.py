"""Personal data: patterns propose spans, checksums confirm them, near words weigh them.

Four base kinds have a fixed definition (``email``, ``ip``, ``card``, ``phone``); two more are
found by checksum or by context (``iban``, ``ssn``). Every kind is searched in linear time:
e-mail addresses outward from each ``@``, digit runs as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
FIELDS = {"kind": T.StringType(), "start": T.IntegerType(), "end": T.IntegerType(), "text": T.StringType(), "score": T.DoubleType()}
SPANS = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in FIELDS.items()]))

# The patterns of the base kinds, possessive where backtracking cannot help.
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words that raise or lower the score of a span they stand near.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "llame"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "order", "invoice", "example", "test")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.3}
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found outward from each ``@``.

    A local part cannot hold ``@``, and whether the domain fits does not depend on where the
    local part begins, so the leftmost match at an ``@`` takes the whole run before it.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _ip_fits(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of the ends on a border of words, the last one at which the checksum is right.

    Capital words or numbers may follow, so a run as long as an account number can be is cut back word by word.
    """
    match = IBAN.search(text)
    while match:
        start, end = match.span()
        ends = [at for at in range(end, start, -1) if not text[at : at + 1].isalnum() and text[at - 1] != " "]
        compact = {at: text[start:at].replace(" ", "") for at in ends}
        right = next((at for at in ends if len(compact[at]) >= 15 and mod97(compact[at])), None)
        if right is not None:
            yield start, right
        match = IBAN.search(text, start + 1 if right is None else right)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    for match in IP.finditer(text):
        if _ip_fits(match[0]):
            yield "ip", *match.span()
    for match in CARD.finditer(text):
        digits = digits_of(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *match.span()
    for match in PHONE.finditer(text):
        if 10 <= len(digits_of(match[0])) <= 15:
            yield "phone", *match.span()
    yield from (("iban", *span) for span in ibans(text))
    for match in SSN.finditer(text):
        yield "ssn", *match.span()


def _score(kind: str, text: str, start: int, end: int, reach: int) -> float:
    near = {word.lower() for word in WORD.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    score = PRIOR[kind]
    if near.intersection(CONTEXT[kind]):
        score += (1.0 - score) * 0.6
    if near.intersection(AGAINST):
        score *= 0.6
    return round(score, 4)


def find_spans(text: str, reach: int = 40, extra_from: float = 0.5) -> list[tuple]:
    """All spans of a text as (kind, start, end, text, score), by start and then kind.

    Offsets are code points, the end exclusive. Base spans always stay; a span of another kind
    stays if its score, after context words within ``reach`` characters, is ``extra_from`` or
    more.
    """
    found = []
    for kind, start, end in _proposals(text):
        score = _score(kind, text, start, end, reach)
        if kind in BASE_KINDS or score >= extra_from:
            found.append((kind, start, end, text[start:end], score))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def mask_spans(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mask."""
    out, done = [], 0
    for kind, start, end in sorted(((s[0], s[1], s[2]) for s in spans), key=lambda s: s[1]):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


@F.udf(SPANS, useArrow=True)
def _spans(text: str):
    return [dict(zip(FIELDS, span)) for span in find_spans(text)]


@F.udf(T.StringType(), useArrow=True)
def _masked(text: str):
    return mask_spans(text, find_spans(text))


def find_pii(docs: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Adds ``output``: the spans of each text, an empty array for a null or empty text.

    Every row stays, repeated rows too; a column already named ``output`` is replaced. Texts are
    searched whole, each in its own task's batch; nothing is shuffled.
    """
    return shipped(docs).withColumn(output, _spans(text_of(text)))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of ``text`` by ``<KIND>``; a null text stays null."""
    return shipped(docs).withColumn(text, F.when(F.col(text).isNotNull(), _masked(text_of(text))))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, the digest of the base spans, and all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        F.transform(spans, lambda s: s["score"]).alias("scores"),
    )
