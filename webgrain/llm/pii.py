"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

A kind has a pattern, a validator (Luhn for cards, mod 97 for IBANs, part and
digit bounds for the others), a score for a confirmed span, and words that raise
the score when they stand near. The first four kinds are the base: whatever they
confirm is reported. Spans of the further kinds are reported if their score
reaches the threshold and no span of an earlier kind overlaps them.

Every pattern is matched in linear time on any text, so one very long line costs
what its length costs. Texts are matched whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webgrain.llm._text import slices

#: A context word within so many code points before or after a span counts.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24
#: What a context word adds, and what a word that speaks against the kind takes away.
CONTEXT_GAIN = 0.3
#: Least score of a span of a further kind.
THRESHOLD = 0.6
#: Words that speak against personal data near a number.
AGAINST = "version|release|isbn|issn|sku|serial|invoice|build"


class Kind(NamedTuple):
    name: str
    score: float
    context: str
    base: bool


# Kinds in the order of the report, their scores and context words.
KINDS = [
    Kind("email", 0.9, "e-?mail|mail|contact|correo|courriel", True),
    Kind("ip", 0.6, "ip|host|server|address|adresse", True),
    Kind("card", 0.8, "card|visa|mastercard|credit|carte|karte|tarjeta", True),
    Kind("phone", 0.7, "phone|tel|call|mobile|fax|telefon|handy", True),
    Kind("iban", 0.8, "iban|account|bank|konto|compte|cuenta", False),
    Kind("national_id", 0.4, "ssn|social security|national id|tax id|passport", False),
    Kind("local_phone", 0.4, "phone|tel|call|mobile|fax|telefon|handy", False),
]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: from any other it ends at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII)
_NATIONAL = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
_LOCAL_PHONE = re.compile(r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether an IBAN of 15 to 34 characters (spaces left out) has the rest 1, letters counted from A = 10."""
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for found in _DOMAIN.finditer(text) if "@" in text else ():
        at = start = found.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = found.end()
            yield start, end


def _matches(pattern: re.Pattern, needs: str, holds: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    def spans(text: str) -> Iterator[tuple[int, int]]:
        for found in pattern.finditer(text) if needs in text else ():
            if holds(found[0]):
                yield found.span()

    return spans


def _is_ip(span: str) -> bool:
    parts = [p.lstrip("0") for p in span.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(span: str) -> bool:
    digits = _NOT_DIGIT.sub("", span)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_national(span: str) -> bool:
    return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"


SPANS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails,
    "ip": _matches(_IP, ".", _is_ip),
    "card": _matches(_CARD, "", _is_card),
    "phone": _matches(_PHONE, "+", lambda s: 8 <= len(_NOT_DIGIT.sub("", s)) <= 15),
    "iban": _matches(_IBAN, "", mod_97),
    "national_id": _matches(_NATIONAL, "-", _is_national),
    "local_phone": _matches(_LOCAL_PHONE, "", lambda s: s[0] > "1"),
}

_NEAR = {k.name: re.compile(rf"\b(?:{k.context})\b", re.ASCII | re.IGNORECASE) for k in KINDS}
_AGAINST = re.compile(rf"\b(?:{AGAINST})\b", re.ASCII | re.IGNORECASE)


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's score, raised by a context word near the span, lowered by a word against it; from 0 to 1."""
    near = text[max(0, start - CONTEXT_BEFORE) : start] + "\n" + text[end : end + CONTEXT_AFTER]
    moved = kind.score + CONTEXT_GAIN * (bool(_NEAR[kind.name].search(near)) - bool(_AGAINST.search(near)))
    return round(min(1.0, max(0.0, moved)), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text, by kind as listed, then by start."""
    out: list[tuple[str, int, int, float, bool]] = []
    for kind in KINDS:
        earlier = sorted((s, e) for _, s, e, _, _ in out)
        at = 0
        for start, end in SPANS[kind.name](text):
            value = score(kind, text, start, end)
            if not kind.base:
                while at < len(earlier) and earlier[at][1] <= start:
                    at += 1
                if value < threshold or (at < len(earlier) and earlier[at][0] < end):
                    continue
            out.append((kind.name, start, end, value, kind.base))
    return out


def masked(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one's."""
    parts, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*parts, text[at:]])


SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("base", T.BooleanType()),
]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
_NAMES = ("kind", "start", "end", "score", "base")


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii", masked_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with spans_col: array of (kind, start, end, score, base), and masked_col: the text without them.

    Positions are code points, end exclusive. Every row stays, repeated ones too;
    a null text has no spans (an empty array) and its masked text is null; columns
    of docs named as the new ones are replaced, all others pass through.
    """
    new = [spans_col] + ([masked_col] if masked_col else [])
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField(spans_col, SPAN_TYPE), *([T.StructField(masked_col, T.StringType())] if masked_col else [])])
    helper = "_pii_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, helper):
            texts = batch.column(helper).to_pylist()
            found = [spans_of(t, threshold) if t else [] for t in texts]
            columns = [batch.column(f.name) for f in kept]
            columns.append(pa.array([[dict(zip(_NAMES, s, strict=True)) for s in spans] for spans in found], type=_SPAN_ARROW))
            if masked_col:
                columns.append(pa.array([None if t is None else masked(t, s) for t, s in zip(texts, found, strict=True)], type=pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(*(f.name for f in kept), docs[text_col].alias(helper)).mapInArrow(run, schema)
