"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed
character n-grams (1 to 3) weighs the languages whose bit is 1 against those
whose bit is 0. A text gives one margin for each bit; decoding sums a logistic
loss of margins against each codeword, chooses the codeword with the least loss
and flags a text whose two nearest codewords lie close together.

The classifiers come from n-gram counts by language over all training rows:
tasks count in fixed tables, Spark sums them, and the sums (languages x hash
buckets, both bounded) fix all bits at once. Whole texts are scored in Arrow
batches against broadcast weights of fixed size; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm import _text

#: Hash buckets of the n-grams.
DIMS = 1 << 14
#: More languages than this are refused: tables and weights grow with them.
MAX_LANGUAGES = 300
#: N-grams beyond so many add no more confidence.
FULL_EVIDENCE = 200
#: Two codewords whose losses lie closer are ambiguous.
MIN_GAP = 2.0
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    #: languages x bits, -1 or 1
    code: np.ndarray
    #: n-gram buckets x bits: log odds
    weights: np.ndarray


def _letter_table() -> np.ndarray:
    """Of each 16-bit code point: its lower case if it is a letter, else a blank."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x10000)], dtype=np.uint32)


_TABLES: list[np.ndarray] = []


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """texts x DIMS counts of n-grams, and whether each text has a letter.

    Runs of what is no letter count as one blank.
    """
    if not _TABLES:
        _TABLES.append(_letter_table())
    n = len(texts)
    chars, at = _text.codes(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    low = _TABLES[0][np.minimum(chars, 0xFFFF)]
    for c in np.unique(chars[chars > 0xFFFF]):
        low[chars == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 32
    letters = np.bincount(doc, weights=low != 32, minlength=n) > 0
    blank = low == 32
    stay = np.ones(low.size, dtype=bool)
    stay[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    low, doc = low[stay].astype(_text.U64), doc[stay]
    counts = np.zeros(n * DIMS, dtype=np.int64)
    for width in (1, 2, 3):
        grams, first = _text.windows(low + _text.U64(width << 32), doc, width)
        bucket = (_text.mix(grams) & _text.U64(DIMS - 1)).astype(np.int64)
        counts += np.bincount(doc[first] * DIMS + bucket, minlength=n * DIMS)
    return counts.reshape(n, DIMS), letters


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """languages x bits of -1 and 1: all splits for up to 6 languages, beyond that random ones far apart."""
    if languages <= 1:
        return np.zeros((languages, 0), dtype=np.int8)
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(languages)], dtype=np.int8)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(15 * np.log2(languages))), None, -1
    for _ in range(50):
        code = np.array([rng.permutation(np.arange(languages) % 2) for _ in range(bits)], dtype=np.int8).T * 2 - 1
        near = int(((bits - code @ code.T.astype(np.int64)) // 2 + bits * np.eye(languages, dtype=np.int64)).min())
        if near > most:
            best, most = code, near
    return best


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from all rows with a non-null language and text; nothing is sampled.

    Languages count alike whatever their number of rows. Over MAX_LANGUAGES
    languages raise an error.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in _text.slices(batches, "text", rows=256):
            counts, _ = gram_counts(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                own = counts[langs == lang].sum(axis=0)
                sums[lang] = sums[lang] + own if lang in sums else own
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"over {MAX_LANGUAGES} languages")
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    packed.sort(key=lambda r: r["lang"])
    table = np.zeros((len(packed), DIMS))
    for row, r in zip(table, packed, strict=True):
        for bucket, n in r["counts"]:
            row[bucket] = n
    share = (table + 0.1) / (table + 0.1).sum(axis=1, keepdims=True)
    code = codewords(len(packed))
    weights = np.zeros((DIMS, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0) / share[code[:, b] < 0].mean(axis=0))
    return Model([r["lang"] for r in packed], code, weights)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share of all (0 to 1), and whether the next is close."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None]).sum(axis=2)
    order = np.sort(loss, axis=1)
    best = loss.argmin(axis=1)
    share = 1 / np.exp(-(loss - order[:, :1])).sum(axis=1)
    close = order[:, 1] - order[:, 0] < MIN_GAP if loss.shape[1] > 1 else np.zeros(len(loss), dtype=bool)
    return best, share, close


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with lang_pred, score (0 to 1) and ambiguous, from its text alone.

    New columns take the place of columns so named; the rest passes through. A
    null text, a text without a letter, and any text if the model knows no
    language, gives 'und' with score 0. Repeated rows each give a row.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    kept, sent = docs.select(*keep), docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double, ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in _text.slices(batches, text_col, rows=256):
            counts, letters = gram_counts(part.column(text_col))
            total = np.maximum(counts.sum(axis=1), 1)
            margins = (counts.astype(np.float32) @ model.weights) * (np.minimum(total, FULL_EVIDENCE) / total)[:, None]
            if model.languages:
                best, share, close = decode(model, margins)
            else:
                best, share, close = np.zeros(len(total), int), np.zeros(len(total)), np.zeros(len(total), bool)
                letters[:] = False
            names = [model.languages[i] if yes else UNKNOWN for i, yes in zip(best, letters, strict=True)]
            new = [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(close & letters)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, "lang_pred", "score", "ambiguous"])

    return kept.mapInArrow(run, schema)
