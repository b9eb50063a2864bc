"""Quality rules: base rules and a calibrated logistic regression over hashed n-grams.

Every whole text gets its base figures and a probability of good quality from
one pass of Arrow batches. Features are word unigrams and character 3- and
4-grams, hashed into fixed tables, log-damped and scaled to length 1. The model
is fitted on a bounded sample of labelled rows (at most `per_class` of each
label, those with the least hashes), of which a quarter serves for calibration
only (Platt scaling, at the classes' true shares). Thresholds are fixed.

There is no shuffle of texts: the sampled labels are broadcast (bounded), their
features go to the driver (bounded), and the weights (fixed size) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm import _text

#: Hash tables of words and of character n-grams.
WORD_DIMS, CHAR_DIMS = 1 << 12, 1 << 13
DIMS = WORD_DIMS + CHAR_DIMS
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 1_000
#: Rows with a lower probability of good quality are rejected.
MIN_PROBABILITY = 0.5
#: Base rules: fewest words, largest share (percent) of words in repeated windows, and the windows' width.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOLS = _text.byte_table(*((b, b) for b in b"#*$%&|<>"))


class Model(NamedTuple):
    """Weights, intercept, and the slope and offset of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights + self.intercept) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(texts: pa.Array, found: _text.Words) -> np.ndarray:
    """A row of DIMS features for each text; a text without words has zeros."""
    n = len(texts)
    out = np.zeros((n, DIMS), dtype=np.float32)
    at = found.doc * WORD_DIMS + (found.hash & _text.U64(WORD_DIMS - 1)).astype(np.int64)
    out[:, :WORD_DIMS] = np.bincount(at, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    chars, starts = _text.codes(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))
    counts = np.zeros(n * CHAR_DIMS)
    for width in (3, 4):
        grams, first = _text.windows(chars.astype(_text.U64), doc, width)
        at = doc[first] * CHAR_DIMS + (grams & _text.U64(CHAR_DIMS - 1)).astype(np.int64)
        counts += np.bincount(at, minlength=n * CHAR_DIMS)
    out[:, WORD_DIMS:] = counts.reshape(n, CHAR_DIMS)
    np.log1p(out, out=out)
    for part in (out[:, :WORD_DIMS], out[:, WORD_DIMS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9) * np.sqrt(2)
    return out


def _sum_rows(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def base_figures(texts: pa.Array, found: _text.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    data, at = _text.text_bytes(texts)
    grams, first = _text.windows(found.hash, found.doc, WINDOW)
    own = _text.join_hash(found.doc[first].astype(_text.U64), grams)
    _, place, count = np.unique(own, return_inverse=True, return_counts=True)
    again = first[count[place] > 1]
    cover = np.zeros(found.hash.size + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    dup = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        lines = (text.as_py() or "").split("\n")
        if len(lines) > 1:
            own_lines = [x for x in lines if x.strip(" \t\r\v\f")]
            dup[i] = len(own_lines) - len(set(own_lines))
    return {
        "n_words": np.bincount(found.doc, minlength=n).astype(np.int64),
        "word_chars": _text.per_text(((data & 0xC0) != 0x80) & _text.NOT_SPACE[data], at),
        "n_symbols": _text.per_text(_SYMBOLS[data], at),
        "n_dup_lines": dup,
        "n_repeat_words": _sum_rows(np.cumsum(cover[:-1]) > 0, found.doc, n),
    }


def fit(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 300, ridge: float = 1e-4) -> Model:
    """A model from features and labels 0 or 1; share is the part of label 1 among all labelled rows.

    With one label only, or none, every text gets that label's share.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(y) < 8 or not 0 < y.mean() < 1:
        return Model(np.zeros(DIMS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 4 == 3
    if not 0 < y[held].mean() < 1 or not 0 < y[~held].mean() < 1:
        held[:] = False
    xs, ys = x[~held], y[~held].astype(np.float32)
    part = np.where(ys == 1, 0.5 / ys.sum(), 0.5 / (1 - ys).sum()).astype(np.float32)
    w, b = np.zeros(DIMS, np.float32), np.float32(0)
    ahead, ahead_b = w, b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xs @ ahead + ahead_b, -30, 30)))
        g = part * (p - ys)
        new, new_b = ahead - 2 * (xs.T @ g + ridge * ahead), ahead_b - 2 * g.sum()
        pull = np.float32(k / (k + 3))
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    test, want = (x[held], y[held]) if held.any() else (x, y)
    z, slope, offset = test @ w + b, 1.0, 0.0
    weight = np.where(want == 1, share / max(1, want.sum()), (1 - share) / max(1, (1 - want).sum()))
    for _ in range(100):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        g, v = weight * (p - want), weight * p * (1 - p)
        grad = np.array([g @ z + 1e-4 * (slope - 1), g.sum()])
        hess = np.array([[v @ (z * z) + 1e-4, v @ z], [v @ z, v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
    return Model(w, float(b), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the documents that have a label in labels (id_col, quality 0 or 1).

    Labels with a null id or quality are left out. Of each class at most
    per_class labels are used, those with the least hash of their id. A label
    whose id has several rows is fitted on one, that with the least hash of its text.
    """
    good = (F.col("quality") > 0).cast("int").alias("quality")
    named = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), good).distinct()
    sizes = {r["quality"]: r["n"] for r in named.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for quality in sizes:
        part = named.filter(F.col("quality") == quality).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0), 0.5)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", rows=256):
            texts = part.column("text")
            x = features(texts, _text.words(texts, _text.NOT_SPACE, lower=False))
            at = [np.flatnonzero(row).astype("<u2") for row in x]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("quality"),
                    pa.array([a.tobytes() for a in at], pa.binary()),
                    pa.array([row[a].astype("<f2").tobytes() for row, a in zip(x, at, strict=True)], pa.binary()),
                ],
                ["_id", "quality", "at", "value"],
            )

    id_type = chosen.schema["_id"].dataType.simpleString()
    rows = sample.mapInArrow(sparse, f"_id {id_type}, quality int, at binary, value binary").collect()
    rows.sort(key=lambda r: (str(r["_id"]), r["at"]))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f2")
    return fit(x, np.array([r["quality"] for r in rows], dtype=np.int64), sizes.get(1, 0) / sum(sizes.values()))


def score(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY, text_col: str = "text") -> DataFrame:
    """Every row with its base figures, base_failed, quality (probability) and kept.

    New columns take the place of columns so named; the rest passes through. A
    null or empty text has no words, so it fails the base rules. Repeated rows
    each give a row; no rows give no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c not in (*names, "base_failed", "quality", "kept")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{n} long" for n in names), "base_failed boolean, quality double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, text_col, rows=256):
            texts = part.column(text_col)
            found = _text.words(texts, _text.NOT_SPACE, lower=False)
            base = base_figures(texts, found)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            p = sent.value.probability(features(texts, found)).astype(np.float64)
            new = [*(pa.array(base[n]) for n in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= min_probability))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, *names, "base_failed", "quality", "kept"])

    return kept.mapInArrow(run, schema)
