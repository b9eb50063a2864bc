"""Groups of spelling variants by a symmetric-delete join.

Every word emits a key for itself and one for each distinct text that lacks one
of its code points. Words that share a key meet in an equi-join; levenshtein()
confirms those at a distance of exactly one insertion, deletion or replacement.
A word's form is its near word with the largest count, if that is large enough;
following forms leads to its root, by pointer doubling in a loop of joins.

Keys are 64-bit hashes, which a batch computes from sums over code points, so a
word of a million letters costs its length and no list of million-letter texts. Two
texts that share a hash only propose a pair, which the distance check refuses. A key
holds at most the words that one code point more makes of one text, so no key grows
with the data.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm._spark import cut, drop
from webgrain.llm._text import U64, codes, mix, per_text, signed, slices

#: Maximal runs of these are words (after A-Z became a-z).
RUN = re.compile("[a-zÀ-ÿ]+")
#: A counting task hands on its counts when it holds so many distinct words.
HELD_WORDS = 1 << 18
#: Of texts of so many code points the words may be held as a list.
PIECE = 1 << 20
#: Longer words travel as numbers, and their text is looked up for the distance check.
LONG_WORD = 64

_FACTOR = U64(0x9E3779B97F4A7C55)
_INVERSE = U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_LENGTH = U64(0xD6E8FEB86659FD93)


def runs(text: str) -> Iterator[str]:
    """The words of a text in order; those of a long text are not held as a list."""
    lowered = text.encode().lower().decode()  # of bytes only A-Z change
    if len(lowered) <= PIECE:
        yield from RUN.findall(lowered)
        return
    yield from (m[0] for m in RUN.finditer(lowered))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[str, Counter], Counter] | None = None) -> DataFrame:
    """(word, n): how often each word occurs in all texts, counted per batch first.

    change gets a document's id as text (empty if null) and its words' counts, and
    returns the counts to use. Null and empty texts have no words, a repeated row
    counts again. The empty word is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Counter(runs(text)) if text else Counter()
                held.update(change(doc or "", own) if change else own)
                if len(held) >= HELD_WORDS:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and of their distinct single deletions, and the index of each key's word.

    A text's hash is the sum of (code point + 1) * factor ** position; leaving out
    position p keeps what stands before it and divides what stands after it by the factor.
    """
    points, at = codes(words)
    size = np.diff(at)
    word = np.repeat(np.arange(size.size), size)
    power = np.full(int(size.max(initial=0)) + 1, _FACTOR, dtype=U64)
    power[0] = 1
    position = np.arange(points.size) - at[:-1][word]
    part = (points.astype(U64) + U64(1)) * np.cumprod(power, dtype=U64)[position]
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
    whole = upto[at[1:]] - upto[at[:-1]]
    before, after = upto[:-1] - upto[at[:-1]][word], upto[at[1:]][word] - upto[1:]
    distinct = np.ones(points.size, dtype=bool)  # leaving out any of a run of equal letters gives one text
    distinct[1:] = (points[1:] != points[:-1]) | (position[1:] == 0)
    lacking = (before + after * _INVERSE + (size[word] - 1).astype(U64) * _LENGTH)[distinct]
    keys = np.concatenate([whole + size.astype(U64) * _LENGTH, lacking])
    return mix(keys), np.concatenate([np.arange(size.size), word[distinct]])


def _emit(long_word: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            keys, of = deletion_keys(batch.column("word"))
            points, at = codes(batch.column("word"))
            size = per_text(np.ones(points.size, dtype=bool), at)
            short = [w if n <= long_word else None for w, n in zip(batch.column("word").to_pylist(), size, strict=True)]
            most = 1 << 16
            for k in range(0, of.size, most):
                rows = pa.array(of[k : k + most])
                yield pa.RecordBatch.from_arrays(
                    [signed(keys[k : k + most]), batch.column("id").take(rows), batch.column("n").take(rows), pa.array(short, pa.string()).take(rows)],
                    names=["key", "id", "n", "word"],
                )

    return run


def _shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle and sort. Spark sizes rows by the Parquet files they come from, which hold numbers in few bits, and takes
    a row's keys for one row; by that it would send whole tables through the driver.
    """
    return df.hint("merge")


def near_pairs(words: DataFrame, long_word: int = LONG_WORD) -> DataFrame:
    """(a, b: ids; a_n, b_n; a_word, b_word; a < b): all pairs of words (id, word, n) at distance one, each once."""
    keys = words.select("id", "n", "word").mapInArrow(_emit(long_word), "key long, id long, n long, word string")
    a, b = (keys.select("key", F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("word").alias(f"{s}_word")) for s in "ab")
    met = a.join(_shuffled(b), "key").filter("a < b").drop("key")
    one = F.levenshtein("a_word", "b_word", 1) == 1
    short = met.filter("a_word IS NOT NULL AND b_word IS NOT NULL")
    names = [words.select(F.col("id").alias(s), F.col("word").alias(f"{s}_word")) for s in "ab"]
    long = met.filter("a_word IS NULL OR b_word IS NULL").drop("a_word", "b_word").distinct().join(_shuffled(names[0]), "a").join(_shuffled(names[1]), "b")
    return short.filter(one).unionByName(long.filter(one))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): each word's last one on the way from form to form.

    Each round doubles the steps that root is ahead. A form occurs at least so many
    times more often than its word, so a way has at most log n steps and ends.
    """
    ahead = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        steps = ahead.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if ahead.join(_shuffled(steps), "root").limit(1).count() == 0:
            return ahead
        further = cut(ahead.join(_shuffled(steps), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        drop(ahead)
        ahead = further


def spelling_groups(words: DataFrame, gain: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words (word, n), each word once.

    Near words differ by exactly one inserted, deleted or replaced code point. form is
    the near word of largest n (ties: smallest in code-point order) if that n is at
    least gain (2 or more) times the word's, else null; root is the last word on the
    way over forms, the word itself if it has none. Words that are null, or counts that
    are null, are left out; no rows give no rows. Further columns are not carried.
    """
    if gain < 2:
        raise ValueError("gain must be 2 or more, else ways over forms may not end")
    known = words.filter("word IS NOT NULL AND n IS NOT NULL").select("word", "n")
    known = cut(known.withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(known)
    sides = [(x, y) for x, y in itertools.permutations("ab")]
    beside = F.explode(F.array(*(F.struct(F.col(x).alias("id"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(f"{y}_word").alias("word"), F.col(y).alias("id")).alias("other")) for x, y in sides)))
    best = pairs.select(beside.alias("side")).groupBy("side.id").agg(F.count("*").alias("n_near"), F.min("side.other").alias("best"))
    near = cut(best.select("id", "n_near", F.col("best.word").alias("form"), F.col("best.id").alias("form_id"), (-F.col("best.less")).alias("form_n")))
    rows = known.join(_shuffled(near), "id", "left").withColumn("has", F.coalesce(F.col("form_n") >= gain * F.col("n"), F.lit(False)))
    rows = rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("has"), F.col(c)).alias(c) for c in ("form", "form_n", "form_id")))
    roots = _roots(rows.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    finals = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ends = roots.join(_shuffled(finals), "root").select("id", "root_word")
    return rows.join(_shuffled(ends), "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
