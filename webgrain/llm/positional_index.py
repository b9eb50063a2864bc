"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by documents: each row is a segment, the inverted index
of a slice of whole texts, with its terms in order and for each term its
postings (document, position) in order. Building it moves no text between
tasks; it is stored as Parquet, and searches read it as often as they like.

A search takes the windows of the benchmark's items. In each segment a window
starts from the postings of its rarest term (by counts over the whole index),
moved by the term's place in the window, and intersects the lists of its other
terms, rarest first. What is left are exact phrase matches, all words compared.
For proximity, each span of an item gives a group: its rarest terms that the
index holds. A group within a few words of its rarest term, in any order, is a
match.

The windows are broadcast in blocks of a bounded number of words; a larger
benchmark takes more passes over the stored index. Only documents with matches
are shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm import _text
from webgrain.llm._spark import LARGE_ROWS, cut

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of the benchmark in one broadcast block (an item is never split).
BLOCK_WORDS = 1 << 17
#: Bytes of text in a segment of the index.
SEGMENT_BYTES = 2 << 20
#: A proximity match: so many of the rarest terms of a span, each within so many words of the rarest.
#: A span is so many words and one more.
NEAR_TERMS, NEAR_WORDS = 4, 20

#: Positions are stored from here on, so that moving a list never goes below 0.
_SHIFT = 1 << 20


class Block(NamedTuple):
    """Windows of some items; terms beside a window's width are unused."""

    terms: np.ndarray  # windows x WINDOW
    width: np.ndarray
    order: np.ndarray  # windows x WINDOW: places, the rarest term first
    owners: list[list[str]]  # the items of each window
    near_terms: np.ndarray  # groups x NEAR_TERMS, the rarest first
    near_width: np.ndarray
    near_owners: list[list[str]]  # the items of each group


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index of docs, lazily; store them before searching, in small row groups (LARGE_ROWS).

    Columns: segment, ids and n_words (arrays, by document), terms (sorted 64-bit
    hashes), ends (of each term's postings) and postings (document << 32 |
    position), all three binary. A null text has no words; null and repeated ids
    are documents like others. No rows give no segments.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_text.slices(batches, "text", SEGMENT_BYTES)):
            texts = part.column("text")
            n_words, kept = np.zeros(len(texts), dtype=np.int64), []
            done = 0
            for small in _text.slices(iter([part]), "text"):
                found = _text.words(small.column("text"), _text.ALNUM, lower=True)
                per_doc = np.bincount(found.doc, minlength=small.num_rows)
                n_words[done : done + small.num_rows] = per_doc
                place = np.arange(found.doc.size) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                posting = ((found.doc + done).astype(np.uint64) << np.uint64(32)) | (place + _SHIFT).astype(np.uint64)
                kept.append((found.hash, posting))
                done += small.num_rows
            terms, postings = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(terms, kind="stable")
            distinct, counts = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k]),
                    pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column("id")),
                    pa.array([n_words.tolist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (distinct, np.cumsum(counts), postings[order])),
                ],
                ["segment", "ids", "n_words", "terms", "ends", "postings"],
            )

    return own.mapInArrow(run, f"segment long, ids array<{id_type}>, n_words array<long>, terms binary, ends binary, postings binary")


def term_counts(index: DataFrame) -> DataFrame:
    """How often each term occurs: term (the hash as a long), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                n = np.diff(np.frombuffer(ends.as_py(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(n)], ["term", "n"])

    return index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def query_block(items: list[tuple[str, np.ndarray]], counts: dict[int, int], window: int = WINDOW) -> Block:
    """Windows of items, given as (id, hashes of its words in order)."""
    found: dict[bytes, set[str]] = {}
    near: dict[bytes, set[str]] = {}
    rarity = lambda hashes: np.array([counts.get(int(h), 0) for h in hashes.view(np.int64)], dtype=np.int64)
    for name, words in items:
        for at in range(max(1, len(words) - window + 1)):
            found.setdefault(words[at : at + window].tobytes(), set()).add(name)
        n = rarity(words)
        for at in range(max(1, len(words) - NEAR_WORDS)):
            distinct, first = np.unique(words[at : at + NEAR_WORDS + 1], return_index=True)
            own = n[at + first]
            rarest = np.argsort(own, kind="stable")
            rarest = rarest[own[rarest] > 0][:NEAR_TERMS]
            if rarest.size == min(NEAR_TERMS, distinct.size):
                near.setdefault(distinct[rarest].tobytes(), set()).add(name)
    width = np.array([len(w) // 8 for w in found], dtype=np.int64)
    terms = np.zeros((len(found), window), dtype=np.uint64)
    order = np.zeros((len(found), window), dtype=np.int64)
    for k, w in enumerate(found):
        own = np.frombuffer(w, dtype=np.uint64)
        terms[k, : own.size] = own
        order[k, : own.size] = np.argsort(rarity(own), kind="stable")
    near_terms, near_width = np.zeros((len(near), NEAR_TERMS), dtype=np.uint64), np.array([len(g) // 8 for g in near], dtype=np.int64)
    for k, g in enumerate(near):
        near_terms[k, : len(g) // 8] = np.frombuffer(g, dtype=np.uint64)
    return Block(terms, width, order, [sorted(x) for x in found.values()], near_terms, near_width, [sorted(x) for x in near.values()])


class Segment:
    """One row of the index, opened."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes):
        self.terms, self.ends = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int64)
        self.postings = np.frombuffer(postings, np.uint64)

    def place(self, term: np.ndarray) -> np.ndarray:
        """The index of each term in this segment, -1 if it has no postings here."""
        if not self.terms.size:
            return np.full(term.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, term), self.terms.size - 1)
        return np.where(self.terms[at] == term, at, -1)

    def list(self, at: int) -> np.ndarray:
        return self.postings[self.ends[at - 1] if at else 0 : self.ends[at]]

    def phrase(self, terms: np.ndarray, order: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where all terms stand in a row: the first word's postings."""
        starts = self.list(places[order[0]]) - np.uint64(order[0])
        for k in order[1:]:
            if not starts.size:
                break
            other, want = self.list(places[k]), starts + np.uint64(k)
            at = np.minimum(np.searchsorted(other, want), other.size - 1)
            starts = starts[other[at] == want]
        return starts

    def near(self, places: np.ndarray, words: int) -> np.ndarray:
        """Postings of the first term that have all others within so many words."""
        base = self.list(places[0])
        for p in places[1:]:
            other = self.list(p)
            at = np.searchsorted(other, base - np.uint64(words))
            base = base[(at < other.size) & (other[np.minimum(at, other.size - 1)] <= base + np.uint64(words))]
        return base


def _search_segment(seg: Segment, block: Block) -> dict[int, tuple[list[tuple[int, int]], set[str], set[str]]]:
    """Of each document with a match: spans of words, items by phrase, items by proximity."""
    out: dict[int, tuple[list[tuple[int, int]], set[str], set[str]]] = {}
    rows = np.arange(len(block.width))
    rows = rows[seg.place(block.terms[rows, block.order[rows, 0]]) >= 0]
    places = seg.place(block.terms[rows])
    unused = np.arange(block.terms.shape[1])[None, :] >= block.width[rows][:, None]
    for k in np.flatnonzero(((places >= 0) | unused).all(axis=1)):
        w, width = rows[k], int(block.width[rows[k]])
        for p in seg.phrase(block.terms[w], block.order[w, :width], places[k]).tolist():
            spans, items, _ = out.setdefault(p >> 32, ([], set(), set()))
            start = (p & 0xFFFFFFFF) - _SHIFT
            spans.append((start, start + width))
            items.update(block.owners[w])
    places = seg.place(block.near_terms)
    unused = np.arange(NEAR_TERMS)[None, :] >= block.near_width[:, None]
    for k in np.flatnonzero(((places >= 0) | unused).all(axis=1)):
        for doc in np.unique(seg.near(places[k, : block.near_width[k]], NEAR_WORDS) >> np.uint64(32)).tolist():
            out.setdefault(doc, ([], set(), set()))[2].update(block.near_owners[k])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "segment long, doc int, spans array<struct<start:long,end:long>>, items array<string>, near array<string>"


def search(index: DataFrame, block: Block) -> DataFrame:
    """Matches of one block: segment, doc (place in the segment), spans, items, near; only documents with any."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("segment")[row].as_py()
                seg = Segment(*(batch.column(c)[row].as_py() for c in ("terms", "ends", "postings")))
                found = _search_segment(seg, sent.value)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(found), pa.int64()),
                            pa.array(list(found), pa.int32()),
                            pa.array([_merged(x[0]) for x in found.values()], _SPANS),
                            pa.array([sorted(x[1]) for x in found.values()], pa.list_(pa.string())),
                            pa.array([sorted(x[2]) for x in found.values()], pa.list_(pa.string())),
                        ],
                        ["segment", "doc", "spans", "items", "near"],
                    )

    return index.select("segment", "terms", "ends", "postings").mapInArrow(run, _HITS)


def _union(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones put together."""
    kind = "array<struct<start:long,end:long>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return (
            F.when(F.size(done) == 0, F.array(s))
            .when(s["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(s)))
            .cast(kind)
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def _counts_of(counts: DataFrame, block: list[tuple[str, np.ndarray]]) -> dict[int, int]:
    """Counts of a block's terms: no more numbers than the block has words."""
    terms = pa.table({"term": _text.signed(np.unique(np.concatenate([w for _, w in block])))})
    own = counts.sparkSession.createDataFrame(terms)
    return {r["term"]: r["n"] for r in counts.join(F.broadcast(own), "term").collect()}


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items with their words' hashes, streamed to the driver in blocks of a bounded number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            found = _text.words(part.column("text"), _text.ALNUM, lower=True)
            parts = np.split(found.hash, np.cumsum(np.bincount(found.doc, minlength=part.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "words"])

    own = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    block, size = [], 0
    for r in own.mapInArrow(run, "id string, words binary").toLocalIterator():
        words = np.frombuffer(bytes(r["words"]), dtype=np.uint64)
        if words.size:
            if block and size + words.size > most:
                yield block
                block, size = [], 0
            block.append((r["id"], words))
            size += words.size
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every document with its matches against all windows of all items.

    Returns id_col, n_words, n_hit (words inside a matched window), spans (of
    matched words, merged), items (ids as strings, sorted: phrase matches) and
    near_items (proximity matches), one row for each row of docs. A null text has
    no words. Items with a null id or without words match nothing; repeated
    items count once. Without items every document is clean.
    """
    blocks = item_blocks(items, item_col, item_text_col, block_words)
    first, second = next(blocks, []), next(blocks, None)
    index = cut(build_index(docs, id_col, text_col), LARGE_ROWS)
    counts = cut(term_counts(index)) if second else term_counts(index)
    hits = []
    for block in itertools.chain([first] if first else [], [second] if second else [], blocks):
        found = search(index, query_block(block, _counts_of(counts, block)))
        hits.append(cut(found) if second else found)
    base = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "d"))
    base = base.select("segment", "doc", F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))
    if not hits:
        hits = [docs.sparkSession.createDataFrame([], _HITS)]
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("segment", "doc").agg(
        _union(F.flatten(F.collect_list("spans"))).alias("spans"), flat("items").alias("items"), flat("near").alias("near_items")
    )
    none = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType))
    return base.join(found, ["segment", "doc"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.aggregate(none("spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        none("spans").alias("spans"),
        none("items").alias("items"),
        none("near_items").alias("near_items"),
    )
