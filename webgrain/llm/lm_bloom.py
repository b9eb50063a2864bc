"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from all training texts (tasks
add up what they have before the shuffle). The filter holds each count in
quantised form: for a count of level q, the pair (n-gram, j) is a member for
every j from 1 to q. A worker reads a count back by probing j = 1, 2, ... until
the first miss. A false member can raise a level, never lower one.

All pairs are stored, those seen once too. Of a history h the filter also holds
how many of its tokens belong to pairs seen once (rest: what a new pair may
expect; histories are told apart by 32 bits there), and a probability is

    p(w | h) = (count(h w) + (rest(h) + 0.5) * p(w)) / (count(h) + rest(h) + 0.5)

so a weight like that of the rarest pairs goes to the words' own probabilities

    p(w) = (count(w) + 0.1) / (N + 0.1 * (V + 1))

The bits of the filter follow the number of members, so the same counts are
stored at every size. All levels of an n-gram lie in one block, blocks in pieces
of bounded size that stay distributed. Texts are scored in chunks: a chunk sends
each of its distinct n-grams, as 5 bytes, to the piece that holds it and gets its
levels back, one byte each. Only a caller who bounds the filter (max_filter_bytes) loses counts:
the least count that is stored then doubles until the members fit. Exact word
counts, for the base score, are joined: the head of the vocabulary is broadcast
(a fixed number of words), the tail is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm import _text
from webgrain.llm._spark import cut, drop

#: Growth of the count from one level to the next.
STEP = 1.5
#: Bits of the filter for each member, and bits set for a member.
BITS_PER_MEMBER, PROBES = 10, 6
#: Bits of a block: a member's bits all lie in one.
BLOCK_BITS = 1 << 15
_LOW = np.uint64(BLOCK_BITS - 1)
#: Most bytes of a piece of the filter, and bytes of text that are scored at once.
PIECE_BYTES, CHUNK_BYTES = 4 << 20, 4 << 20
#: Addresses that are probed at once: what belongs to them stays in a core's cache.
PROBED = 1 << 14
#: Keys that a task gathers before it sends them to their pieces.
PACK = 1 << 20
#: The words whose exact counts are broadcast: 16 bytes each.
HEAD_WORDS = 1 << 18
#: Tokens that a counting task gathers before it sends sums.
GATHER = 1 << 21
#: Least counts of a word and of a pair that the filter stores, before any doubling.
MIN_WORD, MIN_PAIR = 1, 1

_U = np.uint64
START, END = _text.mix(np.array([1, 2], dtype=_U))
WORD, PAIR, REST = range(3)
#: Levels of a pair stand under its own address, those of a word and of a history under that of the word.
_KIND = _text.mix(np.array([10, 11, 10], dtype=_U))
#: Bytes of an address, and how far the levels of REST lie above those of WORD.
ADDRESS_BYTES, _REST_LEVEL = 5, 1 << 10


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and one end token, and the text of each."""
    found, n = _text.words(texts, _text.NOT_SPACE, lower=True), len(texts)
    at = np.cumsum(np.bincount(found.doc, minlength=n))
    return np.insert(found.hash, at, END), np.insert(found.doc, at, np.arange(n))


def histories(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The token before each, or START."""
    out = np.concatenate([[START], tokens[:-1]]).astype(_U)
    out[np.concatenate([[True], doc[1:] != doc[:-1]])] = START
    return out


def pair_keys(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs; the upper half is that of the history's hash."""
    return (history & _U(0xFFFFFFFF00000000)) | (_text.join_hash(history, token) & _U(0xFFFFFFFF))


def count_ngrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, k, n): key and count of each word (pair is false) and of each pair in all texts of docs."""

    def sums(kept: list[np.ndarray], pair: bool) -> pa.RecordBatch:
        at, keys = pd.factorize(np.concatenate(kept).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, pair)), pa.array(keys), pa.array(np.bincount(at, minlength=keys.size))], ["pair", "k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        size = 0
        for part in _text.slices(batches, text_col):
            tokens, doc = token_hashes(part.column(text_col))
            kept[0].append(tokens)
            kept[1].append(pair_keys(histories(tokens, doc), tokens))
            size += tokens.size
            if size >= GATHER:
                yield from (sums(kept[k], bool(k)) for k in (0, 1))
                kept, size = ([], []), 0
        if size:
            yield from (sums(kept[k], bool(k)) for k in (0, 1))

    texts = docs.select(F.col(text_col).cast("string").alias(text_col))
    return texts.mapInArrow(run, "pair boolean, k long, n long").groupBy("pair", "k").agg(F.sum("n").alias("n"))


def level_of(count: np.ndarray, least: int) -> np.ndarray:
    """0 below the least count, then 1, 2, ..."""
    count = np.asarray(count, dtype=np.float64)
    return np.where(count < least, 0, 1 + np.floor(np.log(np.maximum(count / least, 1)) / np.log(STEP) + 1e-9)).astype(np.int64)


def count_of(level: np.ndarray, least: int) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low, high = least * STEP ** (level - 1.0), least * STEP ** (1.0 * level)
    middle = (np.ceil(low - 1e-6) + np.maximum(np.ceil(high - 1e-6) - 1, np.ceil(low - 1e-6))) / 2
    return np.where(level > 0, middle, 0.0)


def _address(keys: np.ndarray, kind: int) -> np.ndarray:
    return _text.mix(keys ^ _KIND[kind]) & _U((1 << 8 * ADDRESS_BYTES) - 1)


def _to_bytes(address: np.ndarray) -> bytes:
    return np.ascontiguousarray(address.view(np.uint8).reshape(-1, 8)[:, :ADDRESS_BYTES]).tobytes()


def _from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ADDRESS_BYTES, 8), dtype=np.uint8)
    out[:, :ADDRESS_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, ADDRESS_BYTES)
    return out.view(_U).ravel()


def _member(address: np.ndarray, level: int) -> np.ndarray:
    return _text.mix(address + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class Shape(NamedTuple):
    """Blocks of the filter and of each piece."""

    blocks: int
    piece_blocks: int

    @property
    def pieces(self) -> int:
        return -(-self.blocks // self.piece_blocks)

    def block(self, address: np.ndarray) -> np.ndarray:
        return ((address >> _U(8)) % _U(self.blocks)).astype(np.int64)

    def bits(self, address: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bits of a level inside its piece: in the address's block, by double hashing."""
        base, member = self.block(address) % self.piece_blocks * BLOCK_BITS, _member(address, level)
        for probe in range(PROBES):
            yield base + ((member + _U(probe) * ((member >> _U(17)) | _U(1))) & _U(BLOCK_BITS - 1)).astype(np.int64)

    def levels(self, bits: np.ndarray, address: np.ndarray, above: int = 0) -> np.ndarray:
        """Levels that a piece (a byte for each bit) holds for its addresses; those of a history lie above."""
        level = np.zeros(address.size, dtype=np.uint8)
        for start in range(0, address.size, PROBED):
            own = address[start : start + PROBED]
            base = self.block(own) % self.piece_blocks * BLOCK_BITS
            live, k = np.arange(own.size), 0
            while live.size and k < 255:
                k += 1
                held = self._holds(bits, base, own, above + k)
                live, base, own = live[held], base[held], own[held]
                level[start + live] = k
        return level

    @staticmethod
    def _holds(bits: np.ndarray, base: np.ndarray, address: np.ndarray, level: int) -> np.ndarray:
        """Places of the addresses whose level is a member; where two probes refuse most, the others ask for the rest only."""
        member = _member(address, level)
        # Only the lowest bits of a position count, so sums of a few of them do for those of bits().
        at, step = (member & _LOW).view(np.int64), ((member >> _U(17) | _U(1)) & _LOW).view(np.int64)
        held, place = bits.take(base + at), None
        for probe in range(1, PROBES):
            at += step
            at &= BLOCK_BITS - 1
            held &= bits.take(base + at)
            if probe == 1 and 2 * np.count_nonzero(held) < held.size:
                place = np.flatnonzero(held)
                base, at, step, held = base[place], at[place], step[place], held[place]
        return np.flatnonzero(held) if place is None else place[held]


class Filter(NamedTuple):
    """Pieces (piece, bits), and the least counts of words and pairs in them."""

    pieces: DataFrame
    shape: Shape
    least_word: int
    least_pair: int


def _by_piece(shape: Shape, address: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts addresses by block, so by piece too; the pieces, and where each begins and the last ends."""
    block = shape.block(address)
    # In a piece by block, so that what is read and written one after the other lies together. Numbers of 16 bits are sorted by counting.
    order = np.argsort(block.astype(np.uint16), kind="stable")
    if shape.blocks > 1 << 16:
        order = order[np.argsort((block >> 16).astype(np.uint16 if shape.blocks <= 1 << 32 else np.int64)[order], kind="stable")]
    piece = (block // shape.piece_blocks)[order]
    begins = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if piece.size else np.zeros(0, dtype=np.int64)
    return order, piece[begins], np.append(begins, piece.size)


def _packed(counts: DataFrame, kind: int, least: int, shape: Shape) -> DataFrame:
    """(piece, address, level): addresses and levels of the counts (k, n), many to a row."""

    def rows(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        k, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in kept]) for c in ("k", "n"))
        address = _address(k.view(_U), kind)
        order, found, ends = _by_piece(shape, address)
        address, level = address[order], level_of(n, least)[order].astype(np.uint8)
        cuts = list(zip(ends[:-1], ends[1:], strict=True))
        blobs = (pa.array([f(x[i:j]) for i, j in cuts], pa.binary()) for x, f in ((address, _to_bytes), (level, np.ndarray.tobytes)))
        above = pa.array([_REST_LEVEL * (kind == REST)] * len(cuts), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(found), above, *blobs], ["piece", "above", "address", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= PACK:
                yield rows(kept)
                kept, size = [], 0
        if size:
            yield rows(kept)

    return counts.filter(F.col("n") >= least).select("k", "n").mapInArrow(run, "piece long, above int, address binary, level binary")


def _size(counts: DataFrame, least: int) -> int:
    """How many members the counts would make."""
    levels = F.floor(F.log(F.col("n") / F.lit(least)) / F.lit(float(np.log(STEP))) + 1e-9) + 1
    return int(counts.filter(F.col("n") >= least).agg(F.coalesce(F.sum(levels), F.lit(0)).alias("n")).collect()[0]["n"])


class Model(NamedTuple):
    """Counts that stay distributed, totals, and the filter."""

    words: DataFrame
    tokens: int
    vocabulary: int
    filter: Filter


def train(docs: DataFrame, text_col: str = "text", max_filter_bytes: int | None = None) -> Model:
    """A model from all texts of docs; a null text is an empty one, which has its end token."""
    counts = cut(count_ngrams(docs, text_col))
    words, pairs = cut(counts.filter("NOT pair").select("k", "n")), counts.filter("pair").select("k", "n")
    n_docs = docs.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    double = 0
    while True:
        least_word, least_pair = MIN_WORD << double, MIN_PAIR << double
        stored = pairs.filter(F.col("n") >= least_pair)
        half = lambda c: F.shiftright(c, 32)
        start = docs.sparkSession.createDataFrame([(int(START.view(np.int64)), n_docs)], "k long, n long")
        seen_words = words.unionByName(start)
        kept = stored.groupBy(half("k").alias("h")).agg(F.sum("n").alias("kept"), F.count_if(F.col("n") == 1).alias("once"))
        own = seen_words.filter(F.col("k") != int(END.view(np.int64))).withColumn("h", half("k"))
        seen = own.groupBy("h").agg(F.sum("n").alias("seen"))
        both = kept.join(seen, "h").select("h", (F.greatest(F.col("seen") - F.col("kept"), F.lit(0)) + F.col("once")).alias("n"))
        rest = cut(own.select("k", "h").join(both.filter("n > 0"), "h").select("k", "n"))
        parts = [(seen_words, WORD, least_word), (stored, PAIR, least_pair), (rest, REST, 1)]
        members = sum(_size(counts, least) for counts, _, least in parts)
        if max_filter_bytes is None or members * BITS_PER_MEMBER <= max_filter_bytes * 8 or double >= 40:
            break
        drop(rest)
        double += 1
    blocks = max(1, -(-members * BITS_PER_MEMBER // BLOCK_BITS))
    tasks = _tasks(docs)
    shape = Shape(blocks, max(1, min(PIECE_BYTES * 8 // BLOCK_BITS, blocks // tasks)))
    rows = None
    for counts, kind, least in parts:
        more = _packed(counts, kind, least, shape)
        rows = more if rows is None else rows.unionByName(more)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

        piece, bits = None, np.zeros(0, dtype=bool)
        for batch in batches:
            for own, above, address, level in zip(*(batch.column(c) for c in ("piece", "above", "address", "level")), strict=True):
                if own.as_py() != piece:
                    if piece is not None:
                        yield done()
                    piece, bits = own.as_py(), np.zeros(shape.piece_blocks * BLOCK_BITS, dtype=bool)
                addresses, levels = _from_bytes(address.as_py()), np.frombuffer(level.as_py(), np.uint8)
                for k in range(1, int(levels.max(initial=0)) + 1):
                    for at in shape.bits(addresses[levels >= k], above.as_py() + k):
                        bits[at] = True
        if piece is not None:
            yield done()

    pieces = rows.repartition(max(tasks, shape.pieces // 8), "piece").sortWithinPartitions("piece").mapInArrow(fill, "piece long, bits binary")
    made = cut(pieces)
    drop(counts, rest)
    return Model(words, int(total["n"]), int(total["v"]), Filter(made, shape, least_word, least_pair))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Chunk(NamedTuple):
    """Tokens of some texts: distinct words (the last one is START) and pairs, and the addresses of both.

    word, head and pair give the place of each token, of the one before it and of
    its pair among them.
    """

    words: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    head: np.ndarray
    pair: np.ndarray
    word_address: np.ndarray
    pair_address: np.ndarray


def _chunk(texts: pa.Array) -> _Chunk:
    tokens, doc = token_hashes(texts)
    word, found = pd.factorize(tokens.view(np.int64))
    words = np.append(found.view(_U), START)
    head = np.append(found.size, word[:-1])
    head[np.append(True, doc[1:] != doc[:-1])] = found.size
    pair, both = pd.factorize(head * np.int64(words.size) + word)
    keys = pair_keys(words[both // words.size], words[both % words.size])
    return _Chunk(words, doc, word, head, pair, _address(words, WORD), _address(keys, PAIR))


def _split(shape: Shape, address: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The order that puts addresses by piece, and the addresses of each piece."""
    order, found, ends = _by_piece(shape, address)
    address = address[order]
    return order, {p: address[i:j] for p, i, j in zip(found.tolist(), ends[:-1], ends[1:], strict=True)}


def _ask(chunks: DataFrame, shape: Shape) -> DataFrame:
    """(chunk, piece, words, pairs): the addresses of each chunk (chunk, texts) that lie in each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=_U)
        for batch in batches:
            for number, texts in zip(batch.column("chunk"), batch.column("texts"), strict=True):
                chunk = _chunk(texts.values)
                sides = [_split(shape, a)[1] for a in (chunk.word_address, chunk.pair_address)]
                pieces = sorted({*sides[0], *sides[1]})
                blobs = (pa.array([_to_bytes(side.get(p, none)) for p in pieces], pa.binary()) for side in sides)
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(pieces), pa.int64()), pa.array(pieces, pa.int64()), *blobs], ["chunk", "piece", "words", "pairs"])

    return chunks.select("chunk", "texts").mapInArrow(run, "chunk long, piece long, words binary, pairs binary")


def _answer(asks: DataFrame, f: Filter) -> DataFrame:
    """(chunk, piece, words, rests, pairs): one byte for each address, in the order asked; words have two."""
    shape = f.shape
    held = f.pieces.select(F.lit(-1).cast("long").alias("chunk"), "piece", F.col("bits").alias("words"), F.lit(None).cast("binary").alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of, bits = None, np.zeros(0, dtype=bool)
        for batch in batches:
            out: list[tuple[int, int, bytes, bytes, bytes]] = []
            for chunk, piece, words, pairs in zip(*(batch.column(c) for c in ("chunk", "piece", "words", "pairs")), strict=True):
                if chunk.as_py() < 0:
                    bits_of, bits = piece.as_py(), np.unpackbits(np.frombuffer(words.as_py(), np.uint8), bitorder="little").view(bool)
                    continue
                sides = [_from_bytes(x.as_py()) for x in (words, pairs)]
                asked = ((sides[0], 0), (sides[0], _REST_LEVEL), (sides[1], 0))
                there = piece.as_py() == bits_of
                levels = (shape.levels(bits, a, above) if there else np.zeros(a.size, np.uint8) for a, above in asked)
                out.append((chunk.as_py(), piece.as_py(), *(x.tobytes() for x in levels)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["chunk", "piece", "words", "rests", "pairs"])

    both = asks.unionByName(held).repartition(max(_tasks(asks), shape.pieces // 8), "piece").sortWithinPartitions("piece", "chunk")
    return both.mapInArrow(run, "chunk long, piece long, words binary, rests binary, pairs binary")


def _lm_scores(f: Filter, own: _Chunk, answers: list[dict[str, bytes]], norm: float) -> np.ndarray:
    """log10 p(token | history) of each token, from the levels by piece."""

    def put(order: np.ndarray, of: str) -> np.ndarray:
        level = np.empty(order.size, dtype=np.int64)
        level[order] = np.frombuffer(b"".join(a[of] for a in answers), np.uint8)
        return level

    by_word, by_pair = (_split(f.shape, a)[0] for a in (own.word_address, own.pair_address))
    word = count_of(put(by_word, "words"), f.least_word)
    rest, pair = count_of(put(by_word, "rests"), 1), count_of(put(by_pair, "pairs"), f.least_pair)
    kept = word if f.least_pair == 1 else np.maximum(word - rest, 0)
    p, kept, rest = ((word + 0.1) / norm)[own.word], kept[own.head], rest[own.head]
    seen = np.minimum(pair[own.pair], kept)
    return np.log10(np.where(kept > 0, (seen + (rest + 0.5) * p) / (kept + rest + 0.5), p))


def score(docs: DataFrame, model: Model, text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Every row with n_tokens, n_known, train_tokens, base_score and score.

    n_known counts tokens that training saw; base_score is the sum of log10 p(w)
    by exact counts, score that of log10 p(w | h) by the filter. New columns take
    the place of columns so named; the rest passes through. A null text is an
    empty one, which has its end token; a very long one is a chunk of its own.
    Repeated rows each give a row; there are no ties to break. No rows give no rows.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text_col, *new)]
    norm = model.tokens + 0.1 * (model.vocabulary + 1)
    sc = docs.sparkSession.sparkContext
    top = model.words.orderBy(F.desc("n"), "k").limit(head_words).toArrow().sort_by("k")
    head = sc.broadcast((top["k"].to_numpy(), top["n"].to_numpy()))
    f = model.filter._replace(pieces=None)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_text.slices(batches, "text", CHUNK_BYTES)):
            whole = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("row", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), *whole], ["chunk", "rows", "texts"])

    chunks = cut(rows.mapInArrow(gather, f"chunk long, rows array<{row_type}>, texts array<string>"))
    answers = _answer(_ask(chunks, f.shape), model.filter).repartition(_tasks(docs), "chunk")
    answers = cut(answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("piece", "words", "rests", "pairs"))).alias("answers")))
    asked = chunks.repartition(_tasks(docs), "chunk").join(answers, "chunk").select("rows", "texts", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = head.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row in range(batch.num_rows):
                texts, levels = batch.column("texts")[row].values, batch.column("answers")[row].as_py()
                chunk = _chunk(texts)
                n, words, doc = len(texts), chunk.words[:-1].view(np.int64), chunk.doc
                at = np.minimum(np.searchsorted(keys, words), max(keys.size - 1, 0))
                known = keys[at] == words if keys.size else np.zeros(words.size, dtype=bool)
                log_p = np.where(known, np.log10(((counts[at] if keys.size else 0) + 0.1) / norm), 0.0)
                inside = known[chunk.word]
                lm = np.bincount(doc, weights=_lm_scores(f, chunk, levels, norm), minlength=n)
                base = np.bincount(doc, weights=log_p[chunk.word], minlength=n)
                tail = [words[chunk.word[~inside]], doc[~inside]]
                ends = np.concatenate([[0], np.cumsum(np.bincount(tail[1], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)),
                        batch.column("rows")[row].values,
                        pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(doc[inside], minlength=n).astype(np.int64)),
                        pa.array(base),
                        pa.array(lm),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tail[0])),
                    ],
                    ["at", "row", "n_tokens", "head_known", "head_score", "score", "tail"],
                )
                number += n

    scored = cut(asked.mapInArrow(run, f"at long, row {row_type}, n_tokens long, head_known long, head_score double, score double, tail array<long>"))
    drop(chunks, answers)
    each = scored.select("at", F.explode("tail").alias("k"))
    known = each.join(model.words, "k").groupBy("at").agg(
        F.count("*").alias("tail_known"), F.sum(F.log10((F.col("n") + 0.1) / norm)).alias("tail_score")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown = F.size("tail") - zero("tail_known")
    return scored.join(known, "at", "left").select(
        *(F.col(f"row.{c}").alias(c) for c in keep),
        "n_tokens",
        (F.col("head_known") + zero("tail_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + zero("tail_score") + unknown * float(np.log10(0.1 / norm))).alias("base_score"),
        "score",
    )
