"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut wherever a rolling hash of the bytes just read falls below a
bound, so cuts move with the content: an insertion changes the chunks around it
and no others. Chunks are compared by digest and size over all texts; each
chunk's first occurrence (by document id, then place) is kept. Chunks that
follow each other here and at their first occurrence are a seed, however short,
and a seed grows byte by byte, at both ends, as far as the text around it equals
that around the first occurrence. Grown seeds that touch are one passage; one of
min_run_bytes or more is removed, a shorter one, such as a common line, stays.

On Spark: chunk rows carry numbers only. First occurrences come from a
partial aggregation (a chunk that fills half the table sends one row for each
task), the join back is an inner join that Spark may split for skew, and each
document's own chunk numbers go back to it. Chunks are computed again where the
text is. Only a seed that could be part of a long enough passage asks for the
bytes around its first occurrence, and only for as many as can be equal: after a
seed, texts that agree to the end of the next chunk would share that chunk too,
and before it those that agree for the chunk before and what the hash sees. The
answer also has a 128-bit digest of the seed's bytes, so nothing is removed for
an equal 64-bit number alone. Texts are shuffled by key twice, to meet the asks
and to meet the answers; each step is cut, which frees the shuffle before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgrain.llm import _text
from webgrain.llm._spark import cut, drop, row_key

#: Mean bytes of a chunk, and the most.
MEAN_BYTES, MAX_BYTES = 32, 256
#: Repeated passages of fewer bytes stay.
MIN_RUN_BYTES = 100
#: A seed grows over other repeated chunks beside it if they have at most so many bytes.
GROW_BYTES = 96
#: Bytes that the rolling hash sees: each shifts the 32-bit hash by two bits.
_SEEN = 16


def _gear(seed: int = 20) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = _gear()


def chunk_ends(texts: pa.Array, mean: int = MEAN_BYTES, most: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all texts: (bytes on end, first byte of each chunk, end of each, text of each).

    A cut stands after a byte if the hash of the last 16 bytes is below a bound
    and no character is split; a longer chunk is cut after `most` bytes. The
    first 15 bytes of a text hold no cut. An empty text has no chunk.
    """
    data, at = _text.text_bytes(texts)
    if not data.size:
        none = np.zeros(0, np.int64)
        return data, none, none, none
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8):  # each doubles the bytes that a hash has seen
        shifted = rolled[:-step] << np.uint32(2 * step)
        rolled = np.concatenate([rolled[:step], rolled[step:] + shifted])
    whole = np.ones(data.size, dtype=bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    cut = np.flatnonzero((rolled < np.uint32((1 << 32) // mean)) & whole) + 1
    starts = at[:-1][at[:-1] < at[1:]]
    own = np.searchsorted(starts, cut - 1, side="right") - 1
    ends = np.union1d(cut[cut - starts[own] >= _SEEN], at[1:][at[:-1] < at[1:]])
    first = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - first > most)
    if long.size:
        more = []
        for f, e in zip(first[long].tolist(), ends[long].tolist(), strict=True):
            while e - f > most:
                f += most
                while f > 0 and not whole[f - 1]:
                    f -= 1
                more.append(f)
        ends = np.union1d(ends, np.array(more, dtype=np.int64))
        first = np.concatenate([[0], ends[:-1]])
    return data, first, ends, np.searchsorted(at, first, side="right") - 1


def _numbers(doc: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal values."""
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return np.arange(doc.size) - np.repeat(begins, np.diff(np.append(begins, doc.size)))


def _last_cut(size: np.ndarray, first: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """Of each chunk, where the chunk before it begins, or an earlier one if that begins at the cut of a long chunk; its own place in a text's first chunk."""
    at = np.arange(size.size)
    new = np.append(True, doc[1:] != doc[:-1])
    free = new | np.append(True, size[:-1] < most - 3)  # begins at a cut by content, or its text
    begin = np.maximum.accumulate(np.where(free, at, 0))
    return np.where(new, first, first[begin[np.maximum(at - 1, 0)]])


def chunk_digests(docs: DataFrame, mean: int = MEAN_BYTES, most: int = MAX_BYTES) -> DataFrame:
    """Rows (key, id, n, digest, sizes) for each chunk of the columns key, id and text; n counts from 0 in a text.

    sizes packs the bytes from the cut before the last to the chunk (cuts of long chunks do not count), of the
    chunk, and of the one after it, 10 bits each.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            data, first, ends, doc = chunk_ends(part.column("text"), mean, most)
            if first.size:
                owner, size = pa.array(doc), ends - first
                after = np.append(size[1:] * (doc[1:] == doc[:-1]), 0)
                before = np.minimum(first - _last_cut(size, first, doc, most), 1023)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(owner),
                        part.column("id").take(owner),
                        pa.array(_numbers(doc).astype(np.int32)),
                        _text.signed(_text.run_hashes(data, ends - first)),
                        pa.array((before << 20 | size << 10 | after).astype(np.int32)),
                    ],
                    ["key", "id", "n", "digest", "sizes"],
                )

    return docs.select("key", "id", "text").mapInArrow(run, f"key long, id {id_type}, n int, digest long, sizes int")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that occurred before: (key, n, sizes), and the first occurrence's document and chunk (first_id, first_key, first_n)."""
    first = F.min(F.struct("id", "key", "n")).alias("first")
    known = chunks.groupBy("digest").agg(first, F.count("*").alias("times")).filter("times > 1").select("digest", "first")
    later = (F.col("c.key") != F.col("k.first.key")) | (F.col("c.n") != F.col("k.first.n"))
    both = chunks.select("digest", "key", "n", "sizes").alias("c").join(known.alias("k"), (F.col("c.digest") == F.col("k.digest")) & later)
    return both.select("c.key", "c.n", "c.sizes", *(F.col(f"k.first.{x}").alias(f"first_{x}") for x in ("id", "key", "n")))


def _sum_runs(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if begins.size else values[:0]


def seeds(key: np.ndarray, n: np.ndarray, sizes: np.ndarray, first_key: np.ndarray, first_n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of repeated chunks, in order of document and place, the seeds that may belong to a passage of so many bytes.

    Returns for each its first and last row, and how many bytes before and after
    it may be equal. Repeated chunks in a row are a block, of one or more seeds; a
    seed grows beyond its block's ends, not inside it, and not over more than
    GROW_BYTES of other seeds. Blocks with up to 4 chunks between them may touch
    once they have grown.
    """
    other = np.append(True, key[1:] != key[:-1])
    gap = np.append(0, n[1:] - n[:-1])
    block = other | (gap != 1)
    seed = block | np.append(True, (first_key[1:] != first_key[:-1]) | (first_n[1:] != first_n[:-1] + 1))
    heads = np.flatnonzero(seed)
    tails = np.append(heads[1:], n.size) - 1
    size = np.cumsum(sizes >> 10 & 1023)
    block_of = np.cumsum(block) - 1
    starts = np.flatnonzero(block)
    stops = np.append(starts[1:], n.size) - 1
    own = sizes >> 10 & 1023
    before, after = (sizes[starts] >> 20) + _SEEN, sizes[stops] & 1023
    done = size[heads] - own[heads] - (size[starts] - own[starts])[block_of[heads]]
    ahead = size[stops][block_of[heads]] - size[tails]
    left = np.where(done <= GROW_BYTES, before[block_of[heads]] + done, 0)
    right = np.where(ahead <= GROW_BYTES, after[block_of[heads]] + ahead, 0)
    runs = np.flatnonzero((other | (gap > 5))[starts])
    reach = _sum_runs(before + size[stops] - size[starts] + own[starts] + after, runs)
    run_of = np.cumsum((other | (gap > 5))[starts]) - 1
    wanted = (reach >= least)[run_of[block_of[heads]]]
    return heads[wanted], tails[wanted], left[wanted], right[wanted]


def _lists(column: pa.ListArray) -> tuple[pa.StructArray, list[int]]:
    """The items of all lists on end, and where each list begins and the last ends."""
    sizes = np.diff(column.offsets.to_numpy()) if column.null_count == 0 else column.value_lengths().fill_null(0).to_numpy()
    return column.flatten(), np.append(0, np.cumsum(sizes)).tolist()


def _around(found: DataFrame, slim: DataFrame, mean: int, most: int, least: int) -> DataFrame:
    """(key, n_dup, around): repeated chunks of each document; of each seed that may be part of a passage its first and
    last chunk, and of its first occurrence the id, a digest and the bytes before and after."""
    id_type = found.schema["first_id"].dataType.simpleString()
    place = ["first_key", "first_n", "last_n"]

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asks(rows: pa.Table) -> pa.RecordBatch:
            key, n, sizes, first_key, first_n = (rows[c].to_numpy() for c in ("key", "n", "sizes", "first_key", "first_n"))
            head, tail, before, after = seeds(key, n, sizes, first_key, first_n, least)
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            none = begins.size
            columns = [
                np.append(key[head], key[begins]),
                np.append(n[head], np.full(none, -1)).astype(np.int32),
                np.append(n[tail], np.diff(np.append(begins, key.size))).astype(np.int32),
                np.append(first_key[head], np.zeros(none, np.int64)),
                *(np.append(x, np.zeros(none, np.int32)).astype(np.int32) for x in (first_n[head], first_n[tail], before, after)),
            ]
            ids = rows["first_id"].combine_chunks().take(pa.array(np.append(head, begins)))
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), ids], ["key", "n", "last", *place, "before", "after", "first_id"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # rows of the last document may go on in the next batch
            if whole or (held and held[0].column("key")[0].as_py() != key[0]):
                rows = pa.Table.from_batches([*held, batch.slice(0, whole)])
                if rows.num_rows:
                    yield asks(rows)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield asks(pa.Table.from_batches(held))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            data, first, stop, doc = chunk_ends(part.column("text"), mean, most)
            _, at = _text.text_bytes(part.column("text"))
            begin = np.searchsorted(doc, np.arange(part.num_rows + 1))
            flat, cuts = _lists(part.column("asks"))
            first_n, last_n, before, after = (flat.field(c).to_numpy() for c in ("first_n", "last_n", "before", "after"))
            row = np.repeat(np.arange(part.num_rows), np.diff(cuts))
            lo, hi = first[begin[row] + first_n], stop[begin[row] + last_n]
            left, right, all_bytes = np.maximum(lo - before, at[row]), np.minimum(hi + after, at[row + 1]), data.tobytes()
            spans = list(zip(left.tolist(), lo.tolist(), hi.tolist(), right.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key").take(pa.array(row)),
                    pa.array(first_n),
                    pa.array(last_n),
                    pa.array([_digest(all_bytes[b:c]) for _, b, c, _ in spans], pa.binary()),
                    pa.array([all_bytes[a:b] for a, b, _, _ in spans], pa.binary()),
                    pa.array([all_bytes[c:d] for _, _, c, d in spans], pa.binary()),
                ],
                [*place, "digest", "before", "after"],
            )

    by_doc = found.repartition("key").sortWithinPartitions("key", "n").select("key", "n", "sizes", "first_id", "first_key", "first_n")
    asked = cut(by_doc.mapInArrow(asking, f"key long, n int, last int, first_key long, first_n int, last_n int, before int, after int, first_id {id_type}"))
    seed = asked.filter("n >= 0")
    each = cut(seed.groupBy(place).agg(F.max("before").alias("before"), F.max("after").alias("after")))
    asks = each.groupBy(F.col("first_key").alias("key")).agg(F.collect_list(F.struct("first_n", "last_n", "before", "after")).alias("asks"))
    texts = slim.select("key", "text").join(asks, "key").select("key", "text", "asks")
    answers = texts.mapInArrow(read, "first_key long, first_n int, last_n int, digest binary, before binary, after binary")
    answers = cut(answers.dropDuplicates(place))
    drop(each)
    told = seed.withColumnsRenamed({"before": "left", "after": "right"}).join(answers, place)
    # An answer holds what the longest ask wants; each seed takes what it asked for.
    told = told.withColumn("before", F.expr("substring(before, greatest(length(before) - left, 0) + 1)")).withColumn("after", F.expr("substring(after, 1, right)"))
    told = told.select("key", F.lit(None).cast("long").alias("n_dup"), F.struct("n", "last", "first_id", "digest", "before", "after").alias("one"))
    counts = asked.filter("n < 0").select("key", F.col("last").cast("long").alias("n_dup"), F.lit(None).cast(told.schema["one"].dataType).alias("one"))
    out = cut(told.unionByName(counts).groupBy("key").agg(F.max("n_dup").alias("n_dup"), F.collect_list("one").alias("around")))
    drop(asked, answers)
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean: int = MEAN_BYTES,
    most: int = MAX_BYTES,
    min_run_bytes: int = MIN_RUN_BYTES,
) -> DataFrame:
    """Every row with text_col rid of passages that occurred before.

    Adds n_chunks, n_dup_chunks (that occurred before), n_removed_bytes (long),
    removed (array of struct start, end: bytes of the old text) and first_ids
    (ids that hold the first occurrences of what was removed), in place of
    columns so named; the rest passes through. Null and empty texts have no
    chunks and stay as they are. Rows that agree in id and text are one document
    and get the same result, so neither removes the other; a null id is an id
    like others and comes first; of equal ids (ties) the row with the lesser hash
    of id and text is the earlier one. Very long texts are chunked whole. A text
    may end up empty; its row stays. No rows give no rows.
    """
    new = ["n_chunks", "n_dup_chunks", "n_removed_bytes", "removed", "first_ids"]
    keep = [c for c in docs.columns if c not in (text_col, *new)]
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(*keep).alias("row"), text.alias("text"), row_key(id_col, text_col).alias("key"))
    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    found = repeated_chunks(chunk_digests(slim, mean, most))
    rows = keyed.join(_around(found, slim, mean, most, min_run_bytes), "key", "left")
    id_type = docs.schema[id_col].dataType
    ids = T.ArrayType(id_type)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["row"], rows.schema["text"], *(T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.LongType(), spans, ids), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            texts = part.column("text")
            data, first, ends, doc = chunk_ends(texts, mean, most)
            _, at = _text.text_bytes(texts)
            begin = np.searchsorted(doc, np.arange(part.num_rows + 1))
            flat, cuts = _lists(part.column("around"))
            told = list(zip(*(flat.field(c).to_pylist() for c in ("n", "last", "first_id", "digest", "before", "after")), strict=True))
            n_dup, all_bytes = part.column("n_dup").fill_null(0).to_pylist(), data.tobytes()
            out: dict[str, list] = {n: [] for n in ("text", *new)}
            for row in range(part.num_rows):
                lo, hi = begin[row], begin[row + 1]
                gone, held = [], []
                value = texts[row].as_py()
                if cuts[row] < cuts[row + 1]:
                    own = all_bytes[at[row] : at[row + 1]]
                    places = (first[lo:hi] - at[row]).tolist(), (ends[lo:hi] - at[row]).tolist()
                    gone, held = _passages(own, *places, told[cuts[row] : cuts[row + 1]], min_run_bytes)
                    value = _without(own, gone) if gone else value
                for n, v in zip(out, (value, int(hi - lo), n_dup[row], sum(e - s for s, e in gone), [{"start": s, "end": e} for s, e in gone], held), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.list_(flat.field("first_id").type)), strict=True))],
                ["row", "text", *new],
            )

    done = rows.select("row", "text", "n_dup", "around").mapInArrow(run, schema)
    return done.select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns if c not in new), *new)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _equal(a: bytes, b: bytes) -> int:
    """How many first bytes agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def _passages(data: bytes, first: list[int], ends: list[int], told: list[tuple], least: int) -> tuple[list[tuple[int, int]], list]:
    """Spans of grown seeds that touch, of at least so many bytes, and the ids that hold them; no character is split.

    A seed is told as its first and last chunk, and of its first occurrence the id, a digest and the bytes around it.
    """
    spans: list[tuple[int, int, set]] = []
    for n, last, first_id, digest, before, after in told:
        start, end = first[n], ends[last]
        if digest != _digest(data[start:end]):
            continue
        start -= _equal(data[max(0, start - len(before)) : start][::-1], before[::-1])
        end += _equal(data[end : end + len(after)], after)
        while data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        spans.append((start, end, {first_id}))
    gone, held, run = [], set(), None
    for start, end, ids in [*sorted(spans, key=lambda x: x[:2]), (len(data) + 1, 0, set())]:
        if run and start <= run[1]:
            run = (run[0], max(run[1], end), run[2] | ids)
            continue
        if run and run[1] - run[0] >= least:
            gone.append(run[:2])
            held |= run[2]
        run = (start, end, ids)
    return gone, sorted(held, key=lambda v: (v is not None, v))


def _without(data: bytes, gone: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in gone:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]).decode()
