"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

Every prefix of a piece of text has exactly one BPE encoding, and that is fixed
by its last token: the encoding of the prefix is the encoding of what stands
before that token, then the token. So one table holds, for each byte prefix,
its last token. A token that ends at a prefix is the right one if plain BPE
would keep it apart from the last token of the prefix before it; whether two
neighbouring tokens stay apart is decided from the two tokens alone.

The table allows exact appends (earlier entries never change) and re-encoding
near an edit: entries are recomputed from the edit until as many entries in a
row as the longest token has bytes agree with the old ones.

On Spark: a batch of whole texts goes through Arrow to a task, which keeps a
cache bounded in bytes of the pieces it has seen. The rank file (its size is checked) is
read by the driver and broadcast. There is no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgrain.llm import _text

#: The rank file is broadcast; a larger one is refused.
MAX_RANK_FILE_BYTES = 64 << 20
#: Bytes of pieces and ids that a task's cache holds, and entries of its table of token pairs; a full one is emptied.
MAX_CACHE_BYTES, MAX_PAIRS = 64 << 20, 100_000
#: What an entry costs beside its bytes, and pieces that are looked up at once.
_ENTRY_BYTES, _AT_ONCE = 200, 1 << 14


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token, from the lines of a rank file: the token in base64, its rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(word): int(rank) for word, rank in pairs}


class PrefixBPE:
    """Encodes pieces of bytes by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, {missing[0]} for one")
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[tuple[bytes, int, int]]] = {}
        self._right: dict[int, list[tuple[bytes, int, int]]] = {}
        self._apart: dict[int, bool] = {}
        #: Every end of a token: its rank, or -1 if that end is no token itself.
        self._ends: dict[bytes, int] = {b[k:]: -1 for b in ranks for k in range(1, len(b))} | ranks

    @classmethod
    def from_rank_file(cls, data: bytes) -> PrefixBPE:
        return cls(read_ranks(data))

    def _halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte."""
        if t not in self._parts:
            whole = self.token[t]
            parts = [bytes([b]) for b in whole]
            while len(parts) > 2:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < t]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._parts[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._parts[t]

    def _edge(self, t: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of t while BPE builds it: bytes, the rank that makes them, the rank that ends them."""
        kept = self._right if side else self._left
        if t not in kept:
            out, now, until = [], t, 1 << 62
            while True:
                halves = self._halves(now)
                out.append((self.token[now], now if halves else -1, until))
                if not halves:
                    break
                now, until = halves[side], now
            kept[t] = out
        return kept[t]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b, put together, gives a and then b.

        While both are built, an edge of a and an edge of b meet for a time. BPE
        takes the lowest rank first and of equal ranks the leftmost, so a merge
        over the border happens if its rank comes before both edges end.
        """
        for x, made_x, end_x in self._edge(a, 1):
            for y, made_y, end_y in self._edge(b, 0):
                if made_x < end_y and made_y < end_x:
                    r = self.ranks.get(x + y)
                    if r is not None and r < end_x and r <= end_y:
                        return False
        return True

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fill the table from where it ends: last[i] is the last token of the first i bytes (last[0]: -1)."""
        ends, known = self._ends.get, self._apart
        for i in range(len(last), (len(piece) if upto is None else upto) + 1):
            for j in range(i - 1, -1, -1):
                t = ends(piece[j:i])
                if t < 0:
                    continue
                if j == 0:
                    last.append(t)
                    break
                pair = last[j] << 32 | t
                keep = known.get(pair)
                if keep is None:
                    if len(known) >= MAX_PAIRS:
                        known.clear()
                    keep = known[pair] = self.apart(last[j], t)
                if keep:
                    last.append(t)
                    break
        return last

    def read(self, last: list[int]) -> list[int]:
        """The tokens of the whole piece, from the table."""
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.token[last[i]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read(self.extend(piece, [-1]))


class PieceTable:
    """The prefix table of one piece, kept for appends and edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, bpe.extend(piece, [-1])
        #: Entries computed so far, to see what an edit costs.
        self.computed = len(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)
        self.computed += len(more)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put new in place of the bytes from start to stop."""
        if not 0 <= start <= stop <= len(self.piece):
            raise ValueError("start and stop must lie in the piece, in order")
        old, shift = self.last, start + len(new) - stop
        self.piece = self.piece[:start] + new + self.piece[stop:]
        table, same, i = old[: start + 1], 0, start
        while i < len(self.piece):
            i += 1
            self.bpe.extend(self.piece, table, i)
            self.computed += 1
            same = same + 1 if i - shift > stop and old[i - shift] == table[i] else 0
            if same >= self.bpe.longest:
                table += old[i - shift + 1 :]
                break
        self.last = table

    def tokens(self) -> list[int]:
        whole = self.bpe.ranks.get(self.piece)
        return [whole] if whole is not None else self.bpe.read(self.last)


@functools.cache
def _ranges(kind: str) -> str:
    """16-bit characters of a general category (L, N) or white space, as ranges inside a class of the re module."""
    if kind == "s":
        inside = [bool(regex.fullmatch(r"\p{White_Space}", chr(c))) for c in range(0x3100)]
    else:
        inside = [unicodedata.category(chr(c))[0] == kind for c in range(0x10000)]
    out, start = [], None
    for c, yes in enumerate([*inside, False]):
        if yes and start is None:
            start = c
        elif not yes and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""A function that gives all matches of the pattern; \s and \S mean Unicode's White_Space.

    The re module splits several times faster than regex but has no \p{..};
    so \p{L}, \p{N} and \s become ranges. Texts with characters beyond the
    16-bit plane, and other patterns, go to regex.
    """
    whole = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    if re.search(r"\\[pP](?!\{[LN]\})|\\[PwWdDbBXR]|\[[^\]]*\\S", pattern):
        return whole.findall
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if part[:2] in (r"\p", r"\s", r"\S"):
            chars = _ranges(part[3] if part[:2] == r"\p" else "s")
            out.append(f"[^{chars}]" if part == r"\S" else chars if inside else f"[{chars}]")
        else:
            inside = (inside or part == "[") and part != "]"
            out.append(part)
    fast, beyond = re.compile("".join(out)), re.compile("[\U00010000-\U0010ffff]")
    return lambda text: whole.findall(text) if beyond.search(text) else fast.findall(text)


class PieceCache:
    """Ids of pieces, as bytes. Bounded in bytes, but for the pieces looked up at once."""

    def __init__(self, bpe: PrefixBPE, most: int = MAX_CACHE_BYTES):
        self.bpe, self.most, self.size, self.known = bpe, most, 0, {}

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for at in range(0, len(pieces), _AT_ONCE):
            some = pieces[at : at + _AT_ONCE]
            if self.size > self.most:
                self.known.clear()
                self.size = 0
            for piece in set(some).difference(self.known):
                ids = np.array(self.bpe.encode_piece(piece.encode()), dtype="<u4").tobytes()
                self.known[piece] = ids
                self.size += len(piece) + len(ids) + _ENTRY_BYTES
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)


#: The vocabulary that a worker has read last; it holds no texts and does not grow with them.
_READ: dict[str, PrefixBPE] = {}


def _loaded(data: bytes) -> PrefixBPE:
    key = hashlib.sha256(data).hexdigest()
    if key not in _READ:
        _READ.clear()
        _READ[key] = PrefixBPE.from_rank_file(data)
    return _READ[key]


def token_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The bytes of each token by its rank; None where there is none."""
    table = np.full(max(ranks.values()) + 1, None, dtype=object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _decoded(table: np.ndarray, ids: bytes) -> bytes:
    return b"".join(table[np.frombuffer(ids, "<u4")].tolist())


def _broadcast_ranks(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{rank_file} holds over {MAX_RANK_FILE_BYTES} bytes; it is not broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(
    df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """Each row with the token ids of its whole text instead of the text.

    ids_col is binary: ids as little-endian unsigned 32-bit integers, in order.
    With decoded_col, the ids are decoded again in the same task, as decode does.
    The other columns pass through; one that is named like a new one is replaced.
    A null text counts as empty and gives no ids; a very long one is encoded in a
    batch of its own. Repeated rows and rows with a null id each give a row; no
    rows give no rows. The cache of pieces belongs to a task and ends with it.
    """
    sent = _broadcast_ranks(df, rank_file)
    new = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    keep = [c for c in df.columns if c not in (text_col, *new)]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.BinaryType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        cache, find = PieceCache(bpe), splitter(pattern)
        table = token_table(bpe.ranks) if decoded_col is not None else None
        for batch in _text.slices(batches, text_col):
            out = [cache.ids(find(text.as_py() or "")) for text in batch.column(text_col)]
            made = [pa.array(out, pa.binary())]
            if table is not None:
                made.append(pa.array([_decoded(table, ids) for ids in out], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *new])

    return df.select(*keep, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Each row with the bytes that its ids stand for, beside all its columns.

    Null ids give null bytes. An id outside the vocabulary raises an error. A
    column named like bytes_col is replaced; no rows give no rows.
    """
    sent = _broadcast_ranks(df, rank_file)
    keep = [c for c in df.columns if c != bytes_col]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(read_ranks(sent.value))
        for batch in _text.slices(batches, ids_col):
            out = [None if ids is None else _decoded(table, ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, bytes_col])

    return df.mapInArrow(run, schema)
