"""Near duplicates by a grouped prefix join on word n-grams.

Two texts link if the Jaccard similarity of their sets of distinct word n-grams
reaches a threshold; the result is the connected components of these links.

1. Texts with the same set become one node.
2. A fixed order puts frequent n-grams last. Of nodes that link, the first
   n - ceil(t * n) + 1 n-grams of each share one (the prefix filter). The order
   need not be exact for that: n-grams of rare words come first, then those of
   frequent words, and last the most frequent n-grams themselves.
3. Nodes with the same prefix and size collapse into one group.
4. Group pairs that share a prefix n-gram are filtered by size and position,
   expanded to their members, and each member pair is verified on whole sets.

Many near copies would give all pairs of a large group. So verification goes in
rounds. First, each node is verified against one: the least node that stands in
a list with it. Then each component against several nodes of its lists, the
least by different hashes. Then only pairs across the components found so far are left; lists
inside one component are done.

A list that many components share (a passage that thousands of texts quote)
would still give all pairs of them. There, the hash range is cut into more parts
than two linking sets of that size have differences, so they agree on a part as
a whole: only nodes that agree on one are paired. No candidate is dropped: every
linking pair is either verified or already connected.

N-grams are 64-bit hashes. Sets stay where the text is; only nodes that occur in
a pair send theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm import _text
from webgrain.llm._spark import cut, drop, few, row_key
from webgrain.llm.components import components

#: The n-grams that the order puts last, and the words whose frequency it knows, at most: 16 bytes each are broadcast.
FREQUENT = 1 << 18
#: Lists whose pairs outnumber so many times the rows of their parts are paired by parts.
BY_PARTS = 4
#: Partners that each component tries in the second round, each by another order of nodes.
PARTNERS = 12
#: Words of 64 bits in a set's sketch: a bit for each part of the hash range, set where the part holds an odd number of
#: n-grams. Bits in which two sketches differ are no more than the n-grams in which the sets differ.
SKETCH = 8
#: Words of the folded sketch that rows of lists carry: words of the whole one, added bit by bit.
FOLDED = [f"fold_{k}" for k in range(4)]
#: So many rows are sketched at once.
SKETCHED = 1 << 10
#: A task sums this many n-grams before it says which of them occur in MIN_SEEN texts or more.
GATHER, MIN_SEEN = 1 << 21, 4

_U = np.uint64


def lower_words(texts: pa.Array) -> _text.Words:
    return _text.words(texts, _text.NOT_SPACE, lower=True)


def shingle_sets(texts: pa.Array, width: int, found: _text.Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct word n-grams, by text and hash; fewer words than width are one n-gram. found: the texts' words."""
    found = found or lower_words(texts)
    hashed, first = _text.windows(found.hash, found.doc, width)
    doc = found.doc[first]
    n_words = np.bincount(found.doc, minlength=len(texts))
    for size in range(1, width):
        short = np.flatnonzero(n_words == size)
        if short.size:
            at = np.cumsum(n_words)[short] - size
            whole = _text.mix(np.full(short.size, size, dtype=_U))
            for k in range(size):
                whole = _text.join_hash(whole, found.hash[at + k])
            hashed, doc = np.concatenate([hashed, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.ones(hashed.size, dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    return hashed[new], doc[new]


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n n-grams are the prefix: n - ceil(percent * n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


class Order(NamedTuple):
    """Hashes, sorted, of frequent n-grams and words, and the rank of each; others have rank 0."""

    grams: np.ndarray
    gram_ranks: np.ndarray
    words: np.ndarray
    word_ranks: np.ndarray

    def ranks(self, found: _text.Words, grams: np.ndarray, width: int) -> np.ndarray:
        """The rank of each of the n-grams, given the words of the texts that hold them."""
        hashed, first = _text.windows(found.hash, found.doc, width)
        own = _look_up(self.words, self.word_ranks, found.hash)
        sums = np.zeros(first.size, dtype=np.int64)
        for k in range(width):
            sums += own[first + k]
        distinct, at = np.unique(hashed, return_index=True)
        rank = _look_up(distinct, sums[at], grams)
        top = _look_up(self.grams, self.gram_ranks, grams)
        return np.where(top > 0, top + (64 * width << 2), rank)


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not keys.size:
        return np.zeros(asked.size, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, asked), keys.size - 1)
    return np.where(keys[at] == asked, values[at], 0)


def global_order(docs: DataFrame, width: int, most: int = FREQUENT, text_col: str = "text") -> Order:
    """The order of n-grams, from estimates of how often n-grams and words occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, list] = ([], [])
        size = 0

        def seen() -> Iterator[pa.RecordBatch]:
            for of_words, parts in enumerate(kept):
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                often = n >= MIN_SEEN
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), of_words, dtype=bool)), _text.signed(keys[often]), pa.array(n[often])], ["word", "k", "n"])
                parts.clear()

        for part in _text.slices(batches, text_col):
            found = lower_words(part.column(text_col))
            kept[0].append(shingle_sets(part.column(text_col), width, found)[0])
            kept[1].append(found.hash)
            size += kept[1][-1].size
            if size >= GATHER:
                yield from seen()
                size = 0
        if kept[0]:
            yield from seen()

    texts = docs.select(F.col(text_col).cast("string").alias(text_col))
    sums = cut(texts.mapInArrow(run, "word boolean, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n")))
    out = []
    for of_words in (False, True):
        top = sums.filter(F.col("word") == of_words).orderBy(F.desc("n"), "k").limit(most).toArrow()
        keys, n = top["k"].to_numpy().view(_U), top["n"].to_numpy()
        by_key = np.argsort(keys)
        rank = 1 + np.floor(4 * np.log2(n)).astype(np.int64) if of_words else np.arange(len(keys), 0, -1, dtype=np.int64)
        out += [keys[by_key], rank[by_key]]
    drop(sums)
    return Order(*out)


def _documents(docs: DataFrame, width: int, percent: int, order_of: Order) -> DataFrame:
    """(id, key, node, n, prefix, sketch) of each row of (id, key, text); node is a hash of the set, null if it is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(order_of)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", rows=SKETCHED):
            rows, found = part.num_rows, lower_words(part.column("text"))
            hashed, doc = shingle_sets(part.column("text"), width, found)
            n = np.bincount(doc, minlength=rows)
            node = np.zeros(rows, dtype=_U)
            np.add.at(node, doc, _text.mix(hashed ^ _U(0x5851F42D4C957F2D)))
            node = _text.mix(node + n.astype(_U))
            rank = sent.value.ranks(found, hashed, width)
            order = np.lexsort((hashed, rank, doc))
            place = np.arange(hashed.size) - np.repeat(np.cumsum(n) - n, n)
            size = np.where(100 * n >= percent * (n + 1), prefix_size(n, percent), 0)
            taken = order[place < size[doc]]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            bit = doc * (SKETCH * 64) + (_text.mix(hashed ^ _U(0x1D8E4E27C47D124F)) >> _U(64 - (SKETCH * 64).bit_length() + 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=rows * SKETCH * 64) & 1).astype(np.uint8)
            sketch = np.packbits(odd, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("key"),
                    pa.array(node.view(np.int64), mask=n == 0),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), _text.signed(hashed[taken])),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * SKETCH, SKETCH, dtype=np.int32)), pa.array(sketch)),
                ],
                ["id", "key", "node", "n", "prefix", "sketch"],
            )

    return docs.mapInArrow(run, f"id {id_type}, key long, node long, n long, prefix array<long>, sketch array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, grams) of the nodes (node, key), from the texts with these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            hashed, doc = shingle_sets(part.column("text"), width)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), _text.signed(hashed))], ["node", "grams"])

    found = docs.select("key", "text").join(few(nodes), "key").select("node", "text")
    return found.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def _may_link(x: list[Column], y: list[Column], sizes: Column, percent: int) -> Column:
    """Whether two sets, by the words of their sketches and the sum of their sizes, may reach the threshold; true where a word is null."""
    bits = reduce(lambda a, b: a + b, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y, strict=True)))
    return F.coalesce((100 + percent) * bits <= (100 - percent) * sizes, F.lit(True))


def _folds(p: str, q: str, percent: int) -> Column:
    """_may_link of two aliased rows with folded sketches."""
    words = ([F.col(f"{s}.{c}") for c in FOLDED] for s in (p, q))
    return _may_link(*words, F.col(f"{p}.n") + F.col(f"{q}.n"), percent)


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes that reach the threshold.

    Sketches discard pairs that differ too much; the rest is verified on whole
    sets.
    """
    side = lambda s, c: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(c))
    near = cut(pairs.distinct()).join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = cut(near.filter(_may_link(*([F.get(c, F.lit(k)) for k in range(SKETCH)] for c in ("x", "y")), F.col("n_a") + F.col("n_b"), percent)).select("a", "b"))
    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = cut(_sets(docs, nodes.select("node", "key").join(wanted, "node"), width))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"
    )
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    links = cut(shared.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b"))
    drop(pairs, wanted, sets)
    return links


def part_number(band: int, percent: int) -> int:
    """More parts than a set of this size band and a larger one that links with it have differences."""
    t = percent / 100
    return int(np.ceil(np.exp((band + 1) * _band_width(percent)) * (1 - t) / t)) + 2


def _band_width(percent: int) -> float:
    """A little wider than log(1 / t): sizes of two linking sets lie in the same band or in neighbours."""
    return max(-float(np.log(percent / 100)), 1e-6) * 1.000001


def _parts_of(band: Column, percent: int) -> Column:
    """part_number of a column of bands."""
    return F.ceil(F.exp((band + 1) * _band_width(percent)) * (1 - percent / 100) / (percent / 100)) + 2


def _parts(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, band, part, sign): a hash of what each set has in each part, for the nodes (node, key, band) and their band's number of parts.

    A set with something in more parts than it can differ in from a set that it links with
    agrees with that one on a part that is not empty, so its empty parts are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            hashed, doc = shingle_sets(part.column("text"), width)
            number = np.array([part_number(b, percent) for b in part.column("band").to_pylist()], dtype=np.int64)
            first = np.cumsum(number) - number
            at = first[doc] + ((hashed >> _U(32)) * number[doc].astype(_U) >> _U(32)).astype(np.int64)
            sign = np.zeros(int(number.sum()), dtype=_U)
            np.add.at(sign, at, _text.mix(hashed ^ _U(0x2545F4914F6CDD1D)))
            owner = np.repeat(np.arange(part.num_rows), number)
            filled = np.zeros(sign.size, dtype=bool)
            filled[at] = True
            enough = np.bincount(owner[filled], minlength=part.num_rows) > number - 2
            sent = filled | ~enough[owner]
            place, rows = (np.arange(sign.size) - np.repeat(first, number))[sent], pa.array(owner[sent])
            yield pa.RecordBatch.from_arrays([part.column("node").take(rows), part.column("band").take(rows), pa.array(place.astype(np.int32)), _text.signed(sign[sent])], ["node", "band", "part", "sign"])

    found = docs.select("key", "text").join(few(nodes), "key").select("node", "band", "text")
    return found.mapInArrow(run, "node long, band int, part int, sign long")


def all_equal(p: str, q: str, *columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{p}.{c}") == F.col(f"{q}.{c}") for c in columns))


def _across(entries: DataFrame, placed: DataFrame, own: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): candidate pairs of nodes across components, from list entries (gram, band, grp, comp, n, place, folded sketch of a lone node).

    a is the smaller set, or the lesser node of equal ones; b stands in the same band or the next.
    """
    counted = entries.groupBy("gram", "band").agg(F.count("*").alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    met_by = F.explode(F.array(F.struct(F.col("band").alias("cell"), F.col("k").alias("nx")), F.struct((F.col("band") - 1).alias("cell"), F.lit(0).cast("long").alias("nx"))))
    cells = counted.select("gram", "k", "low", "high", met_by.alias("c")).groupBy("gram", "c.cell").agg(F.sum("c.nx").alias("nx"), F.sum("k").alias("ny"), F.min("low").alias("low"), F.max("high").alias("high"))
    parts = _parts_of(F.col("cell"), percent)
    is_long = F.col("nx").cast("double") * F.col("ny") > BY_PARTS * (F.col("nx") + F.col("ny")) * parts
    cells = cut(cells.filter("low < high AND nx > 0").select("gram", "cell", is_long.alias("long_list")))
    x = entries.withColumn("cell", F.col("band"))
    y = entries.withColumn("cell", F.explode(F.array(F.col("band"), F.col("band") - 1)))

    # Short lists: all pairs that size, position and sketches let pass.
    short, long = cells.filter("NOT long_list").select("gram", "cell"), cells.filter("long_list").select("gram", "cell")
    p, q = x.join(short, ["gram", "cell"]).alias("p"), y.join(short, ["gram", "cell"]).alias("q")
    left = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    ordered = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.comp") < F.col("q.comp")))
    fits = (100 * F.col("p.n") >= percent * F.col("q.n")) & ((100 + percent) * left >= percent * (F.col("p.n") + F.col("q.n")))
    fits = fits & _folds("p", "q", percent) & (F.col("p.comp") != F.col("q.comp"))
    lone = F.col(f"p.{FOLDED[0]}").isNotNull() & F.col(f"q.{FOLDED[0]}").isNotNull()
    met = p.join(q, all_equal("p", "q", "gram", "cell") & ordered & fits)
    met = cut(met.select(lone.alias("lone"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "pq" for c in ("grp", "comp", "rep"))))
    groups = met.filter("NOT lone").drop("lone", "rep_p", "rep_q").distinct()
    # Members of one group that the earlier rounds left in several components; many of them go by parts too.
    halves = placed.select("grp", "comp", "n").distinct()
    band = F.floor(F.log("n") / _band_width(percent)).cast("int")
    mixed = halves.groupBy("grp").agg(F.count("*").alias("comps"), F.min("n").alias("n")).filter("comps > 1").withColumn("band", band)
    mixed = cut(mixed.withColumn("long_group", F.col("comps") > 2 * BY_PARTS * _parts_of(F.col("band"), percent)))
    few_halves = cut(halves.join(mixed.filter("NOT long_group").select("grp"), "grp"))
    within = few_halves.alias("p").join(few_halves.alias("q"), (F.col("p.grp") == F.col("q.grp")) & (F.col("p.comp") < F.col("q.comp")))
    within = within.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "pq" for c in ("grp", "comp")))
    groups = cut(groups.unionByName(within.select(*groups.columns)))
    side = lambda s, name: placed.select(F.col("grp").alias(f"grp_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("node").alias(name), "n", *FOLDED)
    first, second = groups.join(side("p", "a"), ["grp_p", "comp_p"]).alias("l"), side("q", "b").alias("r")
    pairs = first.join(second, all_equal("l", "r", "grp_q", "comp_q") & _folds("l", "r", percent)).select("a", "b")
    pairs = pairs.unionByName(met.filter("lone").select(F.col("rep_p").alias("a"), F.col("rep_q").alias("b")))

    # Long lists and groups: pairs that agree on a whole part.
    long_groups = mixed.filter("long_group").select("grp", "band")

    def asked(entry: DataFrame) -> DataFrame:
        found = entry.join(long, ["gram", "cell"]).select("grp", "comp", F.col("cell").alias("band")).distinct()
        columns = ["node", "comp", "n", "band", *FOLDED]
        rows = found.join(placed, ["grp", "comp"]).select(*columns)
        return cut(rows.unionByName(placed.join(long_groups, "grp").select(*columns)).dropDuplicates(["node", "band"]))

    if long.limit(1).count() or long_groups.limit(1).count():
        sides = [asked(x), asked(y)]
        wanted = sides[0].select("node", "band").union(sides[1].select("node", "band")).distinct()
        signs = cut(_parts(own, nodes.select("node", "key").join(wanted, "node"), width, percent))
        p, q = (part.join(signs, ["node", "band"]).alias(s) for part, s in zip(sides, "pq", strict=True))
        same = all_equal("p", "q", "band", "part", "sign") & _folds("p", "q", percent)
        ordered = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.node") < F.col("q.node")))
        fits = (F.col("p.comp") != F.col("q.comp")) & (100 * F.col("p.n") >= percent * F.col("q.n"))
        pairs = pairs.unionByName(p.join(q, same & ordered & fits).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(gram, grp, rep, n, place, band) of the groups of nodes (grp, node, n, prefix): a row for each n-gram of a group's prefix.

    Sets that link differ little in size, and meet at an n-gram with enough of both left behind it. So a row stays only if
    another of its n-gram may be such a set: by size, that is the row before or after it, and no row meets all others.
    """
    # Members of a group have the same size and prefix: one of them speaks for all.
    groups = nodes.groupBy("grp").agg(F.min("node").alias("rep"), F.min("n").alias("n"), F.first("prefix").alias("prefix"))
    each = groups.select("grp", "rep", "n", F.posexplode("prefix").alias("place", "gram"))
    each = each.select("gram", "grp", "rep", "n", F.col("place").cast("long").alias("place"), F.floor(F.log("n") / _band_width(percent)).cast("int").alias("band"))
    by_size = Window.partitionBy("gram").orderBy("n")
    met = each.withColumns({"below": F.lag("n").over(by_size), "over": F.lead("n").over(by_size)})
    # The next larger set asks least of what is left; of smaller ones some may ask less than the nearest, so their sizes alone count.
    larger = (100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("over"))
    return met.filter((100 * F.col("below") >= percent * F.col("n")) | ((100 * F.col("n") >= percent * F.col("over")) & larger)).drop("below", "over")


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, comp, first) of each row: comp is null where the set is empty, else its component; first is the component's least id."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    own = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_documents(own, width, percent, global_order(docs, width, text_col=text_col)).withColumn("grp", F.xxhash64("n", "prefix")))
    with_prefix = rows.filter("size(prefix) > 0")
    one = with_prefix.select("node", "key", "n", "grp", "sketch").dropDuplicates(["node"])
    folds = {c: reduce(lambda a, b: a.bitwiseXOR(b), (F.get("sketch", F.lit(j)) for j in range(k, SKETCH, len(FOLDED)))) for k, c in enumerate(FOLDED)}
    nodes = cut(one.withColumn("band", F.floor(F.log("n") / _band_width(percent)).cast("int")).withColumns(folds))

    lists = cut(_lists(with_prefix.select("grp", "node", "n", "prefix"), percent))

    # Each group with the least node of its lists; each member with its group's.
    heads = cut(lists.groupBy("gram", "band").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).filter("head < last").select("gram", "band", "head"))
    star = lists.join(heads, ["gram", "band"]).groupBy("rep").agg(F.min("head").alias("head")).filter("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    group_rep = cut(nodes.groupBy("grp").agg(F.min("node").alias("rep"), F.count("*").alias("members")).filter("members > 1").select("grp", "rep"))
    inside = nodes.select("grp", "node").join(group_rep, "grp").filter(F.col("node") != F.col("rep")).select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = _linked(star.unionByName(inside), own, nodes, width, percent)
    known = cut(components(links))

    # Each component with several nodes of its lists.
    def entries_of(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed = cut(nodes.select("grp", "node", "n", *FOLDED).join(known, "node", "left").select("grp", "node", "n", *FOLDED, F.coalesce("label", "node").alias("comp")))
        own_fold = (F.when(F.count("*") == 1, F.min(c)).alias(c) for c in FOLDED)
        cells = cut(placed.groupBy("grp", "comp").agg(F.min("node").alias("rep"), *own_fold))
        return cut(lists.drop("rep").join(cells, "grp")), placed

    entries, placed = entries_of(known)
    least = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("by"), F.lit(k).alias("k"), F.col("rep").alias("head"), F.col("comp").alias("of"))) for k in range(PARTNERS)]
    heads = entries.groupBy("gram", "band").agg(F.array(*least).alias("heads"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    heads = cut(heads.select("gram", "band", F.explode("heads").alias("h")).select("gram", "band", "h.*"))
    more = entries.join(heads, ["gram", "band"]).filter(F.col("comp") != F.col("of"))
    star = more.groupBy("comp", "k").agg(F.min(F.struct("by", "head", "rep")).alias("e"))
    star = star.select(F.least("e.head", "e.rep").alias("a"), F.greatest("e.head", "e.rep").alias("b"))
    links = links.unionByName(_linked(star, own, nodes, width, percent))
    drop(entries, placed, known)
    known = cut(components(links))

    # What is left across components.
    entries, placed = entries_of(known)
    links = _linked(_across(entries, placed, own, nodes, width, percent), own, nodes, width, percent)
    labels = cut(components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)))
    drop(entries, placed, known, lists)

    # The least id of each node, then of each component; both are cut, so hot ones are dealt out anew.
    least = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first")))
    named = cut(least.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"), "first"))
    least = cut(named.groupBy("comp").agg(F.min("first").alias("first")))
    named = cut(named.select("node", "comp").join(least, "comp"))
    return rows.select("id", "key", "n", "node").join(named, "node", "left").select("id", "key", "n", "comp", "first")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs.

    component_id is the least id that a row reaches by links, its own included. A
    null or empty text, or one without words, has no n-grams and links with
    nothing. Rows with equal texts link, repeated rows too. A null id is never the
    least, unless all ids of the component are null. Ids that tie are one id. No
    rows give no rows.
    """
    found = _labelled(docs, width, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with the least id; of repeated rows one stays.

    Of rows that tie, with different texts and the same least id, that with the
    least hash stays. Rows without n-grams are no copies, and repeated ones of
    them are one row too.
    """
    found = cut(_labelled(docs, width, percent, id_col, text_col))
    first = found.filter("comp IS NOT NULL AND id <=> first").groupBy("comp").agg(F.min("key").alias("key"))
    stay = cut(first.select("key").union(found.filter("comp IS NULL").select("key")).groupBy("key").agg(F.count("*").alias("n")))
    several = cut(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")).join(stay.select("key"), "key")
    keyed = docs.withColumn("_key", row_key(id_col, text_col))
    of = lambda keys: few(keys.select(F.col("key").alias("_key")))
    rest = keyed.join(of(stay.join(several, "key", "left_anti")), "_key", "left_semi")
    once = keyed.join(of(several), "_key", "left_semi").dropDuplicates(["_key"])
    return rest.unionByName(once).select(*docs.columns)
