"""A Merkle manifest of a dataset: one tree per group over range-sorted leaves, one over the groups' roots, proofs for all rows.

1. Leaves are sorted by range over all tasks. Each partition packs its stretch of a
   group into runs, rows of at most RUN_LEAVES leaves in order.
2. The leaf counts of the runs, summed along partitions, give each run its offset
   in its group; only these counts meet in one place, one number for a run.
3. Each run builds all nodes whose leaves it holds whole. The largest of them
   (at most two a level) are its boundary nodes.
4. Boundary nodes are shuffled by coordinate: blocks of 2**STRIDE nodes of a level meet
   and become the node over them, until each group has one node. A block also
   returns the siblings on the way up from each of its nodes.
5. The ways of a run's boundary nodes go back to the run, which finishes the
   proof of each leaf from its own nodes.

No task holds more than one run's leaves or one block's nodes, whatever the sizes of the
groups and however often a key or a whole row repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgrain.llm._spark import cut, drop

#: Most leaves of a run (one row of about 200 bytes for each).
RUN_LEAVES = 1 << 12
#: Levels that one shuffle of boundary nodes climbs.
STRIDE = 12
#: Rows of proofs handed on at once.
PROOF_ROWS = 1 << 10
#: The step of a proof where a node has no sibling.
ALONE = "-"


class Trees(NamedTuple):
    """runs: packed leaves; places: a row for each run with its offset, group size and boundary nodes' ways; tops: (group, top)."""

    runs: DataFrame
    places: DataFrame
    tops: DataFrame


def leaf_digest(*fields: Column) -> Column:
    """sha256 (lowercase hex) of the fields, each "-" if null, else byte count, ":" and the value as text."""
    parts = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return max(0, leaves - 1).bit_length()


def run_levels(leaves: list[str], first: int, total: int) -> list[tuple[int, list[str]]]:
    """For each level (index of the first node, nodes) those whose leaves are all among these, which begin at leaf first of total."""
    levels = [(first, leaves)]
    while total > 1 and levels[-1][1]:
        low, nodes = levels[-1]
        skip, parents = low & 1, []
        for k in range(skip, len(nodes) - 1, 2):
            parents.append(digest(nodes[k], nodes[k + 1]))
        if (len(nodes) - skip) % 2 and low + len(nodes) == total:
            parents.append(digest(nodes[-1]))
        total = (total + 1) // 2
        levels.append(((low + skip) // 2, parents))
    return levels


def boundary(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes without a parent among levels."""
    for level, (low, nodes) in enumerate(levels):
        above_low, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for index in sorted({low, low + len(nodes) - 1}) if nodes else ():  # only the outer ones can be without a parent
            if index // 2 not in range(above_low, above_low + len(above)):
                yield level, index, nodes[index - low]


def step(node: str, index: int) -> str:
    """A sibling in a proof: on which side it stands, and its digest."""
    return ("R" if index & 1 else "L") + node


def _pack(most: int):
    """Sorted rows as runs: lists of at most so many leaves of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None

        def out(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
            nonlocal seq
            table = table.slice(0, ends[-1]).combine_chunks()
            starts = [0, *ends[:-1]]
            leaves = pa.StructArray.from_arrays([_one(table.column("leaf")), _one(table.column("kept"))], names=["leaf", "kept"])
            packed = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ends), pa.int32()),
                    pa.array(range(seq, seq + len(ends)), pa.int64()),
                    _one(table.column("grp")).take(pa.array(starts)),
                    pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), leaves),
                ],
                names=["part", "seq", "grp", "n", "leaves"],
            )
            seq += len(ends)
            return packed

        for batch in batches:
            own = pa.Table.from_batches([batch]).select(["grp", "leaf", "kept"])
            held = own if held is None else pa.concat_tables([held, own])
            if not held.num_rows:
                continue
            group = _one(held.column("grp"))
            changes = pc.indices_nonzero(pc.not_equal(group.slice(1), group.slice(0, len(group) - 1))).to_pylist()
            ends, at = [], 0
            for end in [*(c + 1 for c in changes), held.num_rows]:
                ends += range(at + most, end, most)
                ends.append(end)
                at = end
            ends.pop()  # the last run may go on
            if ends:
                yield out(held, ends)
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield out(held, [held.num_rows])

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


_NODE = "grp string, total long, level int, idx long, digest string, part int, seq long"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        leaves = batch.column("leaves")
        for k, row in enumerate(batch.select(["grp", "total", "first", "part", "seq"]).to_pylist()):
            own = leaves.slice(k, 1).flatten().field("leaf").to_pylist()
            rows += ((row["grp"], row["total"], *node, row["part"], row["seq"]) for node in boundary(run_levels(own, row["first"], row["total"])))
        yield _batch(rows, _NODE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.strip().split(" ") for f in schema.split(","))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


#: way: a block's node has none; the others have the steps up to their block's node (top_level, top_idx).
_CLIMBED = _NODE + ", top_level int, top_idx long, way array<string>"


def climb(nodes: dict[tuple[int, int], str], top: int, total: int) -> dict[tuple[int, int], str]:
    """nodes by (level, index) and all nodes over them up to the level top; nodes that have a node above must all be there."""
    nodes = dict(nodes)
    for level in range(min(x for x, _ in nodes), top):
        count = -(-total >> level)
        for index in sorted({i // 2 for x, i in nodes if x == level}):
            if (level + 1, index) not in nodes:
                below = [nodes[level, i] for i in (2 * index, 2 * index + 1) if i < count]
                nodes[level + 1, index] = digest(*below)
    return nodes


def way_up(nodes: dict[tuple[int, int], str], level: int, index: int, top: int, total: int) -> list[str]:
    """The siblings from a node up to the level top."""
    way = []
    for x in range(level, top):
        beside = index ^ 1
        way.append(step(nodes[x, beside], beside) if beside < -(-total >> x) else ALONE)
        index //= 2
    return way


def _climb_block(block: pa.Table) -> pa.Table:
    rows = block.to_pylist()
    total, top = rows[0]["total"], rows[0]["top_level"]
    known = {(r["level"], r["idx"]): r["digest"] for r in rows}
    nodes = climb(known, top, total)
    at = rows[0]["idx"] >> (top - rows[0]["level"])
    out = [(r["grp"], total, r["level"], r["idx"], r["digest"], r["part"], r["seq"], top, at, way_up(nodes, r["level"], r["idx"], top, total)) for r in rows]
    out.append((rows[0]["grp"], total, top, at, nodes[top, at], None, None, top, at, None))
    return pa.Table.from_batches([_batch(out, _CLIMBED)])


def _trees(rows: DataFrame, run_leaves: int, stride: int) -> Trees:
    """Trees over rows (grp, place, leaf, kept), a tree for each grp."""
    spark = rows.sparkSession
    keys = ["grp", "place", "leaf", "row"]
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // run_leaves))
    packed = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("grp", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("leaf", T.StringType()), rows.schema["kept"]]))),
    ])
    runs = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_pack(run_leaves), packed))
    drop(rows)
    earlier = Window.partitionBy("grp").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    places = cut(runs.select("part", "seq", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("grp")).alias("total")))
    nodes = cut(runs.select("part", "seq", "leaves").join(places, ["part", "seq"]).mapInArrow(_build, _NODE))

    tall = height(places.agg(F.max("total")).first()[0] or 0)
    top_of = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    nodes = nodes.withColumn("height", top_of)
    tops, climbed = [nodes.filter("level = height").select("grp", F.col("digest").alias("top"))], []
    risen = None
    for upto in range(stride, tall + stride, stride):
        met = nodes.filter((F.col("level") < F.col("height")) & (F.col("level") >= upto - stride) & (F.col("level") < upto))
        met = met if risen is None else met.unionByName(risen)
        met = met.withColumn("top_level", F.least("height", F.lit(upto)))
        block = F.expr("shiftright(idx, top_level - level)").alias("block")
        done = cut(met.drop("height").groupBy("grp", block).applyInArrow(_climb_block, _CLIMBED))
        climbed.append(done.filter("way IS NOT NULL"))
        new = done.filter("way IS NULL").drop("top_level", "top_idx", "way").withColumn("height", top_of)
        tops.append(new.filter("level = height").select("grp", F.col("digest").alias("top")))
        risen = new.filter("level < height")
    ways, above = [], None
    for done in reversed(climbed):
        if above is not None:
            over = above.filter("part IS NULL").select("grp", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), F.col("way").alias("further"))
            done = done.join(over, ["grp", "top_level", "top_idx"], "left").withColumn("way", F.concat("way", F.coalesce("further", F.array().cast("array<string>")))).drop("further")
        above = cut(done)
        ways.append(above.filter("part IS NOT NULL").select("part", "seq", F.struct("level", "idx", "way").alias("way")))
    if ways:
        gathered = ways[0]
        for more in ways[1:]:
            gathered = gathered.unionByName(more)
        places = places.join(gathered.groupBy("part", "seq").agg(F.collect_list("way").alias("ways")), ["part", "seq"], "left")
    else:
        places = places.withColumn("ways", F.lit(None).cast("array<struct<level int, idx long, way array<string>>>"))
    every = tops[0]
    for more in tops[1:]:
        every = every.unionByName(more)
    return Trees(runs, places, every)


def run_proofs(leaves: list[str], first: int, total: int, ways: dict[tuple[int, int], list[str]]) -> Iterator[list[str]]:
    """The steps up to the group's top for each leaf of a run; ways: those of its boundary nodes."""
    levels = run_levels(leaves, first, total)
    steps = [[step(node, low + k) for k, node in enumerate(nodes)] for low, nodes in levels]
    for index in range(first, first + len(leaves)):
        way, level, at, count = [], 0, index, total
        while (level, at) not in ways and count > 1:
            beside = at ^ 1
            way.append(steps[level][beside - levels[level][0]] if beside < count else ALONE)
            level, at, count = level + 1, at // 2, (count + 1) // 2
        yield way + ways.get((level, at), [])


def _prove(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["leaves"]).to_pylist()):
                packed = batch.column("leaves").slice(k, 1).flatten()
                leaf, kept = packed.field("leaf"), packed.field("kept")
                ways = {(w["level"], w["idx"]): w["way"] for w in row["ways"] or ()}
                proofs = [way + row["over"] for way in run_proofs(leaf.to_pylist(), row["first"], row["total"], ways)]
                for at in range(0, len(leaf), PROOF_ROWS):
                    own = slice(at, at + PROOF_ROWS)
                    n = len(proofs[own])
                    yield pa.RecordBatch.from_arrays(
                        [*kept[own].flatten(), leaf[own], pa.array([row["top"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string()), pa.array(proofs[own], pa.list_(pa.string()))],
                        names=schema.fieldNames(),
                    )

    return run


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, run_leaves: int = RUN_LEAVES, stride: int = STRIDE) -> DataFrame:
    """rows with leaf, subroot, root and proof: array of steps from the leaf to the root.

    Per group (null first, then bytewise by its text) leaves ascend by order (nulls
    first), then by their digest; two neighbours, or the last one alone, become their
    sha256; the last node left is the group's subroot, and subroots become the
    root likewise. A step is "L" or "R" (the side of the sibling) and its digest, or "-"
    where a node is alone; fold() takes a leaf up a proof. Rows that repeat are leaves
    of their own. No rows give no rows. Columns of rows named as the new ones are
    replaced; give rows without their wide columns, as the others travel along.
    """
    new = ["leaf", "subroot", "root", "proof"]
    kept = [c for c in rows.columns if c not in new]
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = rows.select(named.alias("grp"), order.alias("place"), leaf.alias("leaf"), F.struct(*kept).alias("kept"))
    trees = _trees(leaves, run_leaves, stride)
    tops = cut(trees.tops)
    upper = _trees(tops.select(F.lit("").alias("grp"), F.col("grp").alias("place"), F.col("top").alias("leaf"), F.struct("grp").alias("kept")), run_leaves, stride)
    over = upper.runs.join(upper.places.drop("grp"), ["part", "seq"]).crossJoin(F.broadcast(upper.tops.select(F.col("top").alias("root"))))
    over_schema = T.StructType([T.StructField(c, T.StringType()) for c in ("grp", "top", "subroot", "root")] + [T.StructField("over", T.ArrayType(T.StringType()))])
    over = over.withColumn("over", F.array().cast("array<string>")).withColumn("top", F.lit(""))
    over = over.select("leaves", "first", "total", "ways", "top", "root", "over").mapInArrow(_prove(over_schema), over_schema)
    places = trees.places.join(over.select("grp", "top", "root", "over"), "grp")
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in new[:3]), T.StructField("proof", T.ArrayType(T.StringType()))])
    known = trees.runs.select("part", "seq", "leaves").join(places.drop("grp"), ["part", "seq"])
    return known.select("leaves", "first", "total", "ways", "top", "root", "over").mapInArrow(_prove(schema), schema)


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings, from the leaf up."""
    return F.transform(F.filter(proof, lambda s: s != ALONE), lambda s: F.substring(s, 2, 64))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(node: Column, s: Column) -> Column:
        beside = F.substring(s, 2, 64)
        both = F.when(s == ALONE, node).when(s.startswith("L"), F.concat(beside, node)).otherwise(F.concat(node, beside))
        return F.sha2(both, 256)

    return F.aggregate(proof, leaf, up)
