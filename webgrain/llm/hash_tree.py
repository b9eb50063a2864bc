"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws one number for each child of the node it stands at,
-ln(u) / weight with u from a hash of the row's key and the child's path, and
goes to the child with the smallest. A draw depends on its own child alone, so
when weights change, rows move only into subtrees whose weight rose or out of
subtrees whose weight fell; the others keep what they have. A shard that joins
later opens a region of its own, so it takes rows only into itself and no two
old shards swap rows.

The draws are native expressions. Slots are numbered without a global sort and
without one window for each shard: each input partition numbers its own rows by
shard, and offsets come from the counts by partition and shard.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm._spark import cut


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The tree of so many shards of weight 1.

    The first `base` fill regions of racks * per_rack shards; every later one is
    a region of its own. The tree of n + 1 shards is thus the tree of n with one
    more region, for every n.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    size, full = racks * per_rack, min(shards, base)
    out = [Shard(i // size, i % size // per_rack, i) for i in range(full)]
    regions = out[-1].region + 1
    return out + [Shard(regions + i - full, 0, i) for i in range(full, shards)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash of key and path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def _choose(key: Column, children: dict[str, list[Shard]], leaf: bool) -> Column:
    """The path of the child with the least draw, or its shard at the last level; ties go to the lesser."""
    draws = [
        F.struct(
            _draw(key, path, sum(s.weight for s in below)).alias("draw"),
            F.lit(below[0].shard if leaf else path).alias("child"),
        )
        for path, below in children.items()
    ]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["child"]


def assign(df: DataFrame, tree: list[Shard], id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """Each row with its shard, beside all its columns (one named shard_col is replaced).

    Only the draws of the nodes on a row's way are computed. Rows with equal ids
    share a shard; rows with a null id share one too. An empty table stays empty.
    """
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a tree needs shards, with weights above 0; leave a shard out to empty it")
    key, nodes = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), {"": list(tree)}
    df = df.withColumn("_node", F.lit(""))
    for level in range(3):
        below: dict[str, list[Shard]] = {}
        steps = []
        for path, part in nodes.items():
            children: dict[str, list[Shard]] = {}
            for s in part:
                children.setdefault(f"{path}/{s[level]}", []).append(s)
            below |= children
            steps.append((path, _choose(key, children, level == 2)))
        at = F.coalesce(*(F.when(F.col("_node") == path, step) for path, step in steps))
        df, nodes = df.withColumn("_node" if level < 2 else shard_col, at.cast("string" if level < 2 else "int")), below
    return df.drop("_node")


def with_slots(df: DataFrame, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Each row with a slot: the rows of a shard count from 0 without a gap.

    df should be slim: it is written to the shared folder once, so that counts
    and numbers come from the same rows in the same places. The windows are by
    (input partition, shard), hence at most one partition's rows; only the counts by
    partition and shard are summed along the partitions. Repeated rows get slots of
    their own.
    """
    place = F.monotonically_increasing_id()
    placed = cut(df.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)))
    counts = placed.groupBy(shard_col, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard_col, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard_col, "_part").orderBy("_place")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [shard_col, "_part"]).select(
        *(c for c in df.columns if c != slot_col), (F.col("_before") + F.col("_at")).cast("long").alias(slot_col)
    )


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt to shards 0 to shards - 1 by id, as slim rows.

    Returns id_col, size (UTF-8 bytes of the text plus 8; a null text has none),
    text_crc32 (unsigned; a null text counts as empty), shard, slot and
    grown_shard, the shard if there were one more.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slim = assign(slim, topology(shards), id_col)
    return with_slots(assign(slim, topology(shards + 1), id_col, "grown_shard"))
