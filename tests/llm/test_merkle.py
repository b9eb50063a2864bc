"""op12: trees and proofs against plain Python, at run and block sizes that force every path."""

import hashlib
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from webgrain.llm import merkle
from webgrain.llm.merkle_query import OP12_SQL, op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The top, and per leaf its steps."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            beside = i ^ 1
            steps[k].append(merkle.ALONE if beside >= len(nodes) else ("R" if beside > i else "L") + nodes[beside])
            at[k] = i // 2
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], steps


def plain_manifest(rows):
    """(group, id, leaf) rows to a sorted list of (id, leaf, subroot, root, proof)."""
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for group in groups:
        own = sorted(((i, leaf) for g, i, leaf in rows if g == group), key=lambda r: (r[0] is not None, r[0], r[1]))
        made[group] = own, *plain_tree([leaf for _, leaf in own])
    root, over = plain_tree([made[g][1] for g in groups])
    return sorted(
        (str(i), leaf, top, root, tuple(way + over[k]))
        for k, (own, top, steps) in enumerate(made[g] for g in groups)
        for (i, leaf), way in zip(own, steps, strict=True)
    )


def rows_of(sizes):
    rows = [(g, i, H(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    return rows + [rows[0]] * 3 + [(rows[0][0], None, H("x")), (rows[0][0], rows[0][1], H("tie"))]


@pytest.mark.parametrize(
    ("sizes", "run_leaves", "stride"),
    [({None: 1}, 4, 2), ({"a": 67, None: 5, "é": 1, "": 33, "b": 2}, 3, 2), ({"a": 130, "b": 16}, 5, 3), ({"g%d" % k: 1 + k % 3 for k in range(40)}, 2, 1), ({"a": 70}, 1000, 12)],
)
def test_manifest_equals_plain_python(spark, sizes, run_leaves, stride):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, "grp string, doc_id long, leaf string").repartition(3)
    out = merkle.manifest(df, F.col("grp"), F.col("doc_id"), F.col("leaf"), run_leaves, stride)
    assert out.columns == ["grp", "doc_id", "leaf", "subroot", "root", "proof"]
    got = out.withColumn("ok", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert all(r["ok"] for r in got)
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in got) == plain_manifest(rows)


def test_all_sizes_of_trees():
    for total in range(1, 40):
        leaves = [H(str(k)) for k in range(total)]
        top, steps = plain_tree(leaves)
        for cut in itertools.chain([()], itertools.combinations(range(1, total), 2)):
            ends = [0, *cut, total]
            runs = [(leaves[a:b], a) for a, b in itertools.pairwise(ends)]
            nodes = {(x, i): d for own, first in runs for x, i, d in merkle.boundary(merkle.run_levels(own, first, total))}
            up = merkle.height(total)
            known = merkle.climb(nodes, up, total)
            assert known[up, 0] == top
            ways = {k: merkle.way_up(known, *k, up, total) for k in nodes}
            assert [w for own, first in runs for w in merkle.run_proofs(own, first, total, ways)] == steps
            if total > 14:
                break


def test_sql_and_odd_rows(spark, tmp_path):
    rows = [(k, f"text {k}", "en" if k % 3 else "fr", "s", k) for k in range(60)]
    rows += [rows[7]] * 4 + [(7, "another text", "en", "s", 7), (8, None, None, None, None), (9, "", "", "", 0), (-5, "é€😀", "dé", "s", None), (None, "no id", "en", "s", 5), (10, "x" * 2_000_000, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_merkle_manifest(spark, str(tmp_path))
    names = sorted(out.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in out.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall()))
    assert {r["verified"] for r in out.select("verified").collect()} == {True, False}


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "x", "y", 5)], "grp string, doc_id long, root string, leaves string, total long")
    out = merkle.manifest(df, F.col("grp"), F.col("doc_id"), F.sha2("root", 256))
    assert out.columns == ["grp", "doc_id", "leaves", "total", "leaf", "subroot", "root", "proof"]
    row = out.first()
    assert row["leaf"] == row["subroot"] == row["root"] == H("x") and row["proof"] == [] and row["leaves"] == "y"
    assert merkle.manifest(df.limit(0), F.col("grp"), F.col("doc_id"), F.sha2("root", 256)).count() == 0
