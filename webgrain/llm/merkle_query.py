"""The query op12 and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import merkle
from webgrain.llm._spark import read_table
from webgrain.llm.spelling_query import CRC_TABLE_SQL, crc32_sql

#: Rows are tampered with where this number divides the checksum of their id.
DIVISOR = 7


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")

    def leaf(n_chars: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string")) % DIVISOR == 0
    rows = docs.select(
        "doc_id",
        "lang",
        leaf(F.col("n_chars")).alias("own"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)).alias("claimed"),
    )
    made = merkle.manifest(rows.select("doc_id", "claimed", "lang", "own"), F.col("lang"), F.col("doc_id"), F.col("own"))
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_CRC = crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))")


def _tree(name: str, leaves: str) -> str:
    """Recursive tables of all nodes (grp, level, idx, node, n) over leaves (grp, idx, node, n)."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, idx, node, n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), any_value((n + 1) // 2) FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 2
)"""


def _steps(nodes: str, leaves: str) -> str:
    """Per leaf its siblings from level 0 up, as a list; where a node is alone, an empty text."""
    return f"""SELECT l.grp, l.idx, list({{'left': a.idx % 2 = 1, 'node': coalesce(b.node, '')}} ORDER BY a.level) FILTER (a.level IS NOT NULL) AS steps
  FROM {leaves} l LEFT JOIN {nodes} a ON a.grp = l.grp AND a.idx = l.idx >> a.level AND a.n > 1
  LEFT JOIN {nodes} b ON b.grp = a.grp AND b.level = a.level AND b.idx = xor(a.idx, 1) GROUP BY l.grp, l.idx"""


OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '-') AS grp, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS other, doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_CRC} % {DIVISOR} = 0 AS tampered
  FROM documents, {CRC_TABLE_SQL}
), l AS MATERIALIZED (
  SELECT row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS node, count(*) OVER (PARTITION BY grp) AS n, * EXCLUDE (leaf) FROM d
), {_tree("nodes", "l")}, nodes_m AS MATERIALIZED (SELECT * FROM nodes),
t AS MATERIALIZED (SELECT 'all' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, node, count(*) OVER () AS n, grp AS of_grp FROM nodes_m WHERE n = 1),
{_tree("over", "t")}, over_m AS MATERIALIZED (SELECT * FROM over),
low AS ({_steps("nodes_m", "l")}), high AS ({_steps("over_m", "t")}),
p AS (
  SELECT l.doc_id, l.node AS leaf, t.node AS subroot, (SELECT node FROM over_m WHERE n = 1) AS root,
    coalesce(low.steps, []) || coalesce(high.steps, []) AS steps, CASE WHEN tampered THEN other ELSE l.node END AS claimed
  FROM l JOIN low USING (grp, idx) JOIN t ON t.of_grp = l.grp JOIN high ON high.idx = t.idx
), f AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.node), '')) AS proof_sha256,
    list_reduce(list_prepend({{'left': false, 'node': claimed}}, steps), lambda a, s: {{'left': false, 'node': sha256(CASE WHEN s.left THEN s.node || a.node ELSE a.node || s.node END)}}).node AS folded_root
  FROM p
)
SELECT *, folded_root = root AS verified FROM f
"""
