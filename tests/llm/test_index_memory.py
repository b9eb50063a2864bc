"""The stored index is written and read a few segments at a time, however many a task makes."""

from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from webgrain.llm import positional_index


def test_row_groups_of_the_index_are_small(spark, monkeypatch):
    kept, cut = [], positional_index.cut
    monkeypatch.setattr(positional_index, "cut", lambda *a, **b: kept.append(cut(*a, **b)) or kept[-1])
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.expr("repeat('abc de ', 300000)"), F.col("id").cast("string")).alias("text"))
    items = spark.createDataFrame([(1, "de 17"), (2, "de 99")], "item_id int, text string")
    found = positional_index.find_contamination(docs, items).filter("n_hit > 0").select("doc_id", "n_words", "n_hit", "items").collect()
    assert [tuple(r) for r in found] == [(17, 600_001, 2, ["1"])]
    files = list(Path(urlparse(kept[0]._cut_path).path).glob("*.parquet"))
    sizes = [m.row_group(k).total_byte_size for m in map(pq.read_metadata, files) for k in range(m.num_row_groups)]
    assert sum(sizes) > 24 * 4e6 and max(sizes) <= 32 << 20
