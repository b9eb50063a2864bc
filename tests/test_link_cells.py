"""Cells that hold JSON lists of links."""

from pyspark.sql import functions as F

from webgrain.functions import contact

CELL = '["instagram.com/a", {"url": "https://x.com/b", "label": " Me "}, {"href": "https://h.org/c", "platform": "Forum"}, {"url": "javascript:1"}, {"label": "none"}, "two words"]'


def ask(spark, use, cell):
    return [tuple(r) for r in spark.createDataFrame([(cell,)], "x string").select(use(F.col("x")).alias("y")).first()["y"]]


def test_links(spark):
    assert ask(spark, contact.social_links, CELL) == [("Instagram", "https://instagram.com/a"), ("Me", "https://x.com/b"), ("Forum", "https://h.org/c")]
    assert ask(spark, contact.contact_links, CELL) == [(None, "https://instagram.com/a"), ("Me", "https://x.com/b"), (None, "https://h.org/c")]


def test_odd_cells(spark):
    for cell in (None, "", "{bad", "a; b", "7", '{"url": "https://x.com"}', "[]"):
        assert ask(spark, contact.social_links, cell) == [] == ask(spark, contact.contact_links, cell)
