"""Queries against their SQL, on pages that the given tables hold rarely or not at all."""

import duckdb
import pytest

import __spark_entry__


def assert_equal(spark, folder, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = __spark_entry__.queries()[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


@pytest.mark.parametrize("name", ["business_name", "business_name_resolved"])
def test_a_part_that_repeats_an_earlier_one_in_other_case(spark, tmp_path, name):
    titles = ["to re - Ofwh | ofwh - Ofwh", "the | ed | The", "the - The - ed", "The | the"]
    pages = [(k, "https://zzzz.example.com/a", f"<title>{titles[k % 4]}</title><h1>{titles[k // 12 % 4]}</h1>") for k in range(48)]
    assert any("The" in row for row in assert_equal(spark, tmp_path, name, pages))


@pytest.mark.parametrize("name", ["page_summaries", "assembled_sites"])
def test_names_of_characters_that_were_cut(spark, tmp_path, name):
    ends = ["token = &quot", "&quo", "a &amp", "a &am", "1 &lt", "&gt", "x &copy", "&ampquot", "&ampquot;", "&amp;quot;", "&quot;", "&quotx; y", "&#39", "&#39; &middot; &middot"]
    body = "<head><title>{0}</title></head><body><nav></nav><article><h1>{0}</h1><p>{0} text</p></article><footer>&copy; of a long enough footer {0}</footer></body>"
    pages = [(k, f"https://h{k}.example.com/a", body.format(ends[k % len(ends)])) for k in range(4 * len(ends))]
    assert any("&quot" in str(row) for row in assert_equal(spark, tmp_path, name, pages))
