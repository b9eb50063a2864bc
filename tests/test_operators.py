"""Operators on small tables, and every query with SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from webgrain.operators import coverage, dedup, merge, pages, publish
from webgrain.plans import inputs, registry
from webgrain.sources import files, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want


def reviews(spark, *rows):
    base = dict.fromkeys(inputs.REVIEWS, "") | {"seq": 0, "domain": "a.com", "normalized_url": "https://a.com", "overall_score": ""}
    schema = ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in base)
    return spark.createDataFrame([tuple((base | {"seq": i} | r).values()) for i, r in enumerate(rows)], schema)


OLD, NEW = {"processed_at": "2024-01-01T00:00:00Z"}, {"processed_at": "2024-02-01T00:00:00Z"}
SOCIAL, MAIL = {"extracted_social_links": '["https://x.com/a"]'}, {"extracted_emails": '["a@b.co"]'}
OK, BAD = {"status": "success"}, {"status": "fetch_error"}


@pytest.mark.parametrize(
    ("first", "second", "kept", "previous", "richer"),
    [
        (OK | OLD, BAD | NEW, OLD, "true", ""),
        (OK | OLD, OK | NEW, NEW, "", ""),
        (OK | OLD | SOCIAL, OK | NEW, OLD, "", "true"),
        (OK | OLD, OK | NEW | MAIL, NEW, "", ""),
        (OK | OLD | MAIL, OK | NEW | {"extracted_color_hexes": '["#111111","#222222","#333333","#444444"]'}, NEW, "", ""),
        (BAD | OLD, OK | NEW, NEW, "", ""),
        (BAD | OLD, BAD | NEW, NEW, "", ""),
    ],
)
def test_merge_attempts(spark, first, second, kept, previous, richer):
    (row,) = merge.merge_attempts(reviews(spark, first, second)).collect()
    assert row["processed_at"] == kept["processed_at"]
    assert (row["preserved_previous_success"], row["preserved_richer_contact"], row["n_attempts"]) == (previous, richer, 2)
    assert row["latest_rerun_timestamp"] == NEW["processed_at"]


def test_merge_fills_blanks(spark):
    (row,) = merge.merge_attempts(reviews(spark, OK | OLD | MAIL | {"ds_number": "7"}, BAD | NEW | {"domain": "www.a.com", "normalized_url": "https://www.a.com"})).collect()
    assert row["ds_number"] == "7" and row["status"] == "success" and "www.a.com" in row["duplicate_source_urls"]


def test_merge_holds_one_row_of_a_site(spark):
    """Sites longer than a batch and cut by its borders; no group is gathered."""
    site = lambda k: {"domain": f"s{k}.com", "normalized_url": f"https://s{k}.com"}
    rows = [site(i % 3) | (OK if i % 4 else BAD) | {"processed_at": f"2024-01-{i % 28 + 1:02}T00:00:00Z", "ds_number": str(i) if i == 5 else ""} for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        merged = merge.merge_attempts(reviews(spark, *rows))
        got = {r.domain: r for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()
    assert {d: r.n_attempts for d, r in got.items()} == {f"s{k}.com": 20 for k in range(3)}
    assert got["s2.com"].ds_number == "5" and all(r.status == "success" for r in got.values())
    last = {f"s{k}.com": max(r["processed_at"] for i, r in enumerate(rows) if i % 3 == k and i % 4) for k in range(3)}
    assert {d: r.processed_at for d, r in got.items()} == last


def test_first_by_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4)], "k string, s int")
    assert {(r.k, r.s) for r in dedup.first_by_key(df, F.col("k"), F.col("s")).collect()} == {("a", 1)}
    assert dedup.first_by_key(df, F.col("k"), F.col("s"), keep_blank=True).count() == 3


def test_coverage(spark):
    rows = reviews(spark, OK | {"extracted_color_hexes": '["#111111"]', "pages_inspected": "2"}, OK | {"pages_inspected": "1"})
    pct = {r.metric: r.pct for r in coverage.snapshot(rows, "a").collect()}
    assert (pct["colors"], pct["pages_1"], pct["pages_2"], pct["pages_6+"]) == (50, 50, 50, 0)
    after = coverage.snapshot(rows.unionByName(rows.limit(1)), "b")
    text = {r.metric: r.text for r in coverage.compare_snapshots(coverage.snapshot(rows, "a"), after).collect()}
    assert text["colors"] in ("colors: 50% → 67% (+17 pts)", "colors: 50% → 33% (-17 pts)")


def test_near_duplicate_pages(spark):
    long = "word " * 60
    df = spark.createDataFrame([("a", 0, long), ("a", 1, long + "more"), ("a", 2, "short"), ("b", 0, long)], "site string, seq int, text string")
    assert {(r.site, r.seq) for r in dedup.drop_near_duplicate_pages(df).collect()} == {("a", 0), ("a", 2), ("b", 0)}


def test_page_features(spark):
    html = (
        '<html><head><title>A &amp; B</title><meta name="description" content="Fine things"><style>p{font-family: "Lora", serif}</style></head>'
        '<body><script>var x="<h1>no</h1>"</script><h1> Hello <b>you</b></h1><a href="/about">a</a><a href="#x">x</a><a href="mailto:Me@a.com?s=1">m</a>'
        '<a href="tel:5550109999">t</a><a href="https://other.org/">o</a><a href="/f.pdf">p</a><footer>Twenty characters or more</footer></body></html>'
    )
    df = spark.createDataFrame([(1, "https://www.a.com/x", html), (2, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.page_features(df).collect()}
    one = got[1]
    assert (one.title, one.heading, one.description, one.footer) == ("A & B", "Hello you", "Fine things", "Twenty characters or more")
    assert (one.emails, one.phones, one.fonts, got[2].title) == (["me@a.com"], ["(555) 010-9999"], ["Lora"], "")
    assert [(r.url, r.page_type) for r in pages.site_links(df).collect()] == [("https://www.a.com/about", "about")]


def test_publish(spark):
    row = publish.sanitize_reviews(reviews(spark, BAD | {"error_message": "GET https://a.com/x?y failed, see a.com/z"}), include_domains=False).first()
    assert (row.domain, row.normalized_url, row.error_message) == ("Site 1", "", "GET [url] failed, see [path]")
    assert not sinks.may_publish("/data/results/x") and sinks.may_publish("/data/published/x") and not sinks.may_publish("/published/partner_rows")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name , note\n"x ""q""","two\nlines"\n,, \n y,\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ["note", "name", "lack"]).collect()] == [("two\nlines", 'x "q"', ""), ("", "y", "")]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    assert [r.a for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["not json"]


def test_stream_keeps_best(spark, tmp_path):
    from webgrain.streaming import batches

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = reviews(spark, OK | OLD, BAD | NEW)
    rows.filter("seq = 0").coalesce(1).write.parquet(src)
    batches.keep_best(batches.read_batches(spark, src, rows.schema.simpleString()[7:-1].replace(":", " ")), out, str(tmp_path / "c")).awaitTermination()
    rows.filter("seq = 1").coalesce(1).write.mode("append").parquet(src)
    batches.keep_best(batches.read_batches(spark, src, rows.schema.simpleString()[7:-1].replace(":", " ")), out, str(tmp_path / "c")).awaitTermination()
    (row,) = spark.read.parquet(f"{out}/version=1").collect()
    assert row["status"] == "success" and row["n_attempts"] == 2
