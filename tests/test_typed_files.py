"""Files of fixed columns: round trips, and which file of a folder is picked."""

import os

import pytest

from webgrain.sources import typed


@pytest.mark.parametrize(("columns", "read"), [(typed.CANDIDATES, typed.read_candidates), (typed.REVIEWS, typed.read_reviews), (typed.COMBINED, typed.read_combined), (typed.SUMMARIES, typed.read_summaries)])
def test_round_trip(spark, tmp_path, columns, read):
    cells = ['a "quoted", cell', "two\nlines", "plain", "ünï", ";"]
    rows = [tuple(cells[(i + k) % 5] for i in range(len(columns))) for k in range(5)]
    typed.write_typed(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), str(tmp_path / "t"), columns)
    got = read(spark, str(tmp_path / "t"))
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == sorted(rows)
    assert len(set(columns)) == len(columns) == {typed.read_candidates: 15, typed.read_reviews: 51, typed.read_combined: 55, typed.read_summaries: 13}[read]


def test_blank_and_lacking_columns(spark, tmp_path):
    one = spark.createDataFrame([("https://Www.A.com/x/", None, "extra"), ("b", "www.b.org", "extra")], "normalized_url string, domain string, other string")
    typed.write_typed(one, str(tmp_path / "c"), typed.CANDIDATES)
    got = sorted((r.normalized_url, r.domain, r.canonical_domain, r.shop_code) for r in typed.read_candidates(spark, str(tmp_path / "c")).collect())
    assert got == [("b", "www.b.org", "b.org", ""), ("https://Www.A.com/x/", "", "", "")]
    rows = spark.createDataFrame([("https://Www.A.com/x/?utm_source=q", " "), ("", "x.org"), (None, None)], "`Normalized_URL` string, domain string")
    kept = typed.candidate_rows(rows).collect()
    assert [(r.normalized_url, r.domain, r.canonical_domain) for r in kept] == [("https://www.a.com/x", "www.a.com", "a.com")]


def test_score_summary(spark):
    rows = [("meta", "input_file", "q.csv"), ("meta", "total_rows", "12"), ("meta", "extraction_failed_count", "x"), ("average", "overall_score", "2.5"), ("average", "brief_score", "")]
    rows += [("status", "success", "7"), ("reviewer_notes", "top_2", "b (1)"), ("reviewer_notes", "top_10", "c (1)"), ("reviewer_notes", "top_1", "a (3)"), ("", "k", "v"), (None, "k", "v")]
    r = typed.read_score_summary(spark.createDataFrame(rows, "section string, key string, value string")).first()
    assert (r.input_file, r.total_rows, r.extraction_failed_count, r.rows_with_overall_score) == ("q.csv", 12, 0, 0)
    assert (r.averages, r.status_counts, r.top_notes) == ({"overall_score": "2.5", "brief_score": ""}, {"success": 7}, ["a (3)", "b (1)", "c (1)"])


def test_picks(spark, tmp_path):
    def put(name, age, lines=1):
        path = tmp_path / name
        path.write_text("a,b\n" + "1,2\n" * lines)
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))

    put("url_candidates_1.csv", 9, 60)
    put("url_candidates_2.csv", 1, 70)
    put("url_candidates_test.csv", 0, 99)
    put("url_candidates_3.csv", 0, 3)
    put("review_queue_20240102030405.csv", 5)
    put("review_queue_20240102030406.csv", 4)
    put("manual_review_queue_20240102030407.csv", 3)
    put("review_queue_combined_1.csv", 8)
    put("score_summary_20240102030405.csv", 2)
    put("score_summary_9.csv", 1)
    put("extraction_run_20240102030405.jsonl", 6)
    put("manual_extraction_run_20240102030407.jsonl", 1)
    put("other.txt", 0)
    files, counts = typed.list_files(spark, str(tmp_path)), typed.count_rows(spark, f"{tmp_path}/url_candidates_*.csv")
    one = lambda df: [r.name for r in df.collect()]
    assert files.count() == 12
    assert one(typed.pick_candidates(files, counts)) == ["url_candidates_2.csv"]
    assert one(typed.pick_candidates(files, counts, "url_candidates_3.csv")) == ["url_candidates_3.csv"]
    assert one(typed.pick_candidates(files.filter("name IN ('url_candidates_3.csv', 'url_candidates_test.csv')"), counts, "none")) == ["url_candidates_test.csv"]
    assert one(typed.pick_reviews(files)) == one(typed.pick_reviews(files, "_combined")) == ["review_queue_combined_1.csv"]
    assert one(typed.pick_reviews(files, "latest")) == ["manual_review_queue_20240102030407.csv"]
    assert one(typed.pick_reviews(files, "review_queue_20240102030405.csv")) == ["review_queue_20240102030405.csv"]
    assert one(typed.pick_match(files, "review_queue", "extraction_summary_20240102030405.csv")) == ["review_queue_20240102030405.csv"]
    assert one(typed.pick_match(files, "review_queue", "x_20990102030405.csv", "extraction_run_20240102030407.jsonl")) == ["manual_review_queue_20240102030407.csv"]
    assert one(typed.pick_match(files, "extraction_run", "extraction_summary_20240102030405.csv")) == ["extraction_run_20240102030405.jsonl"]
    assert one(typed.pick_match(files, "score_summary", "review_queue_20240102030405.csv")) == ["score_summary_20240102030405.csv"]
    assert one(typed.pick_newest(files, "extraction_run")) == ["manual_extraction_run_20240102030407.jsonl"]
    assert one(typed.pick_newest(files.limit(0), "score_summary")) == []
