"""Assertions of every type on values of every kind, and verdicts over runs."""

import json

import pytest
from pyspark.sql import functions as F

from webgrain.operators import checks, scores

CHECK = "fixture string, check_id string, type string, path string, severity string, expected string, substring string, substrings array<string>, paths array<string>, min int"
RUN = "fixture string, run int, response string, http_status int, fetch_error string"
DOC = {"a": {"b": [1, "Two", {"c": None, "d": "  "}], "n": 3, "f": 2.0, "t": True, "s": "Hello"}, "z": [], "o": {"y": 1, "x": [2]}}


def check(kind, path, **more):
    row = {"expected": None, "substring": None, "substrings": None, "paths": None, "min": None} | more
    return ("f", "c", kind, path, row.get("severity"), row["expected"], row["substring"], row["substrings"], row["paths"], row["min"])


CASES = [
    (check("exact", "a.n", expected="3"), True),
    (check("exact", "a.n", expected='"3"'), False),
    (check("exact", "a.f", expected="2"), True),
    (check("exact", "a.t", expected="true"), True),
    (check("exact", "o", expected='{"y": 1, "x": [2]}'), True),
    (check("exact", "a.missing", expected="null"), False),
    (check("exact", "a.b[2].c", expected="null"), True),
    (check("pathIncludes", "a.s", substring="ELL"), True),
    (check("pathIncludes", "a.n", substring="3"), True),
    (check("pathIncludes", "a.b", substring="two"), True),
    (check("pathIncludes", "o", substring="object"), True),
    (check("pathIncludes", "a.nothing", substring=""), False),
    (check("pathNotIncludes", "a.nothing", substring="x"), True),
    (check("pathNotIncludes", "a.s", substring="hell"), False),
    (check("arrayIncludes", "a.b", substring="TWO"), True),
    (check("arrayIncludes", "a.b", substring='"c":null'), True),
    (check("arrayIncludes", "a.s", substring="h"), False),
    (check("anyArrayIncludes", None, paths=["z", "a.b"], substrings=["no", "two"]), True),
    (check("anyArrayIncludes", None, paths=["z"], substring="two"), False),
    (check("exists", "a.b.1"), True),
    (check("exists", "a.b[2].c"), False),
    (check("exists", "a.b[2].d"), False),
    (check("exists", "a.t"), True),
    (check("countGte", "a.b", min=3), True),
    (check("countGte", "a.n", min=4), False),
    (check("countGte", "a.s"), True),
    (check("countGte", "a.b.length", min=3), True),
    (check("pathIn", "a.s", expected='["x", "Hello"]'), True),
    (check("pathIn", "a.n", expected="[3]"), False),
    (check("logoCandidateSource", "a.b[1]", expected='"Two"'), True),
    (check("other", "a"), False),
]


def test_types(spark):
    table = spark.createDataFrame([(*c[:1], f"{k:02d}", *c[2:]) for k, (c, _) in enumerate(CASES)], CHECK)
    runs = spark.createDataFrame([("f", 1, json.dumps(DOC), 200, None)], RUN)
    got = [(r["check_id"], r["passed"]) for r in checks.run_checks(table, runs).orderBy("check_id").collect()]
    assert got == [(f"{k:02d}", want) for k, (_, want) in enumerate(CASES)]


@pytest.mark.parametrize("response", [None, "", "{bad", "null", "7"])
def test_no_response(spark, response):
    table = spark.createDataFrame([check("exists", "a.b"), check("pathNotIncludes", "a.b", substring="x")], CHECK).withColumn("check_id", F.col("type"))
    got = {r["check_id"]: r["passed"] for r in checks.run_checks(table, spark.createDataFrame([("f", 1, response, 500, "gone")], RUN)).collect()}
    assert got == {"exists": False, "pathNotIncludes": True}


def test_verdicts(spark):
    table = spark.createDataFrame([("g", "always", "exists", "a", None, *[None] * 5), ("g", "some", "exists", "b", "required", *[None] * 5), ("g", "never", "exists", "c", "nice_to_have", *[None] * 5), ("h", "always", "exists", "a", "odd", *[None] * 5)], CHECK)
    runs = spark.createDataFrame([("g", 1, '{"a":1,"b":1}', 200, None), ("g", 2, '{"a":1}', 200, ""), ("h", 1, '{"a":1}', 200, None), ("i", 1, None, None, "gone")], RUN)
    verdicts = checks.check_verdicts(checks.run_checks(table, runs))
    assert {(r["fixture"], r["check_id"]): r["verdict"] for r in verdicts.collect()} == {("g", "always"): "pass", ("g", "some"): "flaky", ("g", "never"): "fail", ("h", "always"): "pass"}
    got = {r["fixture"]: (r["passed"], r["n_required"], r["n_required_flaky"], r["n_optional_failed"]) for r in checks.fixture_verdicts(verdicts, runs).collect()}
    assert got == {"g": (False, 2, 1, 1), "h": (True, 1, 0, 0), "i": (False, 0, 0, 0)}
    assert [(r["fixture"], r["path"], r["n_values"]) for r in checks.stable_values(runs, ["b", "a"]).filter("NOT stable").collect()] == [("g", "b", 2)]


def test_field_scores(spark):
    columns = ["run_id", "ds_id", "ds_number", "website_url", "mode", "status", "project_title", "shop_code", "first_req_description", "first_req_note", "skip_reason", "error_message", "customer_instructions", "response"]
    rows = [
        ("1", "a", None, "u", "website_plus_requirements", "success", "T", "https://www.Ex.com/", "d", "n", None, None, "i", '{"ok":true,"business":{"name":" N ","domain":"ex.com"},"brand":{"logoCandidates":[]}}'),
        ("2", "a", None, "u", "website_only", "skipped", "T", "", "", "", None, None, None, None),
        ("3", "a", None, "u", "website_only", "error", "T", "", "", "", None, "boom", None, None),
        ("4", "a", None, "u", "website_only", "success", "T", "", "", "", None, None, None, "{bad"),
    ]
    out = scores.field_scores(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)))
    assert out.columns == scores.FIELD_SCORES
    got = {(r["run_id"], r["field"]): (r["historical_value"], r["extracted_value"], r["score"], r["score_method"]) for r in out.collect()}
    assert len(got) == 7 + 1 + 1 + 6
    assert got["1", "business.domain"] == ("https://www.Ex.com/", "ex.com", "3", "exact") and got["1", "customerInstructions"][:2] == ("d | n", "i")
    assert got["1", "brand.logoCandidates"] == ("", "0", "review", "review") and got["4", "brand.logoCandidates"][2:] == ("0", "missing")
    assert got["2", "_row"] == ("", "", "N/A", "skipped") and got["3", "_row"] == ("", "boom", "N/A", "missing") and got["4", "extract.ok"][2] == "0"
