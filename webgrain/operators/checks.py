"""Assertions on nested responses: checks are rows of a table, paths are followed through variants, verdicts come from several runs.

checks: fixture, check_id, type, path, severity, expected (JSON text), substring,
substrings (array), paths (array), min. runs: fixture, run, response (JSON text),
http_status, fetch_error. Both are joined on the fixture, so a check costs one
pass over the responses of its own fixture, and Spark splits frequent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions.base import let, trim

#: The severity that does not decide a verdict, and the status of a request that went well.
OPTIONAL, HTTP_OK = "nice_to_have", 200


def json_path(path: Column) -> Column:
    """A path like a.b[0].c or a.b.0.c as a path of variants."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\[(\d+)\]", r".$1"), r"\."), lambda p: p != "")
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,9}$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), p, F.lit("']")))), ""))


def at_path(document: Column, path: Column) -> Column:
    """The variant at a path, null if nothing is there; length at the end of a path counts a list or a text."""
    own = F.try_variant_get(document, json_path(path), "variant")
    before = F.try_variant_get(document, json_path(F.regexp_replace(path, r"\.?length$", "")), "variant")
    length = F.coalesce(F.size(items(before)), F.length(string(before)))
    counted = F.when(path.rlike(r"(^|\.)length$"), F.try_parse_json(length.cast("string")))
    return F.coalesce(own, counted)


def items(value: Column) -> Column:
    """The items of a list, as variants; null for anything else."""
    return F.when(F.to_json(value).startswith("["), F.try_variant_get(value, "$", "array<variant>"))


def string(value: Column) -> Column:
    """The text of a string; null for anything else."""
    return F.when(F.to_json(value).startswith('"'), F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    return F.when(F.to_json(value).rlike("^-?[0-9]"), F.try_variant_get(value, "$", "double"))


def _shown(value: Column) -> Column:
    """A value as text: strings as they are, lists joined by commas, objects by their name, nothing as ''."""
    one = lambda v: F.coalesce(string(v), F.when(F.to_json(v).startswith("{"), "[object Object]"), F.when(F.to_json(v) != "null", F.to_json(v)), F.lit(""))
    return F.when(value.isNull(), "").otherwise(F.coalesce(F.array_join(F.transform(items(value), one), ","), one(value)))


def _is_in(value: Column, needle: Column) -> Column:
    """Whether an item of a list holds a text, whatever the case; items that are no strings as JSON."""
    return F.coalesce(F.exists(items(value), lambda v: F.contains(F.lower(F.coalesce(string(v), F.to_json(v))), F.lower(needle))), F.lit(False))


def _equal(a: Column, b: Column) -> Column:
    """Whether two values are one; keys in any order, numbers by value."""
    same = F.coalesce(F.to_json(a) == F.to_json(b), F.lit(False))
    return same | F.coalesce(number(a) == number(b), F.lit(False))


def outcome(check: Column, actual: Column, response: Column) -> Column:
    """struct(passed, message) of a check (struct) on the value at its path."""
    kind, needle = check["type"], F.coalesce(check["substring"], F.lit(""))
    expected = F.try_parse_json(check["expected"])
    text = _shown(actual)
    holds = F.contains(F.lower(text), F.lower(needle))
    needles = F.concat(F.filter(F.array(check["substring"]), lambda n: n.isNotNull() & (n != "")), F.coalesce(check["substrings"], F.array().cast("array<string>")))
    pairs = F.flatten(F.transform(F.coalesce(check["paths"], F.array().cast("array<string>")), lambda p: F.transform(needles, lambda n: F.struct(p.alias("path"), n.alias("needle")))))
    matched = F.get(F.filter(pairs, lambda x: _is_in(at_path(response, x["path"]), x["needle"])), F.lit(0))
    count = F.coalesce(F.size(items(actual)).cast("double"), number(actual), F.lit(0.0))
    allowed = F.coalesce(items(expected), F.array().cast("array<variant>"))
    said = lambda passed, good, bad: F.struct(passed.alias("passed"), F.when(passed, good).otherwise(bad).alias("message"))
    return (
        F.when(kind.isin("exact", "logoCandidateSource", "typographyStyleGuess"), said(_equal(actual, expected), F.lit("match"), F.lit("other value")))
        .when(kind == "pathIncludes", said((text != "") & holds, F.lit("substring found"), F.lit("substring missing")))
        .when(kind == "pathNotIncludes", said((text == "") | ~holds, F.lit("substring absent"), F.lit("substring found")))
        .when(kind == "arrayIncludes", said(_is_in(actual, needle), F.lit("array includes substring"), F.lit("no item includes substring")))
        .when(kind == "anyArrayIncludes", said(matched.isNotNull(), F.concat(matched["path"], F.lit(" includes "), matched["needle"]), F.lit("none matched")))
        .when(kind == "exists", said(actual.isNotNull() & (F.to_json(actual) != "null") & (trim(F.coalesce(string(actual), F.lit("x"))) != ""), F.lit("value present"), F.lit("no value")))
        .when(kind == "countGte", said(count >= F.coalesce(check["min"], F.lit(0)), F.lit("count reached"), F.concat(F.lit("count "), count.cast("long").cast("string"))))
        .when(kind == "pathIn", said(F.coalesce(F.exists(allowed, lambda v: string(v) == string(actual)), F.lit(False)), F.lit("value in allowed set"), F.lit("value not in allowed set")))
        .otherwise(F.struct(F.lit(False).alias("passed"), F.concat(F.lit("unknown check type: "), F.coalesce(kind, F.lit(""))).alias("message")))
    )


def run_checks(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """(fixture, check_id, type, severity, run, passed, message, actual: JSON text) for each check and run of its fixture.

    A response that is null or no JSON holds nothing, so that only checks of absence pass.
    """
    read = runs.select("fixture", "run", F.try_parse_json("response").alias("doc"))
    check = F.struct("type", "expected", "substring", "substrings", "paths", "min")
    severity = F.when(F.col("severity") == OPTIONAL, OPTIONAL).otherwise("required")
    table = checks.select("fixture", "check_id", "path", severity.alias("severity"), check.alias("check"))
    found = read.join(table, "fixture").withColumn("value", F.when(F.coalesce("path", F.lit("")) != "", at_path(F.col("doc"), F.col("path"))))
    judged = found.withColumn("o", outcome(F.col("check"), F.col("value"), F.col("doc")))
    return judged.select("fixture", "check_id", "check.type", "severity", "run", "o.passed", "o.message", F.to_json("value").alias("actual"))


def check_verdicts(results: DataFrame) -> DataFrame:
    """(fixture, check_id, severity, n_runs, n_passed, verdict: pass, fail or flaky) over all runs; an optional check that does not always pass is flaky or fails too."""
    each = results.groupBy("fixture", "check_id", "severity").agg(F.count("*").alias("n_runs"), F.count_if("passed").alias("n_passed"))
    return each.withColumn("verdict", F.when(F.col("n_passed") == F.col("n_runs"), "pass").when(F.col("n_passed") == 0, "fail").otherwise("flaky"))


def fixture_verdicts(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each fixture: counts of failed and flaky required checks, of optional ones that did not always pass, and whether it passed.

    It passes if no request failed, all answered 200, and every required check passed in every run.
    """
    required, bad = F.col("severity") == "required", F.col("verdict")
    counted = verdicts.groupBy("fixture").agg(
        F.count_if(required).alias("n_required"),
        F.count_if(required & (bad == "pass")).alias("n_required_passed"),
        F.count_if(required & (bad == "fail")).alias("n_required_failed"),
        F.count_if(required & (bad == "flaky")).alias("n_required_flaky"),
        F.count_if(~required & (bad != "pass")).alias("n_optional_failed"),
    )
    fetched = runs.groupBy("fixture").agg(F.count("*").alias("n_runs"), F.count_if(F.coalesce("fetch_error", F.lit("")) != "").alias("n_fetch_errors"), F.count_if(F.coalesce(F.col("http_status") == HTTP_OK, F.lit(False))).alias("n_ok"))
    rows = fetched.join(counted, "fixture", "left").na.fill(0)
    passed = (F.col("n_fetch_errors") == 0) & (F.col("n_ok") == F.col("n_runs")) & (F.col("n_required_failed") == 0) & (F.col("n_required_flaky") == 0)
    return rows.withColumn("passed", passed)


def stable_values(runs: DataFrame, paths: list[str]) -> DataFrame:
    """(fixture, path, n_values, stable) of the texts that runs give at some paths; blank for none."""
    doc = F.try_parse_json("response")
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), _shown(at_path(doc, F.lit(p))).alias("value")) for p in paths)))
    found = runs.select("fixture", each.alias("x")).groupBy("fixture", "x.path").agg(F.count_distinct("x.value").alias("n_values"))
    return found.withColumn("stable", F.col("n_values") == 1)
