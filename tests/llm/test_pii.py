"""op13: spans against plain regular expressions, SQL on planted rows, odd rows."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import Row

from webgrain.llm import pii
from webgrain.llm.pii_query import OP13_SQL, op13_pii_spans

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in p.finditer(text) if holds(kind, m[0])]


TEXTS = [
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB83WEST12345698765432",
    "my ssn is 123-45-6789. order 123-45-6789? version 123-45-6789",
    "call 555-123-4567 or write a@b.com_x@y.org; also 555.123.4567 far away from any word that would say what it may be",
    "4111 1111 1111 1111 then 4111-1111-1111-1112, 1.2.3.4.5.6.7.8, 300.1.1.1, 000255.0.0.1",
    "+1 (743) 555-3824 +49 30 1234567890123456 +1.2.3.4 +12",
    "é" * 30 + "x@é.com a@b..c a@b.c.. a@b@c.d @x.y %@1.2",
    "ip 10.0.0.1 host 4111111111111111 tel +4930123456",
]


def test_base_spans_equal_plain_regular_expressions():
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("0123456789" * 2 + "..@+- ab_%(é\n") for _ in range(draw.randrange(1, 80))) for _ in range(4000)]
    texts += [("1" * draw.randrange(1, 6) + ".") * draw.randrange(1, 9) + "7" for _ in range(200)]
    for text in texts:
        assert [(k, s, e) for k, s, e, _, base in pii.spans_of(text) if base] == plain(text), text


def test_checksums_and_context_decide_further_kinds():
    found = [[(k, t[s:e]) for k, s, e, _, base in pii.spans_of(t) if not base] for t in TEXTS[:3]]
    assert found[0] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert found[1] == [("national_id", "123-45-6789")]  # the others stand by "version"
    assert found[2] == [("local_phone", "555-123-4567")]
    assert pii.masked(TEXTS[1], pii.spans_of(TEXTS[1])).startswith("my ssn is [NATIONAL_ID]. order 123")


@pytest.mark.parametrize("unit", ["1", "a", "1.", "+1 ", "@", "a@b", "1 ", "+1(", "A1 ", "12-"])
def test_long_lines_take_linear_time(unit):
    began = time.time()
    pii.spans_of(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 8


def test_sql_and_odd_rows(spark, tmp_path):
    rows = [Row(doc_id=k, text=t, lang=None, source="s", n_chars=None) for k, t in enumerate([*TEXTS, TEXTS[0], "", "x" * 3_000_000 + " a@b.org"])]
    rows += [Row(doc_id=None, text=TEXTS[3], lang=None, source="s", n_chars=None), Row(doc_id=99, text=None, lang=None, source="s", n_chars=None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_pii_spans(spark, str(tmp_path))
    names = sorted(out.columns)
    got = sorted(map(str, (tuple(r[c] for c in names) for r in out.collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP13_SQL})").fetchall()
    assert got == sorted(map(str, want)) and len(got) == len(rows)


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.org", "old", 2.5)], "doc_id long, text string, pii string, masked double")
    out = pii.find_pii(docs, masked_col="masked")
    assert out.columns == ["doc_id", "text", "pii", "masked"]
    row = out.first()
    assert row["masked"] == "[EMAIL]" and row["pii"][0]["end"] == 7
    assert pii.find_pii(docs.limit(0), masked_col="masked").count() == 0
