"""op11: groups against plain Python and SQL, keys against strings, odd rows."""

import random
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from webgrain.llm import spelling
from webgrain.llm.spelling_query import OP11_SQL, op11_spelling_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def at_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words):
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if at_one(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n, out[w], form[w], words.get(form[w]), root))
    return sorted(map(str, rows))


def random_words(seed, letters, lengths, n):
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.randrange(*lengths))): 3 + int(draw.paretovariate(0.6)) % 10_000 for _ in range(n)}


@pytest.mark.parametrize("long_word", [spelling.LONG_WORD, 6, 0])
def test_groups_equal_plain_python(spark, long_word, monkeypatch):
    words = random_words(1, "abé", (5, 9), 300) | random_words(2, "aàb÷", (60, 70), 5) | {"a" * k: 3 + 2**k for k in range(5, 14)}
    words |= {"b" * 64: 9, "b" * 65: 50, "b" * 66: 200, "b" * 63 + "a": 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_pairs(df.selectExpr("monotonically_increasing_id() AS id", "word", "n"), long_word).collect()
    got = sorted(tuple(sorted((r["a_word"], r["b_word"]))) for r in pairs)
    assert got == sorted((a, b) for a in words for b in words if a < b and at_one(a, b))
    if long_word == spelling.LONG_WORD:
        rows = spelling.spelling_groups(df).collect()
        assert sorted(map(str, map(tuple, rows))) == plain_groups(words)


def test_keys_are_those_of_distinct_deletions():
    words = list(random_words(4, "abé", (1, 12), 200))
    keys, of = spelling.deletion_keys(pa.array(words))
    texts = [t for w in words for t in sorted({w, *(w[:k] + w[k + 1 :] for k in range(len(w)))})]
    assert keys.size == len(texts) and len(set(keys.tolist())) == len(set(texts))
    assert Counter(of.tolist()) == Counter(k for k, w in enumerate(words) for _ in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))})


def test_query_equals_sql_and_plain_counts(spark, tmp_path):
    draw = random.Random(7)
    vocabulary = list(random_words(5, "abcdÀé×", (2, 9), 150)) + ["Zebra", "zebra", "ZEBRAS", "İstanbul", "straße"]
    rows = [(k, " ".join(draw.choices(vocabulary, k=120)), None, "s", None) for k in range(60)]
    rows += [rows[3]] * 3 + [(None, "zebras zebras zebra", None, "s", None), (None, None, None, None, None), (61, "", None, None, None), (62, "zebra " * 400_000 + "q" * 200_000, None, "s", 0)]
    rows += [(70 + k, "w" * 30_000 + "x" * k, None, "s", 0) for k in (0, 0, 0, 1, 1, 1, 1, 1, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_spelling_groups(spark, str(tmp_path))
    names = sorted(out.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in out.collect())
    counted = Counter()
    for doc, text, *_ in rows:
        for run in spelling.RUN.findall((text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counted[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}
    assert got == sorted(str(tuple(dict(zip(("word", "n", "n_near", "form", "form_n", "root"), eval(r), strict=True))[c] for c in names)) for r in plain_groups(words))
    short = [r for r in rows if len(r[1] or "") < 30_000]
    spark.createDataFrame(short, SCHEMA).write.parquet(f"{tmp_path}/short/documents.parquet")
    got = sorted(str(tuple(r[c] for c in names)) for r in op11_spelling_groups(spark, f"{tmp_path}/short").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/short/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({OP11_SQL})").fetchall()))


def test_odd_rows_and_parameters(spark):
    words = spark.createDataFrame([("hello", 9, "x"), ("hellp", 2, "x"), (None, 5, "x"), ("jello", None, "x")], "word string, n long, root string")
    rows = {r["word"]: r for r in spelling.spelling_groups(words).collect()}
    assert set(rows) == {"hello", "hellp"} and rows["hellp"]["root"] == "hello" and rows["hello"]["n_near"] == 1
    assert spelling.spelling_groups(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(words, gain=1)


def test_no_table_of_words_or_keys_is_broadcast(spark, monkeypatch):
    plans, cut = [], spelling.cut
    show = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(spelling, "cut", lambda df: cut(show(df)))
    words = spark.createDataFrame([("hello", 9), ("hellp", 4), ("helpp", 1), ("h" * 70, 8), ("h" * 71, 2)], "word string, n long")
    rows = {r["word"]: r["root"] for r in show(spelling.spelling_groups(words)).collect()}
    assert rows == {"hello": "hello", "hellp": "hello", "helpp": "hello", "h" * 70: "h" * 70, "h" * 71: "h" * 70}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
