"""Each operator against a plain Python version on a small fixture with awkward rows."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from webgrain.llm import _text, bpe_prefix, cdc_dedup, chat_format, hash_tree, jaccard_join, language_id, lm_bloom, positional_index, quality_lr

DOCS = "doc_id long, text string, score string, id int, n int, row_key string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, pool=60):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def awkward(texts):
    """Rows with nulls, empty and long texts, repeated rows, and columns whose names clash."""
    rows = [(k, t, "x", k, None, None) for k, t in enumerate(texts)]
    return [*rows, (500, None, None, None, None, None), (501, "", "", 0, 0, ""), (502, " \n\t ", None, 1, 1, "r"), rows[0], (503, "Z" * 50_000 + " end", None, 1, 1, None)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 2, 5, 30, 60])) for _ in range(40)]
    near = []
    for t in base[:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append("  ".join(words).upper())
    return base + near + base[3:6] + ["Ünï çödé wörds — naïve space 東京 \x0b tab", "one", "one", "a b"]


def test_chat_examples_read_back(spark):
    turns = [
        (1, 0, "user", "hi \\ # < </turn>\n### assistant: no", 9),
        (1, 1, "assistant", "ok\\### Assistant: </turn>\n", 9),
        (1, 2, "assistant", "", 9),
        (1, 3, "user", None, 9),
        (2, None, None, None, 9),
        (2, 0, "odd: #role", "x", 9),
        (3, 0, "assistant", "same", 9),
        (3, 0, "assistant", "same", 9),
        (None, 0, "user", "lost", 9),
    ]
    got = chat_format.expand(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, example int"))
    rows = got.withColumn("back", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).collect()
    for conv in (1, 2, 3):
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        flat = [(t[2] or "", t[3] or "") for t in own]
        want = [(k + 1, flat[: k + 1], flat[k][1] if flat[k][0] == "assistant" else None) for k in range(len(flat)) if flat[k][0] == "assistant" or k == len(flat) - 1]
        have = sorted((r.n_turns, [(t.role, t.text) for t in r.back], r.loss) for r in rows if r.conv_id == conv)
        assert have == want
    assert {r.conv_id for r in rows} == {1, 2, 3}
    assert chat_format.expand(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_language_codes(spark):
    words = {"aa": "the house and river that were there", "bb": "das haus und der fluss die waren dort", "cc": "la maison et le fleuve qui etaient là"}
    rng = random.Random(1)
    rows = [(k, lang, " ".join(rng.choices(w.split(), k=20)), 1.0) for k, (lang, w) in enumerate([*words.items()] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score double")
    model = language_id.train(docs.filter("doc_id < 60"))
    odd = spark.createDataFrame([(900, None, None, 0.0), (901, "aa", "12 34 !", 0.0), (902, None, "", 0.0)], docs.schema)
    got = {r.doc_id: r for r in language_id.predict(docs.unionByName(odd), model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, lang, _, _ in rows)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert language_id.predict(odd, language_id.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_quality_figures(spark, texts):
    rows = awkward([*texts, "spam " * 40, "a # b\na # b\n\n\nc | d\na # b", " ".join(["x y z q r s t u v"] * 3 + [f"k{i}" for i in range(30)])])
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 2), None) for k in range(40)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_lr.score(docs, quality_lr.train(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert r.kept == (not r.base_failed and r.quality >= quality_lr.MIN_PROBABILITY)


def test_quality_model_tells_good_from_bad(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 40, 30) if k % 2 else " ".join(f"z{rng.randrange(30)}!" for _ in range(40))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    got = quality_lr.score(docs, quality_lr.train(docs, labels)).filter("doc_id >= 80").collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in got)


def test_quality_fit_takes_a_repeated_id_once(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, 40, 30) if k % 2 else " ".join(f"z{rng.randrange(30)}!" for _ in range(40))) for k in range(10)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    docs, hot = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, [rows[1]] * 300 + rows))
    want, got = ({r.doc_id: r.quality for r in quality_lr.score(docs, quality_lr.train(d, labels, per_class=5)).collect()} for d in (docs, hot))
    assert got == want and want[1] != want[0]


def test_hash_tree_moves_rows_only_into_the_new_shard(spark):
    rows = [(k, f"text {k}") for k in range(4000)] + [(None, "a"), (None, "b"), (7, "text 7"), (8000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x"))
    got = hash_tree.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.grown_shard for r in got if r.grown_shard != r["shard"]} == {24}
    again = {r.doc_id: r["shard"] for r in hash_tree.shard_documents(docs, 25).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in got)
    sizes = sorted((r.size, r.text_crc32) for r in got)
    assert sizes == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert hash_tree.shard_documents(docs.limit(0)).count() == 0


def test_hash_tree_confines_movement_to_reweighted_subtrees(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    tree = hash_tree.topology(24)
    heavier = [s._replace(weight=3.0) if s.shard == 5 else s for s in tree]
    a = {r.doc_id: r["shard"] for r in hash_tree.assign(ids, tree).collect()}
    b = {r.doc_id: r["shard"] for r in hash_tree.assign(ids, heavier).collect()}
    region = {s.shard: s.region for s in tree}
    moved = [k for k in a if a[k] != b[k]]
    assert moved and all(region[b[k]] == region[5] for k in moved)


def test_lm_base_score(spark, texts):
    rows = awkward(texts)
    docs = spark.createDataFrame(rows, DOCS)
    train = [t for k, t, *_ in rows if k % 3]
    model = lm_bloom.train(docs.filter("doc_id % 3 <> 0"))
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"]
    counts = {}
    for t in train:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for head in (1 << 18, 5):
        got = lm_bloom.score(docs, model, head_words=head).collect()
        assert len(got) == len(rows)
        for r in got:
            own = tokens(dict((k, t) for k, t, *_ in rows)[r.doc_id])
            base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), total)
            assert r.base_score == pytest.approx(base) and -1e9 < r.score < 0


def test_lm_filter_reads_counts_back_and_beats_the_base(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"{p}a {p}b" for p in rng.choices(range(15), k=20))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_bloom.train(docs.filter("doc_id >= 20"))
    got = lm_bloom.score(docs.filter("doc_id < 20"), model).collect()
    assert all(r.score > r.base_score for r in got)
    small = lm_bloom.train(docs.filter("doc_id >= 20"), max_filter_bytes=64)
    assert small.filter.least_pair > model.filter.least_pair
    assert lm_bloom.score(docs.limit(0), model).count() == 0


def test_lm_filter_grows_with_its_members(spark, monkeypatch):
    """No bound unless asked for; many pieces and chunks give the scores of few."""
    assert inspect.signature(lm_bloom.train).parameters["max_filter_bytes"].default is None
    rows = [(k, " ".join(f"a{k}x{i % 50} b{k}x{i % 50}" for i in range(150))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lm_bloom.train(docs)
    assert (one.filter.least_word, one.filter.least_pair) == (lm_bloom.MIN_WORD, lm_bloom.MIN_PAIR)
    want = {r.doc_id: r.score for r in lm_bloom.score(docs, one).collect()}
    monkeypatch.setattr(lm_bloom, "PIECE_BYTES", 4096)
    monkeypatch.setattr(lm_bloom, "CHUNK_BYTES", 5000)
    many = lm_bloom.train(docs)
    assert many.filter.shape.blocks >= many.filter.shape.pieces > 4
    got = {r.doc_id: r.score for r in lm_bloom.score(docs, many).collect()}
    assert got == pytest.approx(want)
    assert all(s / 301 > -0.6 for s in got.values())  # a lost pair costs over 2


def test_lm_scores_pairs_seen_once(spark):
    """'a b' once and 'a c' never: the words are equally frequent, only the pair tells them apart."""
    train = spark.createDataFrame([("x1 a b y1",), ("x2 a d y2",), ("x3 q c y3",)], "text string")
    docs = spark.createDataFrame([(0, "a b"), (1, "a c")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_bloom.score(docs, lm_bloom.train(train)).collect()}
    # 15 tokens, 12 kinds; a history stands before 1 or 2 tokens, all of pairs seen once
    p = lambda n: (n + 0.1) / (15 + 0.1 * 13)
    after_a = lambda n: (n + 2.5 * p(1)) / 4.5
    assert got[0] - got[1] == pytest.approx(math.log10(after_a(1)) - math.log10(after_a(0)), rel=1e-6)


def _contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for at in range(max(1, len(w) - 9)) if w and name is not None else ():
            part = w[at : at + 10]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


def test_positional_index(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n, 40)) for k, n in enumerate([1, 3, 10, 12, 25, 25])] + [(6, ""), (7, None), (None, "w1 w2"), (8, "Only-here, twice; only here")]
    texts = [prose(rng, 30, 40) + " " + items[rng.randrange(6)][1].upper().replace(" ", ", ") + " " + prose(rng, 9, 40) for _ in range(60)]
    rows = [*enumerate(texts), (900, None), (901, ""), (0, texts[0]), (None, items[4][1]), (902, "only here"), (903, "only here twice ONLY-HERE")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    want = sorted((str(k), *_contaminated(t, items)) for k, t in rows)
    for block_words in (1 << 17, 20):
        got = positional_index.find_contamination(docs, bench, block_words=block_words).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    assert positional_index.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert positional_index.find_contamination(docs.limit(0), bench).count() == 0


def _near(texts, items):
    """Items near in each text: any 4 rarest known words of a span of 21, all within 20 words of the rarest."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    code = lambda w: int(_text.words(pa.array([w]), _text.ALNUM, lower=True).hash[0])
    count, out = Counter(w for t in texts for w in split(t)), []
    groups = {}
    for name, item in items:
        words = split(item)
        for at in range(max(1, len(words) - 20)):
            span = set(words[at : at + 21])
            known = sorted((w for w in span if count[w]), key=lambda w: (count[w], code(w)))[:4]
            if known and len(known) == min(4, len(span)):
                groups.setdefault(tuple(known), set()).add(str(name))
    for t in texts:
        at = {}
        for k, w in enumerate(split(t)):
            at.setdefault(w, []).append(k)
        hit = (names for g, names in groups.items() if any(all(any(abs(q - p) <= 20 for q in at.get(w, ())) for w in g) for p in at.get(g[0], ())))
        out.append(sorted(set().union(*hit)))
    return out


@pytest.mark.parametrize("edit_every", [1000, 7])
def test_proximity_finds_exact_and_edited_copies(spark, edit_every):
    rng = random.Random(9)
    items = [(k, prose(rng, n, 4000)) for k, n in enumerate([14, 25, 40, 59, 59])]
    other = lambda n: prose(rng, n, 300).replace("w", "z")
    texts = [prose(rng, 5, 4000) + " " + other(40) for _ in range(40)]
    for _, item in items:
        own = [w if k % edit_every else "edited" for k, w in enumerate(item.split(), 1)]
        texts.append(" ".join([other(30), *own, other(30)]))
    items += [(k + 10, item + " nowhere") for k, item in items]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in positional_index.find_contamination(docs, bench).collect()}
    assert [list(got[k].near_items) for k in range(len(texts))] == _near(texts, items)
    for k in range(5):
        assert {str(k), str(k + 10)} <= set(got[40 + k].near_items) and (str(k) in got[40 + k]["items"]) == (edit_every > 59)


def _components(rows, width, percent):
    sets = {}
    for k, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {(k, len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_near_duplicates(spark, texts, width, percent):
    rng = random.Random(width)
    chain = [" ".join(f"c{i + s}" for i in range(40)) for s in range(6)]
    shared = [" ".join(f"p{i}" for i in range(12)) + " " + prose(rng, 8, 500) for _ in range(30)]
    rows = awkward(texts + chain + shared)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), width, percent).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == _components(rows, width, percent)


def test_one_document_of_each_group_stays(spark, texts):
    rows = awkward(texts)
    docs = spark.createDataFrame(rows, DOCS)
    kept = jaccard_join.keep_representatives(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in _components(rows, 5, 80)})
    assert kept[0].asDict().keys() == {c for c, _ in docs.dtypes}
    assert jaccard_join.keep_representatives(docs.limit(0)).count() == 0


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(4)
    passage = prose(rng, 80, 10_000)
    clean = [prose(rng, 200, 100_000) for _ in range(10)]
    rows = [(k, c[:300] + f" {'x' * k} " + passage + " " + c[300:]) for k, c in enumerate(clean)] + [(50, prose(rng, 100, 100_000)), (51, None), (52, ""), (0, clean[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r.doc_id: r for r in cdc_dedup.dedup_substrings(docs).collect()}
    old = dict(rows[1:10])
    for k in range(1, 10):
        r = got[k]
        data, gone = old[k].encode(), [(s.start, s.end) for s in r.removed]
        assert r.n_removed_bytes == sum(e - s for s, e in gone) >= 0.7 * len(passage)
        assert r.text.encode() == b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
        assert old[k][:250] in r.text and old[k][-250:] in r.text and set(r.first_ids) == {0}
    assert got[50].n_removed_bytes == 0
    assert [got[k].text for k in (51, 52)] == [None, ""]
    assert cdc_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_passages_just_over_50_words_go_whole(spark):
    rng = random.Random(11)
    rows, passages = [], {}
    for k in range(300):
        passage = prose(rng, 51 + k % 10, 1_000_000)
        for copy in range(2):
            rows.append((1000 * copy + k, prose(rng, 40, 1_000_000) + f" é{k}{copy} " + passage + f" {copy}é " + prose(rng, 40, 1_000_000)))
        passages[1000 + k] = (len(passage.encode()), *rows[-1][1].split(passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in cdc_dedup.dedup_substrings(docs).collect()}
    assert all(got[k].n_removed_bytes == 0 for k in range(300))
    short = [(k, size, got[k].n_removed_bytes) for k, (size, *_) in passages.items() if got[k].n_removed_bytes < size]
    exact = [k for k, (_, before, after) in passages.items() if got[k].text in (x + y for x in (before, before[:-1]) for y in (after, after[1:]))]
    assert not short and len(exact) > 290  # a little more goes where a repeated word stands at the border


def _tiktoken():
    ranks = bpe_prefix.PrefixBPE.from_rank_file(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    return ranks, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_bpe_ids_equal_the_public_library(spark, texts):
    bpe, public = _tiktoken()
    odd = ["don't   stop\n\n  12345 <|endoftext|> ñandú 東京　タワー 😀👍🏽 \u0085 x y", "a" * 3000, " " * 500 + "\t\n", "\x00\x01é́"]
    rows = awkward([*texts, *odd])
    docs, path = spark.createDataFrame(rows, DOCS), public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe_prefix.decode(bpe_prefix.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    by = {k: t for k, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        text = by[r.doc_id] or ""
        want = b"".join(i.to_bytes(4, "little") for i in public.encode_ordinary(text))
        assert hashlib.sha256(bytes(r.ids)).digest() == hashlib.sha256(want).digest() and bytes(r.decoded).decode() == text


def test_bpe_table_after_appends_and_edits():
    bpe, _ = _tiktoken()
    rng = random.Random(6)
    letters = "etaoinshrd lu'0"
    table = bpe_prefix.PieceTable(bpe, b"start")
    for _ in range(60):
        new = "".join(rng.choices(letters, k=rng.randrange(6))).encode()
        if rng.random() < 0.5:
            table.append(new)
        else:
            at = rng.randrange(len(table.piece) + 1)
            table.replace(at, min(len(table.piece), at + rng.randrange(4)), new)
        assert table.tokens() == bpe_prefix.PieceTable(bpe, table.piece).tokens()
    long = bpe_prefix.PieceTable(bpe, "".join(rng.choices(letters, k=20_000)).encode())
    before = long.computed
    long.replace(10_000, 10_001, b"zz")
    assert long.computed - before < 2_000
