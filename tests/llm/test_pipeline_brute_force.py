"""The whole pipeline, and the tree's draws, against plain Python versions."""

import math
import random
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from webgrain.llm import bpe_prefix, hash_tree

ITEM = " ".join(f"item{k}" for k in range(12))


def prose(rng, n, pool=100_000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def documents():
    """(doc_id, text): good and bad prose, copies, passages, benchmark text and rows that the base rules reject."""
    rng = random.Random(21)
    good = [(2 * k, prose(rng, 60)) for k in range(60)]
    bad = [(2 * k + 1, " ".join(f"z{rng.randrange(30)}!" for _ in range(40))) for k in range(30)]
    near = [(200 + k, t + "1") for k, (_, t) in enumerate(good[:10])]
    exact = [(300 + k, good[20][1]) for k in range(30)]
    passage, hidden = prose(rng, 55), prose(rng, 30) + " " + ITEM + " " + prose(rng, 30)
    with_passage = [(400 + k, f"{prose(rng, 60)} {c} {passage} {c} {prose(rng, 60)}") for k, c in enumerate("ABCD")]
    with_hidden = [(410 + k, f"{prose(rng, 60)} {c} {hidden} {c} {prose(rng, 60)}") for k, c in enumerate("EFG")]
    leaks = [(500, prose(rng, 50) + " " + ITEM.upper().replace(" ", ", ")), (501, prose(rng, 50) + " only-here " + prose(rng, 9))]
    base = [(600, None), (601, ""), (602, "w1 w2"), (603, " ".join(["w1 w2 w3 w4 w5 w6 w7 w8"] * 10)), (604, " \n\t ")]
    return [*good, *bad, *near, *exact, *with_passage, *with_hidden, *leaks, *base, good[30], good[31], (None, prose(rng, 70))]


def quality(rows):
    """Base rules; beyond them, the prose made as bad is what a model has to reject."""
    for k, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        repeated = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and not words[0].startswith("z"):
            yield k, text


def one_of_each_group(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return [rows[k] for k in sorted(set(group))]


def without_repeats(rows, least=100):
    """Every byte that lies in so many bytes which an earlier document holds goes; a null id comes first."""
    seen, out = set(), []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = text.encode()
        windows = [data[i : i + least] for i in range(len(data) - least + 1)]
        gone = {p for i, w in enumerate(windows) if w in seen for p in range(i, i + least)}
        seen.update(windows)
        out.append((k, bytes(b for p, b in enumerate(data) if p not in gone).decode()))
    return out


def uncontaminated(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    for k, text in rows:
        own = words(text)
        if not any(tuple(own[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(own) - n + 1)):
            yield k, text


@pytest.fixture
def tables(tmp_path):
    def write(rows, items):
        ids, texts = [k for k, _ in rows], [t for _, t in rows]
        docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}
        docs |= {c: pa.array(["x"] * len(rows), pa.string()) for c in ("lang", "source")}
        docs["n_chars"] = pa.array([len(t or "") for t in texts], pa.int64())
        pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
        labelled = [k for k in range(60)]
        pq.write_table(pa.table({"doc_id": labelled, "quality": pa.array([1 - k % 2 for k in labelled], pa.int32()), "toxic": pa.array([0] * 60, pa.int32())}), tmp_path / "labels.parquet")
        pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), tmp_path / "benchmark.parquet")
        return str(tmp_path)

    return write


def test_pipeline_equals_its_brute_force(spark, tables):
    rows, items = documents(), [ITEM, "Only here", "", None, "nowhere at all"]
    kept = list(uncontaminated(without_repeats(one_of_each_group(quality(rows))), items))
    ranks = bpe_prefix.PrefixBPE.from_rank_file(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    public = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    want = []
    for k, text in kept:
        ids = public.encode_ordinary(text)
        want.append((k, text, len(text), len(ids), b"".join(i.to_bytes(4, "little") for i in ids)))
    got = [(r.doc_id, r.text, r.n_chars, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, tables(rows, items)).collect()]
    by_id = lambda r: (r[0] is not None, r[0] or 0)
    assert [r[:2] for r in sorted(got, key=by_id)] == [r[:2] for r in sorted(want, key=by_id)]
    assert sorted(got, key=by_id) == sorted(want, key=by_id)
    # What each stage has to decide, so that the brute force is no empty comparison.
    left = dict(kept)
    assert not {1, 200, 300, 410, 500, 501, 600, 603} & set(left) and {0, 40, 400, 401, 411, None} <= set(left)
    assert len(left[401]) < len(left[400]) - 300


def test_pipeline_of_no_rows(spark, tables):
    folder = tables([], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_tree_draws_equal_plain_python(spark):
    tree = [hash_tree.Shard(0, 0, 0), hash_tree.Shard(0, 0, 1, 2.5), hash_tree.Shard(0, 1, 2), hash_tree.Shard(1, 0, 3, 0.5), hash_tree.Shard(1, 3, 4, 4.0)]

    def draw(key, path, weight):
        bits = xxhash.xxh64(path, seed=xxhash.xxh64(key, seed=42).intdigest()).intdigest() >> 12
        return -math.log((bits + 0.5) / (1 << 52)) / weight

    def place(key):
        path, part = "", tree
        for level in range(3):
            below = {}
            for s in part:
                below.setdefault(f"{path}/{s[level]}", []).append(s)
            path = min(below, key=lambda p: draw(key, p, sum(s.weight for s in below[p])))
            part = below[path]
        return part[0].shard

    got = hash_tree.assign(spark.range(2000).withColumnRenamed("id", "doc_id"), tree).collect()
    assert {r.doc_id: r["shard"] for r in got} == {k: place(str(k)) for k in range(2000)}
    counts = [sum(r["shard"] == s.shard for r in got) for s in tree]
    assert all(abs(n - 2000 * s.weight / 9) < 5 * math.sqrt(2000 * s.weight / 9) for n, s in zip(counts, tree, strict=True))
