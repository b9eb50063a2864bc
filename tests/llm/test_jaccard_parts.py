"""op8's long lists and long groups, which go by parts, against all pairs."""

import random

import pytest

from webgrain.llm import jaccard_join


def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def near_copies(draw, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(changes + 1)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("by_parts", "width", "percent"), [(0, 2, 80), (0, 3, 90), (4, 2, 80), (0, 1, 50)])
def test_parts_lose_no_link(spark, monkeypatch, by_parts, width, percent):
    monkeypatch.setattr(jaccard_join, "BY_PARTS", by_parts)
    draw = random.Random(percent + width)
    header = [f"h{k}" for k in range(14)]
    base = [f"w{k}" for k in range(60)]
    texts = near_copies(draw, base, 70, 9) + [" ".join(header + [f"b{draw.randrange(10**6)}" for _ in range(46)]) for _ in range(60)]
    texts += near_copies(draw, header + [f"c{k}" for k in range(46)], 40, 6) + ["", "one", "one two", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, width=width, percent=percent).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, width, percent)


def test_a_group_of_unlike_bodies_gives_few_pairs(spark, monkeypatch):
    """Texts with one rare header, equal size and unlike bodies, in an order that knows no frequent n-gram."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    monkeypatch.setattr(jaccard_join, "BY_PARTS", 0.25)
    seen = []
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda pairs, *rest: (seen.append(pairs.distinct().count()), linked(pairs, *rest))[1])
    draw = random.Random(2)
    header = [f"h{k}" for k in range(14)]
    counts = []
    for n in (100, 200):
        seen.clear()
        docs = spark.createDataFrame([(k, " ".join(header + [f"b{draw.randrange(10**9)}" for _ in range(40)])) for k in range(n)], "doc_id long, text string")
        got = jaccard_join.near_duplicates(docs, width=5, percent=80).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got)
        counts.append(seen[-1])
    assert counts[1] < 200 * 199 / 8, counts


def test_lists_hold_only_rows_that_may_pair(spark):
    """A row without another one of its n-gram near enough in size and place goes; members of a group are one row."""
    rows = [(1, 11, 100, [5, 6]), (1, 10, 100, [5, 6]), (2, 20, 111, [5]), (3, 30, 124, [5, 7]), (4, 40, 300, [6, 7]), (5, 50, 200, [8]), (6, 60, 200, [8])]
    rows += [(7, 70, 50, [90, 91, 92, 93, 9]), (8, 80, 55, [9])]  # four n-grams of 50 before the shared one leave too few for 55
    nodes = spark.createDataFrame(rows, "grp long, node long, n long, prefix array<long>")
    got = sorted(tuple(r) for r in jaccard_join._lists(nodes, 90).select("gram", "grp", "rep", "place").collect())
    assert got == [(5, 1, 10, 0), (5, 2, 20, 0), (8, 5, 50, 0), (8, 6, 60, 0), (9, 8, 80, 0)]
