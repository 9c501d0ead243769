import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from propgraph.llm import jaccard
from propgraph.llm.components import connected_components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """(size, component) by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    where = {}
    for n, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(n)
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (_, s) in enumerate(sets):
        for m, shared in Counter(m for g in s for m in where[g] if m > n).items():
            if 100 * shared >= 80 * (len(s) + len(sets[m][1]) - shared):
                parent[root(m)] = root(n)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[root(n)] = min(least.get(root(n), i), i)
    return {i: (len(s), least[root(n)]) for n, (i, s) in enumerate(sets)}


def check(df, rows, **how):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df.select("doc_id", "text"), **how).collect()}
    expected = brute(rows)
    assert got == expected, [(k, got.get(k), expected[k]) for k in expected if got.get(k) != expected[k]][:5]


def variants(seed, families=12, members=9):
    """Families of texts whose similarities lie around the threshold, and passages that all share."""
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    rows, i = [], 0
    for f in range(families):
        base = [f"f{f}w{r.randint(0, 10_000)}" for _ in range(r.choice([8, 30, 90, 250, 700]))]
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 22))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10_000)}"
            text = " ".join(w)
            rows.append((i, f"{text} {passage}" if f % 3 else text.upper() if i % 2 else text))
            i += 1
    r.shuffle(rows)
    return rows


def test_corpus(corpus):
    rows, df = corpus
    check(df, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_around_the_threshold(frame, seed):
    rows = variants(seed)
    check(frame(rows), rows)


def test_common_tokens_and_saturated_sets(frame):
    """Passages count as common from 3 groups on: most sets here are saturated or partly so."""
    rows = variants(3, 10, 8) + [(1000 + k, " ".join(f"p{j}" for j in range(k % 3, 60 - k % 2))) for k in range(12)]
    check(frame(rows), rows, common=3, slack=20)
    check(frame(rows), rows, common=3, slack=20, block=400)


def test_groups_larger_than_a_block(frame):
    rows = variants(4, 4, 14)
    check(frame(rows), rows, block=600)


def test_one_large_chain(frame):
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 150])) for k in range(50)]
    check(frame(rows), rows)
    check(frame(rows), rows, block=500)


def test_repeats_nulls_and_empty(frame):
    df = frame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text of five words"), (4, None), (5, ""), (6, " \n"), (7, "few words"), (8, "few words"), (2, "A B C D E F")])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df.withColumn("n", F.lit(1)).select("doc_id", "text")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (2, 2, 1)], key=str)
    assert jaccard.near_duplicates(frame([]).limit(0).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize(("ids", "block"), [((None, 5, 9), jaccard.BLOCK), ((None, 5, 9), 100), ((5, 9, None), jaccard.BLOCK), ((None, None, None), jaccard.BLOCK)])
def test_links_by_way_of_null_ids(frame, ids, block):
    """Three texts of which the first links with both others, and these not with each other."""
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base[8:], "x y"]), " ".join(["z", *base[:-9]])]
    a, b, c = (shingle_set(t) for t in texts)
    assert all(100 * len(a & x) >= 80 * len(a | x) for x in (b, c)) and 100 * len(b & c) < 80 * len(b | c)
    got = jaccard.near_duplicates(frame(list(zip(ids, texts, strict=True))).select("doc_id", "text"), block=block).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == {min((i for i in ids if i is not None), default=None)}


def test_tokens_of_many_groups_make_no_pairs(frame):
    """A token that no task meets twice, but that has too many groups, becomes a common one."""
    rows = variants(6, 8, 6)
    df = frame(rows).select("doc_id", "text")
    check(df, rows, run=3, common=10**9)
    check(df, rows, run=2, common=4, slack=20)


def test_buckets_by_way_of_ranges(frame, monkeypatch):
    rows = variants(7, 6, 6)
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    monkeypatch.setattr(jaccard, "FAN", 4)
    check(frame(rows), rows)


def test_one_id_with_two_texts(frame):
    got = jaccard.near_duplicates(frame([(1, "a b c d e f"), (1, "other words are in here too"), (2, "other words are in here too")]).select("doc_id", "text")).collect()
    assert len(got) == 3


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (3, 1)] + [(100 + k, 101 + k) for k in range(60)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {k: 100 for k in range(100, 161)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from propgraph.llm import components

    monkeypatch.setattr(components, "HUB_ROWS", 10)
    monkeypatch.setattr(components, "MOST_HUBS", 4)
    links = [(7, 1000 + k) for k in range(80)] + [(1000 + k, 2000 + k) for k in range(20)] + [(1, 7), (50, 51)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {50: 50, 51: 50} | {x: 1 for p in links for x in p if x not in (50, 51)}


def test_join_sets_is_exact():
    r = np.random.default_rng(1)
    own = [np.unique(r.integers(0, 60, r.integers(5, 60)).astype(np.uint64)) for _ in range(60)]
    k = jaccard.join_sets(own, 50)
    parent = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                x, y = set(own[a].tolist()), set(own[b].tolist())
                if 100 * len(x & y) >= 50 * len(x | y):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert k.tolist() == parent


def test_lookups_without_broadcast(corpus, monkeypatch):
    """The salted joins that take the place of broadcasts where there are too many rows for these."""
    from propgraph.llm import common

    monkeypatch.setattr(common.lookup, "__defaults__", (4, 0))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows, df = corpus
    check(df, rows)


def test_blocks_where_the_head_has_another_text_of_its_id(spark):
    """The least id of a large chain also has texts that are not in it."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:k], "edited", *base[k + 1 :]]) for k in range(0, 60, 2)]
    odd = [(0, " ".join(f"o{j}x{k}" for k in range(30))) for j in range(12)]
    df = spark.createDataFrame([*odd, *enumerate(texts), (50, " ".join(base))], "doc_id long, text string").coalesce(1)
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(jaccard.near_duplicates(df, block=200).collect()) == key(jaccard.near_duplicates(df).collect())
