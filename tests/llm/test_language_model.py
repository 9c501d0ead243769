import math
from collections import Counter

import numpy as np
import pytest

from propgraph.llm import eliasfano as ef
from propgraph.llm import ngram_lm as lm
from propgraph.llm.words import word_hashes


@pytest.mark.parametrize(("n", "top"), [(1, 1), (1, 10**18), (5, 7), (1000, 1500), (1000, 2**63), (30_000, 2**64 - 1), (3, 2**64 - 1), (20_000, 25_000)])
@pytest.mark.parametrize("repeats", [False, True])
def test_elias_fano(n, top, repeats, tmp_path):
    r = np.random.default_rng(n)
    v = r.integers(0, top, n, dtype=np.uint64)
    v = np.sort(v) if repeats else np.unique(v)
    ef.save(f"{tmp_path}/x", ef.named("s", ef.build(v)) | {"other": np.arange(3)})
    back = ef.load(f"{tmp_path}/x")
    s = ef.part("s", back)
    assert back["other"].tolist() == [0, 1, 2] and (s.get(np.arange(len(v))) == v).all()
    q = np.r_[v, r.integers(0, top, 300, dtype=np.uint64), np.uint64(0), np.uint64(2**64 - 1)]
    assert (s.successor(q) == np.searchsorted(v, q)).all()
    found = s.find(q)
    assert ((found >= 0) == np.isin(q, v)).all() and (v[found[found >= 0]] == q[found >= 0]).all()


def test_empty_elias_fano():
    s = ef.EliasFano(ef.build(np.zeros(0, np.uint64)))
    assert s.find(np.array([1], np.uint64)).tolist() == [-1] and s.successor(np.array([1], np.uint64)).tolist() == [0]


def test_word_hashes():
    text = "The cat\x0bsat  on\nthe CAT é É ".encode() + b"x" * 600_000 + b" y " * 300_000
    start, h = word_hashes(text)
    words = text.lower().split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    by = {}
    assert all(by.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert all(text[s : s + len(w)].lower() == w for s, w in zip(start[:9].tolist(), words, strict=False))
    assert len(word_hashes(b"")[1]) == len(word_hashes(b" \n")[1]) == 0


class Naive:
    """The same model with dictionaries: every n-gram that occurs KEEP times, whatever its words."""

    def __init__(self, texts):
        docs = [(t or "").encode().lower().split() + ["</s>"] for t in texts]
        self.c = Counter(w for d in docs for w in d)
        self.N, self.V, self.docs = sum(self.c.values()), len(self.c), len(docs)
        b = Counter(p for d in docs for p in zip(["<s>", *d], d, strict=False))
        self.b = {k: n for k, n in b.items() if n >= lm.KEEP}
        t = Counter(p for d in docs for p in zip(["<s>", *d], d, d[1:], strict=False) if p[:2] in self.b and p[1:] in self.b)
        self.t = {k: n for k, n in t.items() if n >= lm.KEEP}
        self.g1, self.g2 = Counter(), Counter()
        for k, n in self.b.items():
            self.g1[k[0]] += (n - lm.DISCOUNT) / self.count(k[0])
        for k, n in self.t.items():
            self.g2[k[:2]] += (n - lm.DISCOUNT) / self.b[k[:2]]

    def count(self, w):
        return self.docs if w == "<s>" else self.c[w]

    def p1(self, w):
        return (self.c.get(w, 0) + lm.ADD) / (self.N + lm.ADD * (self.V + 1))

    def p2(self, a, w):
        own = (self.b[a, w] - lm.DISCOUNT) / self.count(a) if (a, w) in self.b else 0
        return own + (1 - self.g1.get(a, 0)) * self.p1(w)

    def p3(self, a, b, w):
        own = (self.t[a, b, w] - lm.DISCOUNT) / self.b[a, b] if (a, b, w) in self.t else 0
        return own + (1 - self.g2.get((a, b), 0)) * self.p2(b, w)

    def score(self, text):
        d = ["<s>", *(text or "").encode().lower().split(), "</s>"]
        model = math.log10(self.p2(*d[:2])) + sum(math.log10(self.p3(*d[k : k + 3])) for k in range(len(d) - 2))
        return len(d) - 1, sum(w in self.c for w in d[1:]), sum(math.log10(self.p1(w)) for w in d[1:]), model


def compare(info, naive, rows, df):
    got = lm.score(df.select("doc_id", "text"), info).collect()
    assert len(got) == len(rows) and info["N"] == naive.N and info["V"] == naive.V
    text = dict(rows)
    for r in got:
        n, known, base, own = naive.score(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(own, abs=3e-4 * n + 1e-6)


@pytest.mark.parametrize(("shard_tokens", "fan"), [(None, 512), (1500, 512), (200, 512), (1500, 4)])
def test_against_dictionaries(corpus, shard_tokens, fan, monkeypatch):
    """Also with so many shards that contexts lie in several of them, and that counts are dealt twice."""
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "MERGE", 2_000_000 if fan > 4 else 500)
    rows, df = corpus
    train = [(i, t) for i, t in rows if i % 4]
    info = lm.train(df.filter("doc_id % 4 <> 0"), shard_tokens)
    naive = Naive([t for _, t in train])
    assert naive.t
    if shard_tokens:
        assert len(info["n2"]) > 8
    compare(info, naive, rows, df)


def test_repeated_passages_of_rare_words(corpus, frame):
    """Each n-gram that occurs KEEP times is in the model, also when its words occur nowhere else."""
    rows, _ = corpus
    passage = " ".join(f"rare{k}" for k in range(40))
    once = " ".join(f"single{k}" for k in range(40))
    rows = [*rows, *((5000 + k, passage) for k in range(lm.KEEP)), (6000, once)]

    df = frame(rows)
    info = lm.train(df)
    naive = Naive([t for _, t in rows])
    assert info["n2"].sum() == len(naive.b) and info["n3"].sum() == len(naive.t)
    compare(info, naive, rows, df)
    got = {r["doc_id"]: r for r in lm.score(df.filter("doc_id >= 5000"), info).collect()}
    assert got[5000]["score"] > got[5000]["base_score"] / 2 and got[6000]["score"] < got[5000]["score"]


def test_distributions_sum_to_one(corpus):
    rows, df = corpus
    naive = Naive([t for _, t in rows])
    a, b = max(naive.g2, key=lambda k: naive.b[k])
    unknown = naive.p3(a, b, "never seen")
    assert sum(naive.p3(a, b, w) for w in naive.c) + unknown == pytest.approx(1)


def test_nothing_to_learn(frame):
    df = frame([(1, "some words"), (2, None), (None, ""), (1, "some words")])
    info = lm.train(df.limit(0))
    got = lm.score(df, info).collect()
    assert len(got) == 4 and all(r["score"] == pytest.approx(0) and r["n_known"] == 0 for r in got)
    one = lm.train(df.filter("doc_id = 2"))
    assert one["N"] == one["V"] == 1
    assert lm.score(df.limit(0), one).count() == 0


def test_folder_must_be_mounted():
    assert lm._local("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        lm._local("hdfs://host/a")


def test_merged_counts(monkeypatch):
    monkeypatch.setattr(lm, "MERGE", 60)
    r = np.random.default_rng(3)
    parts = [np.unique(r.integers(0, 90, 40, dtype=np.uint64), return_counts=True) for _ in range(30)]
    total, rows = Counter(), 0
    for keys, counts in lm._merged(iter(parts)):
        assert (np.diff(keys.astype(np.int64)) > 0).all()
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        rows += len(keys)
    expected = Counter()
    for keys, counts in parts:
        expected.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert total == expected and rows < sum(len(k) for k, _ in parts) and list(lm._merged(iter([]))) == []
