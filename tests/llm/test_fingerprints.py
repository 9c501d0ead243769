import hashlib
import random

from pyspark.sql import functions as F

from propgraph.llm import fingerprints as fp


def op8(df):
    return {r["doc_id"]: r for r in run(df).collect()}


def run(df):
    """The query's columns for any documents."""
    from unittest import mock

    reader = mock.Mock()
    reader.read.parquet.return_value = df
    return fp.op8_fingerprints(reader, "nowhere")


def test_edited_texts_and_order(corpus):
    rows, df = corpus
    rows = sorted([(i, t or "") for i, t in rows], reverse=True)
    got = op8(df)
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(got[i]["fingerprint"], set()).add(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if edited == t:
            assert got[i]["near_edited"] == 1 and got[i]["edited_fingerprint"] == got[i]["fingerprint"]
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len({t for _, t in rows})


def test_many_ranges(spark, frame, monkeypatch):
    """Ids with gaps, clusters and extremes, nulls and copies, in ranges of four rows."""
    monkeypatch.setattr(fp, "RANGE", 4)
    monkeypatch.setattr(fp, "PORTION", 3)
    r = random.Random(8)
    ids = r.sample(range(10_000), 40) + [10**15 + k for k in range(20)] + [2**63 - 1, -(2**63), -5, 0]
    rows = sorted({i: f"text of {i} line\n" * 4 for i in ids}.items(), reverse=True)
    got = run(frame(rows + [rows[5]] * 9).select("doc_id", "text")).collect()
    text, sha = dict(rows), lambda t: hashlib.sha256(t.encode()).hexdigest()
    cut = lambda t, after: t[: len(t) - len(t) // 3] + after[: len(t) // 3]
    expected = [(i, sha(cut(t, rows[(k + 1) % len(rows)][1]))) for k, (i, t) in enumerate(rows)] + [(rows[5][0], sha(cut(rows[5][1], rows[5][1])))] * 9
    assert sorted((x["doc_id"], x["edited_sha256"]) for x in got) == sorted(expected)
    assert sum(x["near_next"] == 1 for x in got) == 9 and len({x["fingerprint"] for x in got}) == len(text)
    lost = run(frame([(None, f"{k} has no id") for k in range(30)] + [(1, "one text")])).collect()
    assert len(lost) == 31 and len({x["edited_sha256"] for x in lost}) == 31


def test_plan_has_no_python(spark, corpus):
    plan = run(corpus[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness_against_brute_force(spark, corpus):
    """Likeness of pairs of texts, from counters made in Python of Spark's own sentence hashes."""
    rows = [t or "" for _, t in corpus[0][:60]]
    pairs = list(zip(rows, [rows[-1], *rows[:-1]], strict=True))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    sentences = lambda c: F.filter(F.split(c, fp.SENTENCE, -1), lambda x: x != "")
    seeded = lambda s: lambda x: F.xxhash64(F.lit(-s), x)
    hashed = [F.transform(sentences(c), seeded(s)).alias(f"{c}{s}") for c in "ab" for s in (1, 2)]
    made = df.select("k", (fp.vector(F.col("a")) == fp.vector(F.col("b"))).alias("same"), fp.likeness(fp.vector(F.col("a")), fp.vector(F.col("b"))).alias("x"), *hashed).collect()

    def signs(hashes):
        return [sum(2 * (h >> bit & 1) - 1 for h in hashes[s]) for s in (0, 1) for bit in range(62)]

    for r in made:
        a, b = signs((r["a1"], r["a2"])), signs((r["b1"], r["b2"]))
        norm, diff = sum(x * x for x in a + b), sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        expected = 1 if r["same"] else (1 if diff == 0 else 0) if norm == 0 else max(0, 1 - diff / norm)
        assert abs(r["x"] - expected) < 1e-9, r["k"]


def test_ties_nulls_and_empty(frame):
    df = frame([(1, "one"), (1, "one"), (2, "two words"), (None, "no id"), (3, None)])
    got = run(df.withColumn("next_text", F.lit("clash"))).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert run(frame([]).limit(0)).count() == 0
    one = run(frame([(7, "only one here")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"only one only").hexdigest()


def test_homomorphic(spark):
    a, b = "first paragraph. With two sentences.", "second one"
    df = spark.createDataFrame([(f"{a}\n{b}", f"{b}\n{a}", a, b)], "ab string, ba string, a string, b string")
    v = {c: fp.vector(F.col(c)) for c in df.columns}
    row = df.select((v["ab"] == v["ba"]).alias("order"), (fp.combine(v["a"], v["b"]) == v["ab"]).alias("insert"), (fp.combine(v["ab"], v["b"], remove=True) == v["a"]).alias("delete"), (v["a"] == v["b"]).alias("differ")).first()
    assert (row["order"], row["insert"], row["delete"], row["differ"]) == (True, True, True, False)


def test_likeness_follows_the_share_of_equal_sentences(spark):
    r = random.Random(2)
    rows = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for _ in range(12):
            a = [f"sentence {r.random()}." for _ in range(40)]
            b = [x if k < 40 * share else f"other {r.random()}." for k, x in enumerate(a)]
            rows.append((share, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "share double, a string, b string")
    got = df.select("share", fp.likeness(fp.vector(F.col("a")), fp.vector(F.col("b"))).alias("x")).groupBy("share").agg(F.avg("x")).collect()
    assert all(abs(s - x) < 0.1 for s, x in got)
