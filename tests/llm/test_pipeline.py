import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from propgraph.llm import common, suite

from .test_jaccard import brute

pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(160):
        bad = k % 5 == 0
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + ("###" if bad else "") for _ in range(r.randint(20, 120))]
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, int(not bad), 0))
    good = [x for x in rows if x[0] % 5]
    rows += [(1000 + j, x[1], *x[2:]) for j, x in enumerate(good[:8])]
    for j, x in enumerate(good[10:20]):
        w = x[1].split()
        w[len(w) // 2] = "edited"
        rows.append((2000 + j, " ".join(w + ["more"] * 3), *x[2:]))
    rows += [(3000, None, "en", "s0", 0), (3001, "", None, None, None), (3002, "123 456", "en", "s1", 0)]
    return rows, labels


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs, by = common.table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, path), "test")
        by[name] = docs.collect()
        if name != "pack":
            assert docs.columns == COLUMNS
    kept = {n: {r["doc_id"] for r in v} for n, v in by.items()}
    every = {x[0] for x in rows}
    assert kept["language"] == every - {3000, 3001, 3002}
    # every fifth document is junk, all others are clean and stay
    assert kept["quality_rules"] == {i for i in kept["language"] if i >= 1000 or i % 5}
    groups = brute([(r["doc_id"], r["text"]) for r in by["quality_rules"]])
    assert kept["near_duplicates"] == {c for _, c in groups.values()} and len(by["near_duplicates"]) == len(kept["near_duplicates"])
    taken = Counter(r["doc_id"] for r in by["mixture"])
    assert set(taken) <= kept["near_duplicates"] and max(taken.values()) <= 2
    words = {r["doc_id"]: len(r["text"].split()) for r in by["near_duplicates"]}
    assert abs(sum(n * words[i] for i, n in taken.items()) / sum(words.values()) - 1.5) < 0.15
    assert Counter(r["doc_id"] for r in by["pack"] if r["piece"] == 0) == taken
    assert len({r["sequence_id"] for r in by["pack"]}) <= sum(r["length"] for r in by["pack"]) // 2048 + 2
    whole = corpus_pipeline.run(spark, path)
    assert sorted(whole.drop("sequence_id", "offset").collect()) == sorted(docs.drop("sequence_id", "offset").collect())


def test_columns_of_any_name_are_kept(spark, folder):
    """Columns with the names of statistics pass through every stage with their own values and types."""
    path, _ = folder
    own = {"score": "'s' || doc_id", "rejected": "doc_id", "lang_pred": "1.5", "rule": "'r'", "kept": "'k' || doc_id", "n_words": "'n'", "size": "'z'", "copies": "doc_id", "component_id": "'c'", "__row": "7", "n": "doc_id"}
    docs = common.written(common.table(spark, path, "documents").selectExpr("*", *(f"{v} as {k}" for k, v in own.items())), "test")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, path), "test")
        assert docs.columns == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        assert docs.count() > 100 and docs.filter("score <> 's' || doc_id or rejected <> doc_id or rule <> 'r' or kept <> 'k' || doc_id or size <> 'z' or copies <> doc_id or n <> doc_id").isEmpty()
    assert corpus_pipeline.pack(spark, docs, path).count() >= docs.count()


def test_repeated_and_null_ids(spark, frame):
    text = "one two three four five six seven eight"
    other = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (None, text), (None, other), (2, other), (1, other), (3, "x y z u v w q"), (None, None), (4, "")]
    docs = common.written(frame(rows), "test")
    got = Counter(r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == {text: 1, other: 1, "x y z u v w q": 1, None: 1, "": 1}


def test_empty(spark, frame, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.written(frame([]).limit(0), "test")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out


def test_nothing_is_registered_without_a_library(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("propgraph.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    names = __spark_entry__.queries()
    assert names and "pipeline" not in names and not any(n.startswith("op1") for n in names)


def test_registered():
    names = __spark_entry__.queries()
    assert set(suite.queries()) | {"pipeline"} <= set(names) and len(suite.queries()) == 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality_rules", "near_duplicates", "mixture", "pack"]
