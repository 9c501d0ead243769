import random
import re

import pytest
from pyspark.sql import functions as F

from propgraph.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(corpus, frame):
    rows, df = corpus
    r = random.Random(3)
    more = [(1000 + k, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for k in range(60)]
    more += [(2000, "x\ny\nx\n \n \nx\t\nx"), (2001, "a b c d e a b c d e"), (2002, "a " * 500), (2003, "#*$%&|<> a")]
    text = dict(rows + more)
    got = quality.judge(df.unionByName(frame(more)), []).collect()
    for x in got:
        e = brute(text[x["doc_id"]])
        assert tuple(x[c] for c in BASE) == e, x["doc_id"]
        assert x["base_failed"] == (e[0] < 10 or 100 * e[4] > 20 * e[0]) and x["kept"] == (not x["base_failed"])


def labelled(seed, n=400):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = r.random() < 0.3
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + ("###" if bad and k % 2 else "") for _ in range(r.randint(20, 80))]
        docs.append((k, " ".join(words).upper() if bad and not k % 2 else " ".join(words)))
        labels.append((k, int(not bad)))
    return docs, labels


def test_learned_rules_separate_and_are_spark_expressions(spark, frame):
    docs, labels = labelled(1)
    rules = quality.fit(frame(docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(f in quality.FEATURES and op in (">", "<=") for rule in rules for f, op, _ in rule)
    fresh, truth = labelled(2)
    good = dict(truth)
    got = quality.judge(frame(fresh), rules).collect()
    wrong = [x for x in got if not x["base_failed"] and x["kept"] != bool(good[x["doc_id"]])]
    assert len(wrong) <= 4
    # the column is what the rules say, row by row
    for x in got:
        first = next((k for k, rule in enumerate(rules) if quality._holds({f: float(x[f]) for f in quality.FEATURES}, rule)), None)
        assert x["rule"] == first


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(k, 0) for k in range(30)], [(None, 1), (2, None)]])
def test_without_examples_of_both_kinds_nothing_is_learned(spark, frame, labels):
    docs, _ = labelled(3, 40)
    assert quality.fit(frame(docs), spark.createDataFrame(labels, "doc_id long, quality int")) == []


def test_labels_are_bounded_and_repeats_do_no_harm(spark, frame):
    docs, labels = labelled(4, 100)
    table = spark.createDataFrame(labels + labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    quality.fit(frame(docs), table, most=30)


def test_empty_and_clashing(spark, frame):
    df = frame([(1, "a b"), (1, "a b"), (None, None)]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("rule", F.lit("x"))
    got = quality.judge(df, [[("n_words", ">", 1.0)]]).collect()
    assert len(got) == 3 and all(x["kept"] is False for x in got)
    assert quality.judge(frame([]).limit(0), []).count() == 0


def test_gain_and_prune():
    rows = [({f: float(k) for f in quality.FEATURES}, k >= 60) for k in range(100)]
    assert quality.learn(rows)[0][0][1] == ">"
    assert quality.learn([(r, False) for r, _ in rows]) == []
