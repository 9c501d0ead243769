import random
import re

from pyspark.sql import functions as F

from propgraph.llm import licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORDS.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    "cc by", "CC-BY", "cc by cc by cc-BY", "x cc byx", "All Rights Reserved. all rights\nreserved!", "GNU General Public License, version 3", "the General Public Licence",
    "Licensed under the Apache License, Version 2.0.", "cc by nc 4.0 cc by", "É all rights reserved É", "all rights", "reserved all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
    "ccxby", "cc 1 by", "İCC BYİ cc by", "ſ cc by K", "MIT License", "all rights reserved " * 300,
]


def scanned(df):
    return {r["doc_id"]: r for r in licenses.scan(df.select("doc_id", "text")).drop("text").collect()}


def test_base_phrases(corpus, frame):
    rows, df = corpus
    more = [(1000 + k, t) for k, t in enumerate(CASES)]
    text = dict(rows + more)
    got = scanned(df.unionByName(frame(more)))
    assert len(got) == len(text)
    for i, t in text.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


LABELS = [
    ("Licensed under the Apache License, Version 2.0.", "apache", 1.0),
    ("released under the MIT License", "mit", 1.0),
    ("GNU Affero General Public License version 3", "agpl,gpl", 0.9),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl", 0.9),
    ("CC BY-NC 4.0", "cc-by,cc-by-nc", 0.9),
    ("Mozilla Public License 2.0", "mpl", 0.9),
    ("a text of no license", "", 0.0),
    ("the 3-Clause BSD License and the ISC license", "bsd,isc", 0.6),
    ("mit mit mit", "", 0.0),
]


def test_labels(frame):
    got = scanned(frame([(k, x[0]) for k, x in enumerate(LABELS)]))
    assert [(got[k]["labels"], got[k]["score"]) for k in range(len(LABELS))] == [x[1:] for x in LABELS]


def test_the_longer_detection_stays(frame):
    r = scanned(frame([(1, "it is licensed under the Apache License version 2.0 here")]))[1]
    assert [(d["start"], d["end"]) for d in r["detections"]] == [(2, 9)]


def naive(text):
    """All detections by Python's regexes and all pairs compared: (start, end, rule) that stay, labels, score."""
    t = f" {' '.join(WORDS.findall((text or '').translate(LOWER)))} "
    every, listed = [], licenses.rules()
    for k, (_, _, rx, _, _) in enumerate(listed):
        for m in re.finditer(f"(?<= )(?:{rx})(?= )", t, re.ASCII):
            start = t.count(" ", 0, m.start()) - 1
            every.append((start, start + m.group().count(" "), k))

    def within(x):
        return any(y[0] <= x[0] and y[1] >= x[1] and (y[1] - y[0] > x[1] - x[0] or y[:2] == x[:2] and y[2] < x[2]) for y in every)

    stay = sorted((x for x in every if listed[x[2]][4] or not within(x)), key=lambda x: (x[0], -x[1], x[2]))
    return stay, ",".join(sorted({listed[k][0] for _, _, k in stay})), max((listed[k][3] for _, _, k in stay), default=0.0)


def sample(rx, r):
    """A text that the regex matches."""
    while True:
        m = re.search(r"\((?:\?:)?([^()]*)\)(\?|\{1,6\})?", rx)
        if not m:
            break
        part = r.choice(m.group(1).split("|")) if not m.group(2) or r.random() < 0.7 or m.group(2) != "?" else ""
        rx = rx[: m.start()] + part.replace("\\S+", "someone") + rx[m.end() :]
    rx = re.sub(r"\{2\}", "", re.sub(r"(\[[^]]*\])\{2\}", r"\1\1", rx))

    def pick(m):
        c = m.group(1)
        if "-" in c:
            c = "".join(chr(k) for a, b in re.findall("(.)-(.)", c) for k in range(ord(a), ord(b) + 1)) + re.sub(".-.", "", c)
        return r.choice(c)

    rx = re.sub(r"\[([^]]*)\]", pick, rx)
    return re.sub(r"(.)\?", lambda m: m.group(1) if r.random() < 0.5 else "", rx)


def test_each_rule_and_mixtures_against_all_pairs(frame):
    r, listed, texts = random.Random(4), licenses.rules(), []
    matched = set()
    for k, (_, key, rx, _, _) in enumerate(listed):
        own = next((s for s in (sample(rx, r) for _ in range(50)) if re.fullmatch(rx, s)), None)
        assert own, rx
        assert key in own.split()
        matched.add(k)
        texts.append(f"Some words, {own.upper() if k % 2 else own}. And more")
    for _ in range(120):
        parts = [sample(r.choice(listed)[2], r) for _ in range(r.randint(1, 12))]
        texts.append(r.choice([" ", ", ", " of the ", "\n"]).join(parts))
    texts.append(" ".join("mit license of cc by nc 4.0 all rights reserved" for _ in range(1500)))
    got = scanned(frame(list(enumerate(texts))))
    for i, t in enumerate(texts):
        stay, labels, score = naive(t) if len(t) < 20_000 else (None, None, None)
        if stay is None:  # the sweep over thousands of detections: as many times as in one of its parts
            one = naive("mit license of cc by nc 4.0 all rights reserved")[0]
            assert len(got[i]["detections"]) == 1500 * len(one)
            continue
        assert [(d["start"], d["end"], d["k"]) for d in got[i]["detections"]] == stay, t
        assert (got[i]["labels"], got[i]["score"]) == (labels, score), t


def test_rules_are_many_and_of_bounded_length():
    listed = licenses.rules()
    assert len(listed) > 250 and len({x[2] for x in listed}) > 260
    assert not any(re.search(r"[^\\S][*+]|\\S\+(?! \)\{1,6\})|\*", x[2]) for x in listed)


def test_running_values(spark):
    rows = [list(range(n)) for n in (0, 1, 5, 63, 64, 65, 200, 5000)]
    df = spark.createDataFrame([(v,) for v in rows], "v array<bigint>")
    got = df.select("v", licenses.before(F.col("v"), F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), licenses.before(F.transform("v", lambda x: x % 7), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x)).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] and r["m"] == [max((x % 7 for x in r["v"][:k]), default=-1) for k in range(len(r["v"]))]


def test_empty_repeats_and_extra_columns(frame):
    assert licenses.scan(frame([]).limit(0).select("doc_id", "text")).count() == 0
    df = frame([(1, "cc by"), (1, "cc by"), (None, None)]).withColumn("extra", F.lit(1)).withColumn("labels", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = licenses.scan(df)
    assert sorted((r["labels"], r["score"]) for r in got.collect()) == [("", 0.0), ("cc-by", 0.6), ("cc-by", 0.6)] and got.columns.count("score") == 1


def test_query_columns(spark, corpus, tmp_path):
    corpus[1].write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op7_license_scan(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    text = dict(corpus[0])
    rows = out.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r)[1:6] == brute(text[r["doc_id"]]) and tuple(r)[6:] == naive(text[r["doc_id"]])[1:]
