import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from propgraph.llm import binpack, langid, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, got, tokenizer, capacity):
    expected = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_pieces_and_sequences(corpus, tokenizer, capacity):
    rows, df = corpus
    used, least = check(rows, packing.pack(df, PATH, capacity).collect(), tokenizer, capacity)
    assert used <= least + 1 + least // 100


def test_many_equal_lengths_repeats_and_nulls(frame, tokenizer):
    rows = [(k, "same text here") for k in range(500)] + [(None, "same text here"), (3, "same text here"), (None, None), (7, "")]
    used, least = check(rows, packing.pack(frame(rows).withColumn("length", F.lit("clash")), PATH, 16).collect(), tokenizer, 16)
    assert used <= least + least // 10 + 1
    assert packing.pack(frame([]).limit(0), PATH).count() == 0


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    r = random.Random(4)
    enc = packing.Encoder(PATH)
    letters = [chr(k) for k in range(0x250)] + list(" \n\t日本🙂̀ΑΣσς'’sStTdDmMlLvVeErR")
    for _ in range(3000):
        text = "".join(r.choice(letters) if r.random() < 0.3 else r.choice("abc de'stmlvr 12!?.") for _ in range(r.randint(0, 50)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    enc.words.most = enc.pieces.most = 0
    assert enc.encode("word word") == packing.Encoder(PATH).encode("word word")


@pytest.mark.parametrize("seed", range(6))
def test_solver(seed):
    r = np.random.default_rng(seed)
    size = [50, 200, 2000][seed % 3]
    lengths = np.minimum(2048, r.lognormal(6, 1.3, size).astype(int) + 1)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    used = packing.solve(counts, 2048)
    total = Counter()
    for filling, times in used:
        assert sum(k * m for k, m in filling.items()) <= 2048
        for k, m in filling.items():
            total[k] += m * times
    assert total == counts
    assert sum(t for _, t in used) <= sum(t for _, t in binpack.best_fit(counts, 2048))


def optimum(pieces, capacity):
    """The least number of sequences, by trying every place of every piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def put(k, loads):
        if len(loads) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(loads)
            return
        for j in {x: j for j, x in enumerate(loads)}.values():
            if loads[j] + pieces[k] <= capacity:
                put(k + 1, [*loads[:j], loads[j] + pieces[k], *loads[j + 1 :]])
        put(k + 1, [*loads, pieces[k]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_small_packings_are_optimal(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30, 100])
    pieces = [r.randint(1, max(1, int(capacity * r.choice([0.4, 0.6, 1.0])))) for _ in range(r.randint(1, 11))]
    counts = dict(Counter(pieces))
    used = packing.solve(counts, capacity)
    assert sum(t for _, t in used) == optimum(pieces, capacity) >= binpack.lower_bound(counts, capacity)
    total = Counter()
    for filling, times in used:
        assert sum(k * m for k, m in filling.items()) <= capacity
        for k, m in filling.items():
            total[k] += m * times
    assert total == Counter(pieces)


@pytest.mark.parametrize("seed", range(5))
def test_search_beats_best_fit(seed):
    """Pieces of a quarter to two thirds of a sequence, where best fit is far from the bound."""
    lengths = np.random.default_rng(seed).integers(500, 1301, 2000)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    assert sum(t for _, t in packing.solve(counts, 2048)) < sum(t for _, t in binpack.best_fit(counts, 2048))


def test_bounds_prove():
    """Three pieces never fit here, which the lengths' sum does not see."""
    counts = dict(Counter(random.Random(1).randint(683, 1024) for _ in range(600)))
    assert binpack.lower_bound(counts, 2048) == 300 == sum(t for _, t in packing.solve(counts, 2048))
    assert packing.solve({k * 10: n for k, n in {6: 2, 5: 2, 4: 2, 3: 1, 2: 1}.items()}, 180) and packing.solve({}, 100) == []
    w, scale = binpack.weights(100), binpack._scales(100, binpack.FUNCTIONS)
    r = random.Random(2)
    for _ in range(2000):  # no filling weighs more than one
        left, own = 100, []
        while left:
            own.append(r.randint(1, left))
            left -= own[-1]
        assert (w[:, own].sum(axis=1) <= scale).all()


def test_repeated_rows_lie_in_different_slices(frame, tokenizer, monkeypatch):
    rows = [(1, "one row many times")] * 300
    used, least = check(rows, packing.pack(frame(rows), PATH, 50).collect(), tokenizer, 50)
    assert used <= least + least // 10 + 1


# -- language ------------------------------------------------------------------------------------------------------

SYLLABLES = {"one": "ka lo mi te ru", "two": "sch pfe zau gen ver", "three": "eau oir ais que ent"}


def speak(lang, r, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark, frame):
    r = random.Random(1)
    rows = [(k, speak(lang, r, r.randint(4, 120)), lang, "s", 0) for k in range(600) for lang in [r.choice(list(SYLLABLES))]]
    df = frame(rows)
    content = langid.fit(df.filter(~langid.held_out()))
    got = {x["doc_id"]: x for x in langid.identify(df.select("doc_id", "text"), content).collect()}
    test = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert len(test) > 60 and sum(got[x[0]]["lang_pred"] == x[2] for x in test) / len(test) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values())
    # what is learned does not read the texts that are tested
    assert content == langid.fit(df.filter(~langid.held_out()).repartition(5))


def test_und_ties_and_bounds(spark, frame):
    r = random.Random(2)
    rows = [(k, speak(lang, r, 40), lang, "s", 0) for k in range(60) for lang in ("one", "two") if lang == "one" or k % 2] + [(900, "kalomi", None, "s", 0), (901, None, "one", "s", 0)]
    content = langid.fit(frame(rows), docs_per_lang=5, chars_per_doc=50)
    assert list(content) == ["one", "two"] and all(len(v) <= 5 * 51 for v in content.values())
    # spans lie anywhere in the texts, not only at their beginnings
    spans = langid.fit(frame([(k, "aaaa " * 50 + "zzzz " * 50, "one", "s", 0) if k else (k, "b", "one", "s", 0) for k in range(2)]), chars_per_doc=20)
    assert len(spans["one"]) <= 42
    odd = [(1, None), (2, ""), (3, "12 !? _"), (4, "x"), (4, "x"), (5, "日本"), (None, speak("two", r, 30))]
    df = frame(odd).select("doc_id", "text").withColumn("score", F.lit("clash"))
    got = sorted(((x["doc_id"], x["lang_pred"], x["rejected"]) for x in langid.identify(df, content).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert (None, "two", False) in got and [x for x in got if x[0] == 4] == [(4, "one", True)] * 2
    assert langid.identify(frame([]).limit(0).select("doc_id", "text"), content).count() == 0


def test_copies_take_no_place_in_the_dictionary(spark, frame):
    """A language that is 99.9% copies of one text learns of its other texts as one without copies does."""
    r = random.Random(6)
    other = [(k, speak("one", r, 40), "one", "s", 0) for k in range(300)]
    few = [(1000 + k, speak("two", r, 40), "two", "s", 0) for k in range(100)]
    df = frame([*other, *few])
    copies = spark.range(100_000).selectExpr("id + 2000 as doc_id", "'schpfezaugen verschpfezau' as text", "'two' as lang", "'s' as source", "0L as n_chars")
    content = langid.fit(df.unionByName(copies))
    assert list(content) == ["two", "one"]  # the language with more rows first
    own = {langid.plain(x[1]) for x in few} | {b"schpfezaugen verschpfezau"}
    assert sum(content["two"].count(x) for x in own) == langid.DOCS_PER_LANG
    # the same texts as without any repeat
    assert content == {k: langid.fit(df.unionByName(copies.limit(1)))[k] for k in content}


def test_each_language_has_a_dictionary(spark, frame):
    """Also one of three texts that are copied thousands of times, next to larger ones."""
    r = random.Random(9)
    texts = [speak("three", r, 60) for _ in range(3)]
    copies = spark.range(9000).selectExpr("id + 5000 as doc_id", f"element_at(array('{texts[0]}', '{texts[1]}', '{texts[2]}'), cast(id % 3 + 1 as int)) as text", "'three' as lang", "'s' as source", "0L as n_chars")
    rows = [(k, speak(lang, r, 40), lang, "s", 0) for k in range(200) for lang in ("one", "two")] + [(900, "solo kiri kiri", "rare", "s", 0)]
    content = langid.fit(frame(rows).unionByName(copies))
    assert sorted(content) == ["one", "rare", "three", "two"] and sorted(content["three"].decode().split()) == sorted(" ".join(texts).split())
    assert langid.Compressor(content).predict(speak("three", r, 40))[0] == "three"


def test_marks_belong_to_words():
    assert langid.plain("हिन्दी, 12 में!").decode() == "हिन्दी में " and langid.plain("It's 2 O'Clock") == b"it s o clock"


def test_query_against_zstandard(spark, corpus, tmp_path):
    """Every row of the query, against sizes taken one text and language at a time."""
    import regex
    import zstandard

    r = random.Random(11)
    rows = [(k, speak(lang, r, r.choice([3, 40, 3000])), lang, "s", 0) for k in range(120) for lang in [r.choice(list(SYLLABLES))]] + [(1000 + i, t, None, None, 0) for i, t in corpus[0] if i % 5 == 0]
    rows += [(None, "kalomi teru", "one", "s", 0), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = langid.op10_language_id(spark, str(tmp_path))
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = {x["doc_id"]: x for x in df.collect()}
    assert df.count() == len(rows)
    content = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet").filter(~langid.held_out()))
    for i, t, *_ in rows:
        x = got[i]
        assert x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if t is None or not regex.search(r"\p{L}", t):
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
            continue
        data = regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).encode()
        sizes = []
        for k, own in content.items():
            z = zstandard.ZstdCompressor(level=11, dict_data=zstandard.ZstdCompressionDict(own.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(z.compress(data[j : j + 4096])) for j in range(0, max(1, len(data)), 4096)), k))
        best, second = sorted(s for s, _ in sizes)[:2]
        assert x["lang_pred"] == next(k for s, k in sizes if s == best)
        assert x["score"] == pytest.approx(min(1.0, (second - best) / best / 0.25)) and x["rejected"] == ((second - best) / best < 0.002)


def test_without_training_rows(frame):
    assert langid.fit(frame([(1, "text", None, "s", 0)])) == {}
    assert langid.identify(frame([(1, "text")]).select("doc_id", "text"), {}).first()["lang_pred"] == "und"


def test_long_texts_are_read_to_their_end():
    r = random.Random(3)
    z = langid.Compressor({k: langid.plain(speak(k, r, 2000)) for k in ("one", "two")})
    text = speak("one", r, 500) + " " + speak("two", r, 5000)
    assert z.predict(text)[0] == "two"
