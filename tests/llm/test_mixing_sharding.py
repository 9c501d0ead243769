import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from propgraph.llm import common, mixing, sharding


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mixed(spark, df):
    slim = common.written(mixing.sized(df).select("doc_id", "source", "size", "__h"), "t")
    return mixing.copies(slim, mixing.plan(slim.select("source", "size", "__h"))).collect()


def test_targets_and_copies(spark, corpus):
    rows, df = corpus
    got = mixed(spark, df)
    text = dict(rows)
    sizes = defaultdict(int)
    for i, t in rows:
        sizes[f"s{i % 5}"] += len((t or "").encode().split())
    expected = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((text[r["doc_id"]] or "").encode().split())
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    biggest = max(len((t or "").split()) for _, t in rows)
    assert all(abs(taken[s] - expected[s]) <= max(biggest / 2, 0.05 * expected[s]) for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, df)), key=str)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, None: 3}, {"a": 0, "b": 5}, {"x": 7}, {f"s{k}": k * k for k in range(40)}, {"a": 0}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(common.written(df, "t")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_emits_rows_with_their_columns(spark, frame):
    df = frame([(k, f"w{k} x y", "en", "a" if k % 3 else None, 5) for k in range(300)] + [(None, "null id text", "en", "a", 1), (7, None, "en", "a", 0), (8, "w8 x y", "en", "a", 5)])
    df = df.withColumn("size", F.lit("own")).withColumn("copies", F.lit(9)).withColumn("seed", F.lit(1))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.filter("size <> 'own' or copies <> 9").count() == 0
    assert 1.3 * 903 <= out.filter("text is not null").count() * 3 <= 1.7 * 910


def test_many_sources_join_by_salt(spark, frame, monkeypatch):
    df = frame([(k, "a b c", "en", "hot" if k % 3 else f"s{k}", 5) for k in range(200)])
    one = sorted(map(tuple, mixed(spark, df)), key=str)
    monkeypatch.setattr(common.lookup, "__defaults__", (4, 0))
    assert sorted(map(tuple, mixed(spark, df)), key=str) == one


def test_empty_tables(spark, frame):
    df = frame([]).limit(0)
    assert mixing.mix(df).count() == 0
    assert sharding.shard(df).count() == 0


def shards(df, **how):
    return sharding.shard(df, **how).collect()


def test_groups_stay_together_and_slots_are_gapless(corpus):
    rows, df = corpus
    got = shards(df)
    assert len(got) == len(rows) and all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    where = defaultdict(set)
    for r in got:
        where[r["text"] or ""].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_loads_are_as_lpt_gives_them(spark, frame):
    df = frame([(k, f"{k:04d}" + "x" * (50 + 7 * k % 301)) for k in range(900)])
    load = defaultdict(int)
    for r in shards(df):
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 360


def heap_of(sizes, shards):
    """Shard loads that a heap gives for groups one by one, and how many of each size go to each shard."""
    load, out = [0] * shards, defaultdict(lambda: [0] * shards)
    for x in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += x
        out[x][s] += 1
    return load, out


@pytest.mark.parametrize("seed", range(12))
def test_lpt_is_what_a_heap_gives(seed):
    r = random.Random(seed)
    shards = r.choice([1, 2, 3, 24])
    top = r.choice([3, 50, 3000])
    sizes = [r.randint(1, top) for _ in range(r.choice([5, 100, 2000]))] + [r.randint(1, 10**6) for _ in range(r.choice([0, 3, 30]))]
    histogram = sorted(Counter(sizes).items(), reverse=True)
    load, out = heap_of(sizes, shards)
    got = sharding.lpt(histogram, shards)
    assert {x: row.tolist() for (x, _), row in zip(histogram, got, strict=True)} == dict(out)
    assert sharding.lpt([(8, 10**12)], 24).sum() == 10**12 and sharding.lpt([], 24).shape == (0, 24)


def test_query_against_a_heap(spark, corpus, tmp_path):
    """All columns of the query: the loads are those of groups scheduled one by one."""
    rows, df = corpus
    df.unionByName(df.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op2_sharding(spark, str(tmp_path))
    assert out.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got, text = out.collect(), dict(rows)
    assert len(got) == len(rows) + 5 and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    groups, load, where, slots = defaultdict(int), [0] * 24, defaultdict(set), defaultdict(list)
    for r in got:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        groups[data] += r["size"]
        load[r["shard"]] += r["size"]
        where[data].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert load == heap_of(groups.values(), 24)[0]
    assert all(len(v) == 1 for v in where.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hot_groups_are_broadcast(frame, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    monkeypatch.setattr(sharding, "MOST_HOT", 10)
    rows = [(k, "hot text" if k % 3 == 0 else f"{k} text") for k in range(600)] + [(7, "same row")] * 50
    load, groups = [0] * 24, defaultdict(int)
    for r in shards(frame(rows)):
        load[r["shard"]] += r["size"]
        groups[r["text"]] += r["size"]
    assert load == heap_of(groups.values(), 24)[0]


def test_clashing_names_and_repeats(frame):
    df = frame([(1, "a"), (1, "a"), (None, None), (None, ""), (2, "b")]).withColumn("shard", F.lit("x")).withColumn("size", F.lit("x"))
    got = shards(df)
    assert len(got) == 5 and len({r["shard"] for r in got if not r["text"]}) == 1 and all(isinstance(r["shard"], int) for r in got)


def test_crc_matches(spark, corpus):
    rows, df = corpus
    text = dict(rows)
    got = df.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
