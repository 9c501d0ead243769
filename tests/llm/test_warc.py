import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from propgraph.llm import common, warc


def build(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("extra", F.lit(1))
    path = common.new_path(spark, "warc")
    warc.write(df.repartition(3), path)
    return path, warc.captures(warc.read_records(spark, path)).collect()


BIG = "<html>" + "é" * 120 + "</html>"
ROWS = [
    (5, "http://a.example/x?q=1", BIG), (3, "http://b.example/", BIG), (9, None, BIG), (1, "https://h.example", "short"), (2, "https://h.example", "short"),
    (7, "http://c.example/[", None), (8, "", ""), (10, "http://d.example/é", "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n"), (11, "u", "\r\n\r\n" * 60),
    (12, "u", "WARC/1.1\r\n\r\n" * 20), (13, "a b\r\nc: d", "y" * 300_000), (14, "u", "\r\n"), (15, "u", "end\n"), (16, "u", "﻿text"),
    (17, "http://a]b/", "bracket"), (18, "http://ex℀mple.com/", "letter"), (19, "http://[::1/x", "host"), (20, "//h.example", "no scheme"),
]


def test_round_trip(spark):
    path, got = build(spark, ROWS)
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(ROWS) == len(by)
    first = defaultdict(lambda: 10**9)
    for i, _, h in ROWS:
        first[h or ""] = min(first[h or ""], i)
    for i, url, h in ROWS:
        data, r = (h or "").encode(), by[i]
        x = r["response"]
        assert bytes(x["payload"]) == data and x["payload_bytes"] == len(data) and x["payload_digest"] == hashlib.sha256(data).hexdigest()
        revisit = len(data) >= 100 and first[h] != i
        assert x["type"] == ("revisit" if revisit else "response") and x["refers_to_page"] == (first[h] if revisit else None)
        assert r["request"]["http"].startswith("GET /") and r["metadata"] is not None and r["url"] == " ".join((url or "").split())


def test_revisits_have_no_payload_of_their_own(spark):
    path, _ = build(spark, ROWS)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(ROWS)
    assert records.filter("type = 'revisit' and payload is not null").count() == 0
    assert records.filter("type = 'revisit'").count() == 2
    own = {r[0] for r in records.filter("type in ('response', 'revisit')").select("id").collect()}
    assert {r[0] for r in records.filter("concurrent_to is not null").select("concurrent_to").collect()} == own


def test_repeated_rows_and_null_ids(spark):
    _, got = build(spark, [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG), (None, "u", BIG), (None, "u", "tiny"), (4, "u", "tiny")])
    kinds = sorted((r["page_id"] or 0, r["response"]["type"], r["response"]["refers_to_page"]) for r in got)
    assert kinds == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (4, "response", None)]
    assert all(r["request"] and r["metadata"] for r in got) and all(r["response"]["payload"] is not None for r in got)


def test_salted_duplicates(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    _, got = build(spark, [(k, "u", BIG if k % 2 else "z" * (200 + k)) for k in range(40)])
    assert sum(r["response"]["type"] == "revisit" for r in got) == 19 and len(got) == 40


def test_empty(spark):
    assert build(spark, [])[1] == []


def test_damage_is_found():
    whole = b"\r\n\r\n".join(warc.transaction(1, "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)) + b"\r\n\r\n"
    assert [h["warc-type"] for h, _ in warc._assemble(iter(whole.split(b"\r\n\r\n")))] == ["request", "response", "metadata"]
    for bad in (whole.replace(b"payload\r\n", b"paylaod\r\n"), whole[:-60], b"junk\r\n\r\n" + whole):
        with pytest.raises(ValueError):
            list(warc._assemble(iter(bad.split(b"\r\n\r\n"))))


def test_hosts():
    assert warc._host_and_path("http://h.example:80/a/b?q=1#f") == ("h.example:80", "/a/b?q=1")
    assert warc._host_and_path("https://h.example") == ("h.example", "/")
    assert {warc._host_and_path(u) for u in ("", "x", "http://a]b/", "http://ex℀mple.com/", "http://[::1/x")} == {("", "/")}


def test_the_query_does_not_shuffle_payloads(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op3_warc(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "payload#" not in plan.split("MapInArrow")[0]
    assert out.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows, first = {r["page_id"]: r for r in out.collect()}, min(i for i, _, h in ROWS if h == BIG)
    for i, _, h in ROWS:
        data, again = (h or "").encode(), h == BIG and i != first
        assert tuple(rows[i])[1:5] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
