"""Cases that once gave wrong results, each at the operator's own interface."""

import random
import string

import pytest
from pyspark.sql import functions as F

from dqspark.llm import license_scan, mixing, secret_scan, url_filter
from tests.llm.conftest import SCHEMA


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t), "k", "r", 1, 2, "d", "x") for i, t in enumerate(texts)], SCHEMA)


# 6: more ordinary words never cost a key

def test_keys_stay_found_whatever_words_stand_beside(spark):
    r = random.Random(3)
    b64 = string.ascii_letters + string.digits
    keys = ["".join(r.choice(b64) for _ in range(30)) for _ in range(20)]
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(30)) for _ in range(400)]
    found = []
    for n in (0, 60, 99, 100, 101, 102, 400):
        rows = secret_scan.scan(docs_of(spark, [f"key {k} end" for k in keys] + [f"word {w} end" for w in words[:n]])).collect()
        found.append({x["doc_id"] for x in rows if any(s["kind"] == "random" for s in x["spans"])})
    assert all(f == set(range(20)) for f in found)


# 9: equal documents have coins of their own

def test_equal_documents_are_rounded_one_by_one(spark):
    docs = docs_of(spark, ["five words in a row"] * 61, "high").unionByName(docs_of(spark, ["a few equal words"] * 61, "low"))
    docs = docs.withColumn("doc_id", F.lit(7).cast("long"))
    for seed in range(4):
        rows = mixing.mix(docs, weights=(1.0, 0.4), seed=seed).where("size = 4").collect()
        target = rows[0]["target"]
        assert len(rows) == 61 and 0.5 < target / 244 < 0.7
        assert abs(sum(x["taken"] for x in rows) - target) <= 2


def test_blocks_stay_bounded_for_rows_without_ids(spark):
    docs = spark.range(40_000).selectExpr("cast(null as long) AS doc_id", "'one two three' AS text", "'s' AS source")
    base = mixing.numbered(docs)
    picks = base.selectExpr("xxhash64(doc_id, text, source, occurrence) AS pick")
    assert base.count() == 40_000 == picks.distinct().count()
    blocks = picks.groupBy(F.expr("pmod(xxhash64(pick, 0), 10)")).count().collect()
    assert max(b["count"] for b in blocks) < 1.2 * 4000
    rows = mixing.mix(docs, weights=(0.5,)).collect()
    assert len(rows) == 40_000 and sum(x["taken"] for x in rows) == 120_000


# 8: rank reaches the whole chain; deep subdomains

def test_distrust_reaches_every_host_of_a_chain(spark):
    hosts = ["bad.example.com", *(f"h{i}.net" for i in range(12))]
    pages = [(0, "https://bad.example.com/de/1", None)] + [
        (i, f"https://{h}/", f"<a href='https://{hosts[i - 1]}/'>x</a>") for i, h in enumerate(hosts) if i]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, url string, html string, host string, trust double")
    got = {x["page_id"]: x for x in url_filter.judge(df).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] > 0 for i in range(1, 13))
    raw = [0.85 ** i for i in range(13)]
    assert [got[i]["distrust"] for i in range(13)] == pytest.approx([x / sum(raw) for x in raw])


def test_hosts_link_to_their_nearest_ancestor_with_pages(spark):
    names = ["example.net", "a.b.example.net", "c.a.b.example.net", "net.other", "x.y", ""]
    frame = spark.createDataFrame([(n,) for n in names], "host string")
    got = {tuple(x) for x in url_filter.nearest_ancestors(frame, frame).collect()}
    assert got == {("a.b.example.net", "example.net"), ("c.a.b.example.net", "a.b.example.net")}


# 10: an edited notice beside an exact one

@pytest.mark.parametrize("between", [" ", " two words "])
def test_edited_notice_beside_an_exact_one(spark, between):
    edited, exact = "licensd undr the apache license version 2 0", "licensed under the apache license version 2 0"
    for text in (edited + between + exact, exact + between + edited):
        spans = license_scan.scan(docs_of(spark, [text])).first()["spans"]
        assert [s["label"] for s in spans].count("apache") == 2, (text, spans)
