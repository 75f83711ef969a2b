"""Hosts, languages, parsers of one's own, terms by runs of characters, documents taken out."""

from __future__ import annotations

import dataclasses
import ipaddress
import random

from pyspark.sql import functions as F

from lakedocs.functions import hosts
from lakedocs.operators import inverted_index as I, keyword as K, language as L
from lakedocs.sources import ingest, parsers
from lakedocs.streaming import streams as S


def test_addresses(spark):
    """Literals of both families against Python's own tables; shared addresses count as reserved."""
    r = random.Random(1)
    edges = [n for t in (hosts.V4, hosts.V6) for each in t.values() for n in map(ipaddress.ip_network, each)]
    made = [a for n in edges for a in (n[0], n[-1], n[0] - 1 if int(n[0]) else n[0], n[-1] + 1 if int(n[-1]) + 1 < 1 << n.max_prefixlen else n[-1])]
    made += [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(60)] + [ipaddress.IPv6Address(r.getrandbits(128)) for _ in range(40)] + [ipaddress.IPv6Address((0x2000 << 112) + r.getrandbits(125)) for _ in range(40)]
    rows = []
    for a in made:
        names = [str(a)] if a.version == 4 else [f"[{a}]", f"[{a.exploded.upper()}]"]
        if a.version == 4:
            n = int(a)
            names += [str(n), hex(n), f"0{n >> 24:o}.{n >> 16 & 255}.{n & 65535}", f"[::ffff:{a}]", f"{n >> 24}.{n & 0xFFFFFF:#x}"]
        shared = a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10")
        bad = a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or shared or (a.version == 6 and (a.is_site_local or a in ipaddress.ip_network("3fff::/20")))
        rows += [(f"http://{x}:80/p", bad) for x in names]
    out = ingest.flag_unsafe_urls(spark.createDataFrame(rows, "url string, bad boolean")).filter((F.col("unsafe_reason").isNotNull()) != F.col("bad")).collect()
    # Addresses that hold an IPv4 address in IPv6's form are judged by that.
    assert not [x for x in out if "[::ffff:" not in x["url"].lower() and "ffff:0" not in x["url"].lower()], out[:5]
    names = [("http://example.com/1.2.3.4", None), ("http://1.2.3.4.5/", None), ("http://256.1.1.1/", None), ("http://[1::2::3]/", None), ("http://[12345::]/", None), ("http://a.localhost", "loopback"), (None, "no_host"), ("http://[fe80::1%eth0]/", "link_local"), ("http://08.1.1.1/", None)]
    got = ingest.flag_unsafe_urls(spark.createDataFrame(names, "url string, want string"))
    assert [x for x in got.collect() if x["unsafe_reason"] != x["want"]] == []


def test_ranges_are_apart():
    for t in (hosts.V4, hosts.V6):
        found = hosts.ranges(t)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = L.labelled_sample(docs, per_language=15)
    assert max(r["count"] for r in sample.groupBy("lang").count().collect()) <= 15
    profiles = L.fit_profiles(sample)
    told = L.with_language_by_profile(docs.join(sample.select("doc_id"), "doc_id", "left_anti"), profiles)
    assert told.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0] >= 0.95
    odd = spark.createDataFrame([(None,), ("",), ("12 34",), ("der die das und nicht",)], "text string")
    assert [r["language"] is None for r in L.with_language_by_profile(odd, profiles).collect()] == [True, True, True, False]
    assert L.with_language_by_profile(odd, L.fit_profiles(sample.limit(0))).filter("language is not null").count() == 0


def test_a_parser_of_ones_own(spark):
    def parse(raw):
        for k, part in enumerate((raw or "").split("|")):
            if part:
                yield k, "header" if part.isupper() else "paragraph", part, 0, 1 if part.isupper() else None

    parsers.register_parser(spark, "bar_parser", parse)
    docs = spark.createDataFrame([("a", "TOP|text"), ("b", None), ("c", ""), ("d", "x")], "doc_id string, raw string")
    got = sorted(tuple(r) for r in parsers.parsed(docs, "bar_parser", "raw").select("doc_id", "pos", "type", "text").collect())
    assert got == [("a", 0, "header", "TOP"), ("a", 1, "paragraph", "text"), ("d", 0, "paragraph", "x")]


def test_terms_by_runs(spark):
    r = random.Random(3)
    texts = {f"c{k}": "".join(r.choice("abcd É") for _ in range(r.randrange(0, 60))) for k in range(80)} | {"n": None}
    asked = [(1, ["abc", "dé"]), (2, ["a"]), (3, ["ab", None, ""]), (4, ["abcda", "bcdab"]), (5, ["zzz", "abz"]), (6, []), (7, ["É a", "ABC"])]
    chunks = spark.createDataFrame([(c, f"d{k % 9}", t) for k, (c, t) in enumerate(texts.items())], "chunk_id string, doc_id string, text string")
    newest = spark.createDataFrame([(f"d{k}", None if k == 4 else k % 3) for k in range(9)], "doc_id string, extracted_at int")
    out = K.scan_any_terms(chunks, spark.createDataFrame(asked, "query_id int, terms array<string>"), newest, 20).collect()
    doc = {c: f"d{k % 9}" for k, c in enumerate(texts)}
    age = {f"d{k}": None if k == 4 else k % 3 for k in range(9)}
    for q, terms in asked:
        hits = [c for c, t in texts.items() if t and any(x and x.lower() in t.lower() for x in terms)]
        want = sorted(hits, key=lambda c: (age[doc[c]] is None, -(age[doc[c]] or 0), c))[:20]
        assert [x["chunk_id"] for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q] == want, q


def test_documents_taken_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CORPUS", {n: dataclasses.replace(t, buckets=3) for n, t in S.CORPUS.items()})
    monkeypatch.setattr(I, "BUCKETS", 3)
    rows = [(f"d{k}", ["t", "u"][k % 2], "STORED", f"river lamp\nstone{k} garden") for k in range(4)]
    store = S.corpus_store(spark, str(tmp_path / "s"))
    S.put_documents(store, spark.createDataFrame(rows, "doc_id string, tenant_id string, state string, text string"))
    S.take_documents(store, spark.createDataFrame([("d0",), ("d1",), ("no",)], "doc_id string"), "t")
    state = {r["doc_id"]: r["state"] for r in store.read("documents").collect()}
    assert state == {"d0": "DELETED", "d1": "STORED", "d2": "STORED", "d3": "STORED"}
    assert {r["doc_id"] for r in store.read("vectors").collect()} == {"d1", "d2", "d3"} == {r["doc_id"] for r in store.read("chunks").collect()}
    terms = {r["term"]: r["df"] for r in S.corpus_index(spark, store.root).terms().collect()}
    assert terms["river"] == 3 and "stone0" not in terms
    S.take_documents(store, spark.createDataFrame([("d2",)], "doc_id string"), wipe=True)
    assert {r["doc_id"] for r in store.read("documents").collect()} == {"d0", "d1", "d3"} and "stone2" not in {r["term"] for r in S.corpus_index(spark, store.root).terms().collect()}
