"""Line deduplication against a search of all earlier places, line by line."""

from __future__ import annotations

import random

import pytest

from lakedocs.llm import lines, shared

DOCS = "doc_id long, text string, shard string, n_lines string, _key string"
ODD = [(None, "no id here at all, nothing"), (7, None), (8, ""), (9, " \n\t "), (10, "same text twice, same text"), (11, "same text twice, same text"), (11, "same text twice, same text"), (12, "word " * 30000), (13, "é漢字 🙂  x")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "l", "k") for i, t in rows], DOCS)


def brute(rows):
    """{(id, nth): lines of the longest prefix that stands earlier}"""
    seqs = [(i, t.split("\n")) for i, t in sorted(rows)]
    seen, out = [], {}
    for i, s in seqs:
        for k in range(len(s)):
            best = 0
            for j, other, at in [*seen, *[(i, s, x) for x in range(k)]]:
                n = 0
                while k + n < len(s) and at + n < len(other) and s[k + n] == other[at + n]:
                    n += 1
                best = max(best, n)
            if best:
                out[i, k] = best
        seen += [(i, s, x) for x in range(len(s))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    r = random.Random(seed)
    base = [str(r.randrange(30)) for _ in range(25)]
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randrange(1, 12)))) for i in range(12)]
    for i in range(20, 32):  # edited copies of one text
        s = list(base)
        for _ in range(r.randrange(3)):
            s[r.randrange(25)] = f"u{r.randrange(40)}"
        rows.append((i, "\n".join(s[r.randrange(5) :])))
    rows += [(40, "\n".join("a" * 37)), (41, "\n".join("a" * 20)), (42, "\n".join("ab" * 9))]
    once = list({t: (i, t) for i, t in reversed(rows)}.values())  # equal texts are told by ``first``
    docs = shared.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    seqs = lines.sequences(docs, "text")
    assert {x["_key"] for x in seqs.filter("first").collect()} == {i for i, _ in once}
    flat = shared.written(seqs.filter("first").selectExpr("_key", "posexplode(lines) as (nth, l)").selectExpr("_key", "cast(nth as long) nth", "l.*"), "t")
    got = lines.intervals(lines.prefixes(flat)).collect()
    assert len({(x["_key"], x["nth"]) for x in got}) == len(got)
    assert {(x["_key"], x["nth"]): x["lines"] for x in got} == brute(once)
    text = {i: t.split("\n") for i, t in once}
    for x in got:  # the source is an earlier copy
        n, a, b = x["lines"], (x["_key"], x["nth"]), (x["src_key"], x["src_nth"])
        assert b < a and text[a[0]][a[1] : a[1] + n] == text[b[0]][b[1] : b[1] + n]


def test_order_of_ranks(spark):
    rows = spark.createDataFrame([(1, k, k, 1, ord(c), 0) for k, c in enumerate("banana$banana")], "_key long, nth long, line int, chars int, a long, b long")
    tables = lines.prefixes(rows)
    want = "banana$banana"
    for k, t in enumerate(tables):
        got = [(want[x["nth"] : x["nth"] + 2**k]) for x in sorted(t.collect(), key=lambda x: (x["rank"], x["nth"]))]
        assert got == sorted(got) and all(want.count(g) > 1 or g == "ana" for g in got)
    assert len(tables) == 3


def test_dedup(spark):
    long = "a long line that is repeated as it stands, and more"
    rows = [(1, f"x\n{long}\nend"), (2, f"{long}\nx\nother"), (3, "s1\ns2\nnew"), (4, "old\ns1\n\ns2"), (5, "s2\nzz"), (6, None), (7, ""), (8, "\n\n"), (9, "t\nt\nt"), (10, "s1\ns2\nnew")]
    out = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, rows), 1, 4).collect()}
    text = {i: r["text"] for i, r in out.items()}
    assert text == {1: f"x\n{long}\nend", 2: "x\nother", 3: "s1\ns2\nnew", 4: "old\n", 5: "s2\nzz", 6: None, 7: "", 8: "\n\n", 9: "t\nt\nt", 10: ""}
    assert out[10]["n_deleted"] == 3 and out[10]["longest_run"] == 3 and out[6]["n_lines"] == 0 and out[8]["n_lines"] == 3 and out[1]["shard"] == "s"
    assert lines.dedup_lines(table(spark, rows), 2, 4).filter("doc_id = 2").first()["n_deleted"] == 0
    crlf = [(1, "alpha alpha alpha\r\n\r\n\r\nbeta\r\n\u00a0\r\n\r\ngamma"), (2, "one one one one one\r\n\r\n\r\ntwo\r\n\u00a0\r\n\r\n3")]
    assert {r["text"] for r in lines.dedup_lines(table(spark, crlf)).collect()} == {t for _, t in crlf}
    assert lines.dedup_lines(table(spark, ODD)).count() == len(ODD)
    named = table(spark, rows).withColumnRenamed("shard", "_KEPT")
    kept = lines.dedup_lines(named)
    assert kept.columns[:4] == ["doc_id", "text", "_KEPT", "_key"] and {(r["_KEPT"], r["_key"]) for r in kept.collect()} == {("s", "k")}
    assert lines.dedup_lines(table(spark, [])).count() == 0
