"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from lakedocs.llm import spelling


def brute(rows, least_chars=5, least_n=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, up = {}, {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        form = min(around, key=lambda x: (-words[x], x)) if around else None
        up[w] = form if form and words[form] >= 2 * n else None
        out[w] = [up[w], None, n, len(around), words[up[w]] if up[w] else None]
    for w in words:
        root = w
        while up[root]:
            root = up[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def ours(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def docs(spark, rows):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(40)]

    def variant(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + r.choice("abéÉ×") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :]])

    rows = [(i, " ".join(variant(r.choice(base)) + r.choice(["", ",", "7", "-x"]) for _ in range(60))) for i in range(60)]
    want = brute(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert ours(spelling.variants(docs(spark, rows))) == want


def test_runs_of_one_letter(spark):
    """One shorter word for several places of the same letter: a pair counts once."""
    rows = [(k, text) for k, text in enumerate(["aaaaa " * 3, "aaaaaa " * 6, "aaaaaaa " * 12, "aabaa " * 3, "aaaba " * 24])]
    want = brute(rows)
    assert ours(spelling.variants(docs(spark, rows))) == want and want["aaaaa"][3] == 3


def test_chain_of_forms(spark):
    """Words that lead to one another: the root is at the end, many rounds away."""
    words = ["abcdefghij"]
    for k in range(9):
        words.append("z" * (k + 1) + words[0][k + 1 :])
    rows = [(k, (w + " ") * (3 * 2**k)) for k, w in enumerate(words)]
    want = brute(rows)
    assert ours(spelling.variants(docs(spark, rows))) == want
    assert want["abcdefghij"][1] != want["abcdefghij"][0]


def test_odd_rows(spark, monkeypatch):
    rows = [(None, "spelled spelled spelled"), (7, None), (8, ""), (9, " \n"), (10, "colour colour color"), (11, "color color"), (11, "color color"), (12, "Ünder Über ÜBER " * 30_000), (13, "漢字 🙂 naïve naïve naïve")]
    monkeypatch.setattr(spelling, "LONG", 1000)
    assert ours(spelling.variants(docs(spark, rows))) == brute(rows)
    assert spelling.variants(docs(spark, rows[:0])).count() == 0


def test_given_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = ours(spelling.op12_permuterm(spark, sf))
    r = random.Random(0)
    counts = {w: v[2] for w, v in got.items()}
    alphabet = sorted(set("".join(counts)))
    for w in r.sample(sorted(counts), 400):
        edits = {w[:k] + a + w[k + c :] for k in range(len(w) + 1) for a in ["", *alphabet] for c in (0, 1)} - {w}
        near = [x for x in edits if x in counts and abs(len(x) - len(w)) <= 1]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert got[w][0] == form and got[w][3] == len(near)
    assert sum(counts.values()) <= sum(len(re.findall("[A-Za-zÀ-ÿ]+", t or "")) for _, t in rows)
