"""The ten operators on small rows: brute force, round trips, and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakedocs.llm import components, decontamination, jaccard, lines, packing, quality, registry, sharding, simhash, substrings, token_files, tokens, warc, wordhash
from lakedocs.llm.shared import keyed, new_path

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, shard string, n_lines string, _x int"
WORDS = "of the and river stone blue lamp quiet seven garden under moon paper glass".split()


def table(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "s", "l", 0) for i, t in rows], DOCS)


def some(n, seed=0, words=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(1, words)))) for i in range(n)]


ODD = [(None, "no id here at all"), (7, None), (8, ""), (9, " \n\t "), (10, "same text twice"), (11, "same text twice"), (11, "same text twice"), (12, "word " * 30000), (13, "é漢字 🙂  x")]


def test_registered_queries(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, f in registry.queries().items():
        ours = f(spark, sf).toPandas()
        assert len(ours), name
        if name in registry.oracle_sql():
            theirs = con.sql(registry.oracle_sql()[name]).df()
            key = lambda d: Counter(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
            assert sorted(ours.columns) == sorted(theirs.columns) and key(ours) == key(theirs), name


def test_ring(spark):
    rows = table(spark, some(500) + ODD).select("doc_id", "text")
    out = sharding.shard(rows, ["doc_id"], 16).toPandas()
    n = out.groupby("shard").size()
    assert len(out) == 500 + len(ODD) and n.max() - n.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    more = sharding.shard(rows, ["doc_id"], 17).toPandas()
    kept = out.groupby("doc_id")["home"].min().eq(more.groupby("doc_id")["home"].min()) | (more.groupby("doc_id")["home"].min() == 16)
    assert kept.all(), "without bounds, one more shard takes rows only into itself"
    one = sharding.shard(spark.createDataFrame([(5, "x")] * 200, "doc_id long, text string"), ["doc_id"], 16).toPandas()
    assert one.groupby("shard").size().max() == 13
    assert sharding.shard(rows.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("blanks,file", [("lead", "byte_bpe_50k.json"), ("drop", "word_bpe_49k.json")])
def test_pieces(blanks, file):
    enc = tokens.PieceEncoder(P.path(file), blanks)
    texts = [t for _, t in ODD if t] + ["", " ", "a ", " a", "a  b", "a\n b", "it's <|endoftext|> 's", "x<|endoftext|>y z", "ok... !!! a***", "İ Σας ΣΑΣ"] + [t for _, t in some(30)]
    for _ in range(2):
        ids, sizes = enc.encode(pa.array([*texts, None]), 2)
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in [*texts, ""]]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


@pytest.mark.parametrize("blanks,file", [("lead", "byte_bpe_50k.json"), ("drop", "word_bpe_49k.json")])
def test_pieces_of_odd_signs(blanks, file):
    """Random texts of marks, composed letters, special tokens and white space: the library's ids."""
    enc, r = tokens.PieceEncoder(P.path(file), blanks), random.Random(4)
    signs = [*"abzABZ019  ..,,!:*&|'\"-_\n\t\r", *"İıßÉǅŉकΣςﬁ½²漢字한가🙂Åǀ×÷ȿ", "\u0958", "\ufb3e", "\u0301", "\u0338", "\u00a0", "\u2003", "\u0085", "\x1c", "\u200d", "<|endoftext|>", "<|startoftext|>", "</w>", "Ġ", "'s", "the", "İ:", "word."]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(14))) for _ in range(20000)] + [":İ:"]
    ids, sizes = enc.encode(pa.array(texts))
    want = [x.ids for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_huffman():
    r = np.random.default_rng(1)
    for n, bits in ((1, 20), (2, 20), (300, 9), (5000, 14)):
        counts = (r.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = token_files.code_lengths(counts, bits)
        assert lengths.max() <= bits and (2.0 ** -lengths[lengths > 0]).sum() <= 1
        codec = token_files.Codec(lengths)
        ids = r.integers(0, n, 3001).astype(np.uint32)
        for k in (0, 1, 127, 128, 129, 3001):
            assert (codec.decode(*codec.encode(ids[:k], 128), k, 128) == ids[:k]).all()
    assert token_files.code_lengths(np.array([1, 1, 2, 4]), 20).tolist() == [3, 3, 2, 1]
    assert token_files.code_lengths(np.zeros(3, np.int64)).sum() == 0


def test_token_files(spark):
    rows = table(spark, some(40) + ODD)
    path = new_path(spark, "t")
    token_files.write_tokens(rows, path, P.path("byte_bpe_50k.json"), "lead", 2, shards=3)
    out = token_files.read_tokens(spark, path).toPandas()
    enc = tokens.encoder(P.path("byte_bpe_50k.json"), "lead").tokenizer
    want = Counter((i, tuple(enc.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in some(40) + ODD)
    assert Counter((None if i != i else int(i), tuple(np.frombuffer(b, "<u4").tolist())) for i, b in zip(out["doc_id"], out["ids"], strict=True)) == want
    out = out.sort_values("start")
    assert (out["start"] == out["n_tokens"].cumsum() - out["n_tokens"]).all() and out["doc_id"].dropna().is_monotonic_increasing
    empty = new_path(spark, "t")
    token_files.write_tokens(rows.limit(0), empty, P.path("byte_bpe_50k.json"), "lead", 2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_packing(spark):
    rows = some(300, words=400) + ODD
    out = packing.pack(table(spark, rows), P.path("word_bpe_49k.json"), "drop", 0, 256).toPandas()
    enc = tokens.encoder(P.path("word_bpe_49k.json"), "drop").tokenizer
    want = Counter()
    for i, t in rows:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, p, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for p, s in enumerate(range(0, len(ids), 256)))
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 256 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert out["sequence_id"].nunique() <= 1.02 * np.ceil(out["length"].sum() / 256) + 1
    assert packing.pack(table(spark, []), P.path("word_bpe_49k.json"), "drop", 0).count() == 0


def test_plan_uses_every_piece():
    r = np.random.default_rng(0)
    for size in (1, 2, 7, 64):
        h = r.integers(0, 50, size + 1)
        h[0] = 0
        used = np.zeros(size + 1, np.int64)
        for n, ls, _ in packing.plan(h):
            assert sum(ls) <= size
            for x in ls:
                used[x] += n
        assert (used == h).all()


def test_patterns_carry_the_plan():
    """Most sequences come from fitted patterns, and there are no more than best fit alone makes."""
    r = np.random.default_rng(3)
    for docs, size in ((1000, 2048), (20000, 2048), (500, 128)):
        lengths = np.clip((r.lognormal(5.5, 1.2, docs) * size / 2048).astype(np.int64), 1, size)
        h = np.bincount(lengths, minlength=size + 1)
        made = packing.plan(h)
        fitted, total = sum(n for n, _, p in made if p), sum(n for n, _, _ in made)
        assert total <= sum(n for n, _ in packing.best_fit(h)) and total <= 1.01 * np.ceil((h * np.arange(size + 1)).sum() / size) + 1
        assert fitted >= 0.5 * total, (fitted, total)


def test_patterns_of_short_pieces():
    """Pieces far under a third of a sequence: most are in fitted patterns, in no more sequences than best fit makes."""
    r = np.random.default_rng(5)
    kinds = {
        "even": r.integers(20, 601, 20000),
        "equal": np.full(10000, 500),
        "median 300": np.clip(np.exp(r.normal(np.log(300), 0.8, 20000)).astype(np.int64), 1, 2048),
        "median 60": np.clip(np.exp(r.normal(np.log(60), 0.8, 20000)).astype(np.int64), 1, 2048),
    }
    for kind, lengths in kinds.items():
        h = np.bincount(lengths, minlength=2049)
        made = packing.plan(h)
        used = np.zeros(2049, np.int64)
        for n, ls, _ in made:
            assert sum(ls) <= 2048
            np.add.at(used, list(ls), n)
        assert (used == h).all()
        assert sum(n for n, _, _ in made) <= sum(n for n, _ in packing.best_fit(h)), kind
        assert sum(n * len(ls) for n, ls, p in made if p) >= 0.6 * len(lengths), kind


def test_nearest_sum_with_a_length():
    """The largest sum that holds a length, against all multisets."""
    from itertools import combinations_with_replacement as sets

    lengths, size = np.array([3, 5, 11]), 17
    full = packing.nearest(lengths, size)
    for x in lengths.tolist():
        assert full[x] == max(sum(c) for k in range(1, 6) for c in sets(lengths.tolist(), k) if x in c and sum(c) <= size)


def test_fit_is_least_squares():
    """The fit's gradient vanishes where a pattern is used, and is not negative where it isn't."""
    h = np.zeros(33, np.int64)
    h[[32, 20, 12, 16, 10, 6]] = [5, 30, 40, 20, 15, 9]
    patterns = packing.enumerate_patterns(np.flatnonzero(h), 32)
    x = packing.fit(patterns, h, 4000)
    got = np.bincount(patterns.ravel(), np.repeat(x, 3), 33)
    got[0] = 0
    weight = 0.1 + np.arange(33) / 32
    weight[0] = 0
    slope = (weight**2 * (got - h))[patterns].sum(1)
    assert (x >= 0).all() and slope.min() > -0.05 and np.abs(slope[x > 0.01]).max() < 0.05


def brute_sets(text, k):
    w = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_jaccard(spark):
    r = random.Random(3)
    base = [w for _, t in some(8, 5, 80) for w in t.split()][:120]
    rows = some(30, 4)
    for i in range(100, 160):  # edited copies of one text, of all degrees
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = "z" + str(r.randrange(99))
        rows.append((i, " ".join(w)))
    rows += [(200, " ".join(base)), (201, " ".join(base).upper()), (202, "a b"), (203, "A\tb"), (204, ""), (205, None), (206, "   "), (207, "")]
    for k, num in ((4, 85), (5, 80)):
        out = jaccard.groups(table(spark, rows), k, num, 100).toPandas().set_index("doc_id")
        sets = {i: brute_sets(t, k) for i, t in rows}
        label = {i: i for i in sets}
        find = lambda x: x if label[x] == x else find(label[x])
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
        assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (x.n_shingles, x.component_id) for i, x in out.iterrows()}
    odd = jaccard.groups(table(spark, ODD)).toPandas()
    assert len(odd) == len(ODD)
    assert jaccard.groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("often", [2, 64])
def test_jaccard_edited_copies(spark, monkeypatch, often):
    """A large group of edited copies, most of them under the bound, whose edits meet by chance."""
    monkeypatch.setattr(jaccard, "OFTEN", often)
    r = random.Random(11)
    base = [r.choice(WORDS) + str(r.randrange(90)) for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice("of the a".split())
        if r.random() < 0.2:
            del w[r.randrange(50) :][: r.randrange(9)]
        if r.random() < 0.3:
            w += "a passage that many of them have at the end".split()
        rows.append((i, " ".join(w)))
    out = jaccard.groups(table(spark, rows), 4, 85, 100).toPandas().set_index("doc_id")["component_id"].to_dict()
    sets = {i: brute_sets(t, 4) for i, t in rows}
    label = {i: i for i in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert out == {i: find(i) for i in sets} and 5 < len(set(out.values())) < 115


def test_jaccard_null_and_repeated_ids(spark):
    """Rows are joined by a key of their own: texts read again are as many as sets that need it."""
    near = " ".join(w for _, t in some(3, 8, 50) for w in t.split())
    rows = [(None, f"{near} {i % 7}") for i in range(60)] + [(5, f"{near} x{i % 7}") for i in range(60)]
    docs = keyed(table(spark, rows))
    sets = jaccard.describe(docs, 4, 85, 100, "doc_id", "text")
    assert jaccard._load(docs, sets.select("row_key"), 4).count() == len(rows)
    out = jaccard.groups(table(spark, rows)).toPandas()
    assert len(out) == len(rows) and set(out["component_id"]) == {5} and out["row_key"].is_unique


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components.least_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[100] == 99
    assert components.least_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (2, "Only three words"), (3, None), (4, item), (10, "")], "item_id long, text string")
    rows = [(1, "pre " + item.upper() + " post"), (2, " ".join(f"w{i}" for i in range(1, 10))), (3, "x only THREE, words! y only"), (4, None), (5, ""), (6, item.replace(" ", "-") + " " + " ".join(f"w{i}" for i in range(10))), (6, "clean")]
    out = decontamination.report(*decontamination.contamination(table(spark, rows), items)).orderBy("row_key").toPandas()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in out.itertuples())
    assert got == [(1, 16, 14, 2), (2, 9, 0, 0), (3, 6, 3, 1), (4, 0, 0, 0), (5, 0, 0, 0), (6, 1, 0, 0), (6, 24, 24, 2)]
    assert hashlib.sha256(b"1,4").hexdigest() in set(out["items_sha256"])
    assert not decontamination.report(*decontamination.contamination(table(spark, rows), items.limit(0))).filter("contaminated").count()
    assert decontamination.report(*decontamination.contamination(table(spark, []), items)).count() == 0


def test_warc(spark):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "é" * 700), (None, "u", big), (None, "v", "z")]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    out = warc.read_warc(spark, path).toPandas()
    got = {(None if r.page_id != r.page_id else int(r.page_id), r.payload_digest): (r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in out.itertuples()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[1, sha(big)] == ("revisit", 2) and got[2, sha(big)] == ("response", None) and got[None, sha(big)] == ("revisit", 2)
    assert all(got[k, sha(small)] == ("response", None) for k in (3, 4)) and got[5, sha("")] == ("response", None)
    assert len(out) == len(rows) and b"\xc3\xa9" * 700 in set(out["payload"])
    empty = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_quality(spark, sf):
    r = random.Random(0)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60))
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = good() if kind == 2 else good().upper().replace(" ", "!! ") if kind == 1 else good() + " idiot scum"
        rows.append((i, text))
        labels.append((i, int(kind == 2), int(kind == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(table(spark, rows), lab.filter("doc_id < 400"), quality.label_grade(), 100)
    out = quality.scored(table(spark, rows), model, 2).toPandas().set_index("doc_id")
    held = out[out.index >= 400]
    assert (held["tail_probability"][held.index % 3 == 2] > 0.5).mean() > 0.95 and (held["tail_probability"][held.index % 3 != 2] < 0.5).mean() > 0.95
    assert held["expected_grade"][held.index % 3 == 0].mean() < held["expected_grade"][held.index % 3 == 1].mean() < held["expected_grade"][held.index % 3 == 2].mean()
    assert quality.scored(table(spark, ODD), model, 2).count() == len(ODD)
    assert quality.fit(table(spark, rows), lab.limit(0), quality.label_grade()) is None
    assert quality.select_good(table(spark, ODD), lab.limit(0)).count() == len(ODD)


def test_simhash(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "  "), (6, "🙂é漢"), (7, "word " * 9000)]
    f = simhash.followed(table(spark, rows + [(7, "z")])).toPandas().sort_values("row_key")
    assert f["doc_id"].tolist() == [1, 2, 3, 4, 5, 6, 7, 7]
    assert f["next_text"].tolist() == f["text"].tolist()[1:] + f["text"].tolist()[:1]
    p = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(table(spark, rows), ["doc_id"], "text").collect()}
    assert p[1] == p[2] and p[3] == p[4] == p[5] == 0 and len(p) == 7
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(200)]
    fps += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in fps[:100]]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "k long, fingerprint long")
    got = {(x["k"], x["fingerprint"]) for x in simhash.within_radius(df, df, "k", 3).collect()}
    assert got == {(i, signed[j]) for i in range(300) for j in range(300) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert simhash.followed(table(spark, [])).count() == 0
    assert [tuple(x) for x in simhash.followed(table(spark, [(3, "x y")])).select("doc_id", "text", "next_text").collect()] == [(3, "x y", "x y")]


def test_substrings(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70) + " é漢"
    rows = [(i, text(80)) for i in range(20)] + [(50 + i, f"{text(i)} {passage} {text(30 - i)}") for i in range(20)] + [(90, None), (91, ""), (92, "a" * 5000)]
    out = {x["doc_id"]: x for x in substrings.dedup_substrings(table(spark, rows)).collect()}
    assert all(out[i]["n_spans"] == 0 and out[i]["text"] == t for i, t in rows[:21]) and out[90]["text"] is None
    assert all(out[50 + i]["removed_bytes"] > 150 for i in range(1, 20))
    assert all(x["n_bytes"] - x["removed_bytes"] == len((x["text"] or "").encode()) for x in out.values())
    assert substrings.dedup_substrings(table(spark, ODD)).count() == len(ODD)
    named = substrings.dedup_substrings(table(spark, rows).withColumn("_key", F.lit("k")).withColumn("_Spans", F.lit("s")))
    assert {(x["_key"], x["_Spans"], x["text"]) for x in named.collect()} == {("k", "s", x["text"]) for x in out.values()}
    assert substrings.dedup_substrings(table(spark, [])).count() == 0


def test_substrings_short_and_periodic(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51) for _ in range(40)]
    beat = "the " * 400 + text(51)
    rows = [(i, f"{text(20)} {p} {text(20)}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{text(1 + i)} {p} {text(41 - i)}") for i, p in enumerate(passages)]
    rows += [(200, f"{text(30)} {beat} {text(30)}"), (201, f"{text(9)} {beat} {text(9)}")]
    out = {x["doc_id"]: x for x in substrings.dedup_substrings(table(spark, rows)).collect()}
    assert all(out[i]["removed_bytes"] == 0 for i in range(40))
    assert all(len(p) <= out[100 + i]["removed_bytes"] <= len(p) + 6 for i, p in enumerate(passages))
    assert len(beat) <= out[201]["removed_bytes"] <= len(beat) + 6
    # A chunk in periodic text is bounded too.
    raw, at = wordhash.text_bytes(pa.array(["the " * 5000, "Nd, " * 5000, "a" * 9000, "é" * 500]))
    assert np.diff(substrings.cut_points(raw, at), prepend=0).max() <= 4 * substrings.MEAN


def test_wordhash():
    texts = pa.array(["A b", None, "", "é A", "b a b " * 500])
    h, s, e, first = wordhash.words(texts, wordhash.NON_BLANK)
    assert first.tolist() == [0, 2, 2, 2, 4, 1504] and h[0] == h[3] == h[5] and h[1] == h[4]
    g, at = wordhash.shingles(h, first, 2)
    assert at[:3].tolist() == [0, 2, 4] and g[2] == g[5]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = {r["doc_id"] for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "p")
        stage(spark, seen, sf).write.parquet(path)
        seen = spark.read.parquet(path)
        ids = {r["doc_id"] for r in seen.select("doc_id").collect()}
        assert ids <= kept and ids, name
        kept = ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
            if name == "n-gram Jaccard join":
                assert not jaccard.groups(seen).filter(F.col("component_id") != F.col("doc_id")).count()
            if name == "benchmark decontamination":
                assert not decontamination.contamination(seen, spark.read.parquet(f"{sf}/benchmark.parquet"))[1].count()
    assert {"sequence_id", "offset"} <= set(seen.columns)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_pipeline_drops_emptied_copies(spark, sf):
    body = "a first line that is long enough to be deleted\n\n\t\n\u00a0\r\nand a second line that is long enough as well\n\n"
    rows = [(i, body, "en", "s", len(body)) for i in range(5)] + [(9, "\n \n", "en", "s", 3), (10, "\n\nword", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.unrepeated_lines(spark, docs, sf).collect()}
    assert out == {0: body, 9: "\n \n", 10: "\n\nword"}


def test_doubtful_pairs_are_settled_in_rounds(spark, monkeypatch):
    """All pairs of a group of near copies, of a chain and of unlike sets: groups as by brute force, and few pairs compared."""
    r = np.random.default_rng(8)
    alike = [np.sort(r.choice(1000, 990, replace=False)) for _ in range(40)]
    chain = [np.arange(2000 + 8 * i, 2100 + 8 * i) for i in range(30)]
    unlike = [np.arange(9000 + 60 * i, 9100 + 60 * i) for i in range(20)]
    sets = dict(enumerate(alike + chain + unlike))
    of = list(sets.items())
    pairs = [(a, b, float(min(len(x), len(y)) / (len(x) + len(y)))) for a, x in of for b, y in of if a < b and (a < 40) == (b < 40)]
    table_ = spark.createDataFrame([(i, bytearray(x.astype(np.uint64).tobytes())) for i, x in of], "set_id long, items binary")
    seen, plain = [], jaccard.overlaps
    monkeypatch.setattr(jaccard, "FIRST", 2)
    monkeypatch.setattr(jaccard, "overlaps", lambda p, s: (seen.append(p.count()), plain(p, s))[1])
    comps = spark.createDataFrame([(i, i) for i in sets], "set_id long, comp long")
    got = {x.set_id: x.comp for x in jaccard._settle(comps, spark.createDataFrame(pairs, "a long, b long, bound double"), table_, 80, 100).collect()}
    want = {i: i for i in sets}
    for a, b, _ in pairs:
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
            low, high = sorted((want[a], want[b]))
            want = {i: low if c == high else c for i, c in want.items()}
    assert got == want and len(seen) > 1
    assert sum(seen) < len(pairs) - 600, (seen, len(pairs))  # of the near copies' 780 pairs most are never compared
