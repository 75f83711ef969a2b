"""Stems against the sample table that is published with the rules, and the query against a plain version."""

from __future__ import annotations

from collections import defaultdict

from lakedocs.functions.stem import english_stem, with_stems
from lakedocs.operators import keyword as K

SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight
knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot"""
RULES = """caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriating luxuri hopping hop hoping hope cry cri by by say say
generate generat general general generic generic communication communic arsenal arsenal skies sky dying die news news herring herring
proceed proceed agreed agre feed feed relational relat sensibility sensibl hopefulness hope national nation apology apolog controlling control
rate rate happiness happi youth youth boy boy boyish boyish dog's dog dogs' dog"""


def test_published_sample_and_rules():
    for text in (SAMPLE, RULES):
        flat = text.split()
        for word, stem in zip(flat[::2], flat[1::2], strict=True):
            assert english_stem(word) == stem, (word, english_stem(word), stem)


def test_odd_words():
    for w in ("", "a", "is", "y", "yy", "e", "ied", "ies", "ing", "eed", "'", "''", "'s", "été", "12345", "ll", "zzzz", "漢字", "s" * 10000):
        assert isinstance(english_stem(w), str)


def test_stems_in_analysis(spark):
    rows = [(1, "Consigned knights, the knight's consignment"), (2, None), (3, ""), (4, "Knights knights")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    plain = K.analyze(docs).collect()
    got = {(r.chunk_id, r.pos): r.term for r in K.analyze(docs, stemming=True).collect()}
    assert got == {(r.chunk_id, r.pos): english_stem(r.term) for r in plain} and set(got.values()) >= {"consign", "knight"}
    assert with_stems(docs.limit(0).select("text"), "text").count() == 0


def test_stems_query(spark, sf):
    from lakedocs.plans.queries_search import QUERIES

    rows = K.analyze(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select("doc_id", "term").distinct().collect()
    words, docs = defaultdict(set), defaultdict(set)
    for r in rows:
        words[english_stem(r.term)].add(r.term)
        docs[english_stem(r.term)].add(r.doc_id)
    got = {r.stem: (r.words, r.first_word, r.docs) for r in QUERIES["K1_stems"](spark, sf).collect()}
    assert got == {s: (len(words[s]), min(words[s]), len(docs[s])) for s in words}
