"""What op1's encoding keeps between slices, and where its ids are counted."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lakedocs.llm import token_files as TF, tokens


@pytest.mark.parametrize("name, blanks", [("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")])
@pytest.mark.parametrize("kept", [0, 3000, 1 << 20])
def test_kept_pieces_change_no_ids(monkeypatch, name, blanks, kept):
    """A piece goes through the library once while there is room for it; ids are the library's, whatever is kept."""
    monkeypatch.setattr(tokens, "KEPT", kept)
    enc = tokens.PieceEncoder(public_tokenizers.path(name), blanks)
    seen, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda strings: seen.extend(strings.to_pylist()) or learn(strings))
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghéßñ", k=r.randrange(3, 9))) for _ in range(4000)] + ["x" * 40 + str(k) for k in range(50)]
    for part in range(3):
        texts = [" ".join(r.sample(words, 1500)) + r.choice([".", "\nEnd!", "  two", ""]) for _ in range(6)] + [None, ""]
        seen.clear()
        ids, sizes = enc.encode(pa.array(texts), 7)
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        if part == 2 and kept == 1 << 20:
            assert len(seen) < 1500, "all pieces went through the library again"
        assert len(enc.kept) <= kept and (not kept or len(enc.kept) > 2000)
        assert len(enc.kept_sizes) == len(enc.kept) and enc.kept_sizes.sum() == len(enc.kept_ids)


def test_ids_are_counted_while_they_are_made(spark):
    """No second pass over the ids: rows of counts stand behind the documents'."""
    docs = spark.createDataFrame([(None, "a b a"), (1, None), (2, ""), (2, "b\nb")], "doc_id long, text string").repartition(2)
    made = TF.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), "lead", 2).cache()
    rows = made.filter("id is null").collect()
    every = np.concatenate([TF.unpacked(x["ids"]) for x in rows])
    assert len(rows) == 4 and sorted((x["doc_id"] or 0, x["n_tokens"]) for x in rows) == [(0, 4), (1, 1), (2, 1), (2, 4)]
    counts = TF.count_ids(made)
    assert {x["id"]: x["n"] for x in counts.collect()} == dict(zip(*[v.tolist() for v in np.unique(every, return_counts=True)], strict=True))
    assert "MapInArrow" not in TF.count_ids(spark.createDataFrame([], made.schema))._jdf.queryExecution().optimizedPlan().toString()
