"""Ordinal quality classifier: cumulative-link regression on hashed text.

Grades are ordered; one weight for each hashed feature gives a text's score s, and thresholds
t0 < t1 < ... cut it into grades: P(grade <= k) = sigmoid(t_k - s). Features say which words,
word beginnings and word ends a text has, so a long text isn't diluted; a penalty on the sum of
absolute weights leaves most of them zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import free_name
from .wordhash import _BASE, _BASE_INV, _BYTE, LOWER, NON_BLANK, _power, mix, slices, text_bytes

BITS = 18
SAMPLE_PER_GRADE = 2000
ROUNDS, PENALTY, STEP = 250, 1e-3, 0.1


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last, a row a text."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), distinct and sorted; of the features that are true in ``wanted`` only."""
    raw, at = text_bytes(texts)
    mask = NON_BLANK[raw]
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * _power("up", _BASE, len(raw))[: len(raw)], out=total[1:])
    down = _power("down", _BASE_INV, len(raw))
    text = np.searchsorted(at, starts, "right") - 1
    found = []
    for kind, (a, b) in enumerate(((starts, ends), (starts, np.minimum(ends, starts + 5)), (np.maximum(starts, ends - 2), ends))):
        code = (mix((total[b] - total[a]) * down[a] + np.uint64(kind + 1)) >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[code]
            found.append(text[keep] << BITS | code[keep])
        else:
            found.append(text << BITS | code)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _runs(bound: np.ndarray, most: int = 256):
    """Runs of texts, so that what a step needs follows neither the sample nor its texts' lengths."""
    return ((lo, min(lo + most, len(bound) - 1)) for lo in range(0, len(bound) - 1, most))


def _by_text(w: np.ndarray, code: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's features."""
    out = np.zeros(len(bound) - 1)
    for lo, hi in _runs(bound):
        total = np.concatenate([[0], np.cumsum(w[code[bound[lo] : bound[hi]]])])
        at = bound[lo : hi + 1] - bound[lo]
        out[lo:hi] = total[at[1:]] - total[at[:-1]]
    return out


def _by_feature(d_score: np.ndarray, code: np.ndarray, bound: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for lo, hi in _runs(bound):
        out += np.bincount(code[bound[lo] : bound[hi]], np.repeat(d_score[lo:hi], np.diff(bound[lo : hi + 1])), n)
    return out


def train(texts: pa.Array, grades: np.ndarray, share: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """``share``: each text's weight. Features of fewer than three texts are left out."""
    n, top = len(grades), int(grades.max())
    counts, rows = [], []
    for lo, hi in slices(texts):
        t, f = features(texts[lo:hi])
        counts.append(np.bincount(t, minlength=hi - lo))
        rows.append(f.astype(np.int32))
    code = np.concatenate(rows) if rows else np.empty(0, np.int32)
    sizes = np.concatenate(counts) if counts else np.zeros(n, np.int64)
    del rows
    often = np.bincount(code, minlength=1 << BITS) >= 3
    used = np.flatnonzero(often)
    keep = often[code]
    text = np.repeat(np.arange(n, dtype=np.int32), sizes)[keep]
    code = (np.cumsum(often, dtype=np.int32) - 1)[code[keep]]
    bound = np.searchsorted(text, np.arange(n + 1))
    del text, keep
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-12)
    share = share / share.sum()
    cum = np.array([share[grades <= k].sum() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    t = np.log(cum / (1 - cum))
    gaps, gap_seen = np.concatenate([t[:1], np.log(np.diff(t).clip(1e-2))]), np.full(top, 1e-12)
    for _ in range(rounds):
        cuts = np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))])
        score = _by_text(w, code, bound)
        p = Model(w, cuts).below(score)
        full = np.concatenate([np.zeros((n, 1)), p, np.ones((n, 1))], 1)
        rows = np.arange(n)
        slope = full * (1 - full)
        prob = (full[rows, grades + 1] - full[rows, grades]).clip(1e-9)
        # d(-log prob)/d score and /d threshold k
        d_score = share * (slope[rows, grades + 1] - slope[rows, grades]) / prob
        d_cut = np.array([-(share * slope[:, k + 1] * ((grades == k) * 1.0 - (grades == k + 1)) / prob).sum() for k in range(top)])
        d_gap = np.array([d_cut.sum(), *[np.exp(gaps[k]) * d_cut[k:].sum() for k in range(1, top)]])
        g = _by_feature(d_score, code, bound, len(used))
        seen += g * g
        step = STEP / np.sqrt(seen)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        gap_seen += d_gap * d_gap
        gaps = gaps - STEP / np.sqrt(gap_seen) * d_gap
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int = SAMPLE_PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on a sample of labelled rows: of each grade the ``per_grade`` with the least hash of the id,
    weighted so that the grades have their shares of all labels. Labels without a grade, an id or
    a document are left out; an id that is repeated brings each of its rows, up to twice
    ``per_grade`` a grade in all. Without labels of two grades there is no model: None.
    """
    rated = labels.select(F.col(id_col).cast("long").alias("_id"), grade.cast("int").alias("_grade")).filter("_id is not null and _grade >= 0")
    counts = {r["_grade"]: r["n"] for r in rated.groupBy("_grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each grade
    # A hash below a threshold from the grade's count passes: half as many again as are wanted, and a
    # few. Only these are ranked.
    least = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, (1.5 * per_grade + 50) / n)]) if counts else F.lit(None)
    passed = rated.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.try_element_at(least, F.col("_grade")) * (1 << 30)) if counts else rated
    order = Window.partitionBy("_grade").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id")
    chosen = passed.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= per_grade)
    some = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_grade", "_id")
    # Repeated ids may give more rows: those of the least hashes are taken.
    some = some.orderBy(F.xxhash64("_id", "_text"), "_grade").limit(2 * per_grade * max(1, len(counts)))
    def learn(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by([("_id", "ascending"), ("_text", "ascending"), ("_grade", "ascending")])
        grades = table["_grade"].to_numpy()
        kinds = sorted(set(grades.tolist()))
        if len(kinds) < 2:
            return
        have = {k: int((grades == k).sum()) for k in kinds}
        model = train(table["_text"].combine_chunks(), grades, np.array([counts[k] / have[k] for k in grades.tolist()]))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()]}, pa.schema([("weights", pa.binary()), ("thresholds", pa.list_(pa.float64()))]))

    # The sample has a stated bound, so one task holds it; the driver sees the model alone.
    found = some.coalesce(1).mapInArrow(learn, "weights binary, thresholds array<double>").collect()
    return Model(np.frombuffer(found[0]["weights"], np.float32), np.array(found[0]["thresholds"])) if found else None


def scored(docs: DataFrame, model: Model | None, tail: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability``, P(grade >= tail).

    Null or empty text has no features: its scores are those of the thresholds alone. Without a
    model both are null. Columns of those names are replaced, all others are kept.
    """
    docs = docs.drop("expected_grade", "tail_probability")
    if model is None:
        return docs.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("tail_probability", F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each of 2**BITS features

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rate(text):
        import pandas as pd

        m = shared.value
        texts = pa.array(text, pa.string(), from_pandas=True)
        score = np.zeros(len(texts))
        for lo, hi in slices(texts):
            t, f = features(texts[lo:hi], m.weights != 0)
            score[lo:hi] = np.bincount(t, m.weights[f], hi - lo)
        p = m.below(score)
        return pd.DataFrame({"expected_grade": (1 - p).sum(1), "tail_probability": 1 - p[:, tail - 1]})

    both = free_name(docs, "_rated")
    rated = docs.withColumn(both, rate(F.col(text_col).cast("string")))
    return rated.withColumns({c: F.col(f"{both}.{c}") for c in ("expected_grade", "tail_probability")}).drop(both)


GOOD, KEEP_FROM = 2, 0.4


def label_grade() -> Column:
    """Grades of the labels: toxic text, other poor text, good text."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, GOOD)


def select_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose probability of the good grade is at least ``keep_from``, with their
    scores. Without a model nothing can be rejected, and all stay."""
    model = fit(docs, labels, label_grade())
    rated = scored(docs, model, GOOD)
    return rated if model is None else rated.filter(F.col("tail_probability") >= keep_from)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"))


QUERIES = {"op8_ordinal_quality": op8_ordinal_quality}
