"""Fusing two rankings, cutting, diversifying and widening hits.

hits: query_id, chunk_id, score, rank
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import token_set
from ..sources.stage import staged
from .vectors import ranked

NONE = 10**9
#: Hits that are sent to all tasks at most.
SENT = 100_000


def fuse_rrf(vec: DataFrame, kw: DataFrame, alpha: float = 0.7, c: int = 60) -> DataFrame:
    """Weighted reciprocal ranks; a chunk missing from a leg ranks ``NONE`` there."""
    j = _both(vec, kw)
    r = lambda x: F.coalesce(F.col(x), F.lit(NONE))
    score = F.lit(alpha) / (c + r("rank_v")) + F.lit(1 - alpha) / (c + r("rank_k"))
    return ranked(j.select("query_id", "chunk_id", "score_v", "score_k", score.alias("score")))


def fuse_minmax(vec: DataFrame, kw: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Each leg scaled to 0..1 within its question (0 where all are equal), then weighted."""
    over = Window.partitionBy("query_id")

    def scaled(df):
        low, high = F.min("score").over(over), F.max("score").over(over)
        return df.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))

    j = _both(scaled(vec), scaled(kw))
    score = alpha * F.coalesce("score_v", F.lit(0.0)) + (1 - alpha) * F.coalesce("score_k", F.lit(0.0))
    return ranked(j.select("query_id", "chunk_id", "score_v", "score_k", score.alias("score")))


def _both(vec: DataFrame, kw: DataFrame) -> DataFrame:
    v = vec.select("query_id", "chunk_id", F.col("score").alias("score_v"), F.col("rank").alias("rank_v"))
    k = kw.select("query_id", "chunk_id", F.col("score").alias("score_k"), F.col("rank").alias("rank_k"))
    return v.join(k, ["query_id", "chunk_id"], "full")


def merge_hits(vec: DataFrame, kw: DataFrame) -> DataFrame:
    """One row a chunk; the keyword leg's fields go before the vector leg's."""
    keys = ["query_id", "chunk_id"]
    rest = [c for c in dict.fromkeys([*vec.columns, *kw.columns]) if c not in keys]
    j = vec.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in vec.columns if c not in keys]).join(kw.select(*keys, *[F.col(c).alias(f"_k_{c}") for c in kw.columns if c not in keys]), keys, "full")
    return j.select(*keys, *[F.coalesce(*[F.col(f"_{leg}_{c}") for leg, df in (("k", kw), ("v", vec)) if c in df.columns]).alias(c) for c in rest])


def fetched(hits: DataFrame, chunks: DataFrame, most: int = SENT) -> DataFrame:
    """``hits`` with the columns of their ``chunks`` (chunk_id, ...). Up to ``most`` hits go to the chunks, so that no text is
    shuffled or sorted but those of hits; more are joined as Spark sees fit."""
    hits = staged(hits, "found")
    return chunks.join(F.broadcast(hits) if hits.count() <= most else hits, "chunk_id").select(*hits.columns, *[c for c in chunks.columns if c != "chunk_id"])


def top_n(df: DataFrame, n: int) -> DataFrame:
    return ranked(df.drop("rank"), n)


def rerank(df: DataFrame, scorer: Column) -> DataFrame:
    """New scores from a Column or a pandas UDF applied to columns; nulls score 0."""
    return ranked(df.drop("rank").withColumn("score", F.coalesce(scorer.cast("double"), F.lit(0.0))))


def boost_types(df: DataFrame, wanted: Column, by: float = 0.05) -> DataFrame:
    overlap = F.coalesce(F.arrays_overlap("types", wanted), F.lit(False))
    return ranked(df.drop("rank").withColumn("score", F.col("score") + F.when(overlap, by).otherwise(0.0)))


def mmr(df: DataFrame, k: int, lam: float = 0.65, most: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank): picks by lam * score - (1 - lam) * likeness to those picked,
    up to 2k, the best score first. Candidates stand by score, then chunk_id, and of equal worth
    the first is picked. Only the first ``max(most, 4k)`` of a question enter, so a group is bounded."""
    cut = top_n(df, max(most, 4 * k)).withColumn("tokens", token_set(F.col("text")))
    qid, cid = (cut.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        ids, scores, sets = pdf["chunk_id"].tolist(), pdf["score"].tolist(), [set(t) for t in pdf["tokens"]]
        likes, chosen, left = [0.0] * len(ids), [], list(range(len(ids)))
        while left and len(chosen) < 2 * k:
            best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * likes[i], -i)) if chosen else left[0]
            chosen.append(best)
            left.remove(best)
            for i in left:
                union = len(sets[i] | sets[best])
                likes[i] = max(likes[i], len(sets[i] & sets[best]) / union if sets[i] and sets[best] else 0.0)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(chosen), "chunk_id": [ids[i] for i in chosen], "score": [scores[i] for i in chosen], "rank": range(1, len(chosen) + 1)})

    return cut.select("query_id", "chunk_id", "score", "rank", "tokens").groupBy("query_id").applyInPandas(pick, f"query_id {qid}, chunk_id {cid}, score double, rank int")


def cap_hits(hits: DataFrame, per_doc: int = 3, k: int = 8) -> DataFrame:
    """At most ``per_doc`` hits of a document in rank order, then the first k."""
    rows = hits.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).filter(F.col("_d") <= per_doc)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.filter(F.col("rank") <= k).drop("_d")


def safety_net(queries: DataFrame, hits: DataFrame, corpus: DataFrame, k: int = 8) -> DataFrame:
    """Hits for questions that have none: the longest table chunks of a numeric one (.01), else the
    longest chunks (.005), within its ``doc_ids``, ``sets`` and ``types`` if it has any.

    The corpus is cut to its k longest before it meets the questions without restrictions, and so is each set. It may
    have ``n_text``, its texts' lengths, in place of ``text``.
    """
    from ..functions.text import is_numeric_question

    empty = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("numeric", is_numeric_question(F.col("q")))
    text = "n_text" if "n_text" in corpus.columns else "text"
    order = [F.desc(text if text == "n_text" else F.length("text")), "chunk_id"]
    tables = corpus.filter(F.array_contains("types", "table"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    of_set = None
    if "sets" in empty.columns and "sets" in corpus.columns:
        of_set, empty = empty.filter(size("sets") > 0), empty.filter(size("sets") <= 0)
    free = empty.filter((size("doc_ids") <= 0) & (size("types") <= 0)).select("query_id", "numeric")
    top = tables.orderBy(*order).limit(k).withColumn("numeric", F.lit(True)).unionByName(corpus.orderBy(*order).limit(k).withColumn("numeric", F.lit(False)))
    top = top.select("chunk_id", "doc_id", text, "types", "numeric")
    one = free.join(F.broadcast(top), "numeric")  # 2k rows
    bound = empty.filter((size("doc_ids") > 0) | (size("types") > 0)).select("query_id", "numeric", F.col("types").alias("want"), F.explode_outer(F.when(size("doc_ids") > 0, F.col("doc_ids"))).alias("only"))
    c = corpus.select("chunk_id", "doc_id", text, "types")
    with_docs = bound.filter("only is not null").join(c, F.col("only") == F.col("doc_id"))
    # By type: of each type (and of its tables) the k longest, then the questions that want it.
    table = F.array_contains("types", "table")
    typed = c.withColumns({"t": F.explode(F.array_distinct("types")), "numeric": F.explode(F.when(table, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))})
    typed = typed.withColumn("nth", F.row_number().over(Window.partitionBy("t", "numeric").orderBy(*order))).filter(F.col("nth") <= k).drop("nth")
    with_types = bound.filter("only is null").withColumn("t", F.explode(F.array_distinct("want"))).join(typed, ["t", "numeric"])
    two = with_docs.select("query_id", "numeric", "want", "chunk_id", "doc_id", text, "types").unionByName(with_types.select("query_id", "numeric", "want", "chunk_id", "doc_id", text, "types")).distinct()
    two = two.filter(((size("want") <= 0) | F.arrays_overlap("types", "want")) & (~F.col("numeric") | F.array_contains("types", "table"))).drop("want")
    every = one.select("query_id", "numeric", "chunk_id", "doc_id", text, "types").unionByName(two)
    if of_set is not None:
        # Of each set, and of each type in it, the k longest (tables), then the questions that ask for it; no type: any.
        within = corpus.filter(size("sets") > 0).select("chunk_id", "doc_id", text, "types", F.explode("sets").alias("s"))
        kinds = F.array_union(F.coalesce("types", F.array().cast("array<string>")), F.array(F.lit("")))
        within = within.withColumn("t", F.explode(kinds)).withColumn("numeric", F.explode(F.when(F.coalesce(table, F.lit(False)), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        within = within.withColumn("nth", F.row_number().over(Window.partitionBy("s", "t", "numeric").orderBy(*order))).filter(F.col("nth") <= k).drop("nth")
        asks = of_set.select("query_id", "numeric", F.explode("sets").alias("s"), F.when(size("types") > 0, F.array_distinct("types")).otherwise(F.array(F.lit(""))).alias("t")).withColumn("t", F.explode("t"))
        every = every.unionByName(asks.join(within, ["s", "t", "numeric"]).select(*every.columns).distinct())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", F.when(F.col("numeric"), 0.01).otherwise(0.005)).drop("numeric", "types")


def expand_window(hits: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first n hits of a question take in the chunks before and after theirs (by span start, of
    another start); adds ``window_expanded``. Neighbours are looked for in the hits' documents
    alone, by id, and their texts fetched last."""
    first = F.col("rank") <= n
    docs = staged(hits.filter(first).select("doc_id").distinct(), "hit-docs")
    some = chunks.join(docs, "doc_id", "left_semi")
    starts = some.groupBy("doc_id", "span_start").agg(F.min(F.struct("chunk_id", "span_end")).alias("c"))
    by = Window.partitionBy("doc_id").orderBy("span_start")
    near = starts.select("doc_id", "span_start", F.lag("c").over(by)["chunk_id"].alias("_p"), F.lead("c").over(by).alias("x"), F.lag("span_start").over(by).alias("p_start"))
    near = near.select("doc_id", "span_start", "_p", F.col("x.chunk_id").alias("_x"), "p_start", F.col("x.span_end").alias("_end"))
    j = hits.join(near, ["doc_id", "span_start"], "left")
    for key, text in (("_p", "_before"), ("_x", "_after")):
        j = j.join(some.select(F.col("chunk_id").alias(key), F.col("text").alias(text)), key, "left")
    grown = first & (F.col("_before").isNotNull() | F.col("_after").isNotNull())
    return j.withColumns({
        "text": F.when(grown, F.concat_ws("\n\n", "_before", "text", "_after")).otherwise(F.col("text")),
        "span_start": F.when(first, F.coalesce("p_start", "span_start")).otherwise(F.col("span_start")),
        "span_end": F.when(first, F.greatest("span_end", F.coalesce("_end", "span_end"))).otherwise(F.col("span_end")),
        "window_expanded": F.coalesce(grown, F.lit(False)),
    }).select(*[c for c in hits.columns], "window_expanded")
