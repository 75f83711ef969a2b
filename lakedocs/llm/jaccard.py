"""Exact Jaccard join of documents' n-gram sets, and the groups that its links make.

1. Equal sets are one set from here on, whatever the number of copies.
2. Of each set the shingles with the least hashes are kept (``sampled``): enough of them that
   two similar sets share ``need`` at least. Shingles are counted among these, ordered by
   rarity, and of each set only the rarest go into the index lists: leave out ``need - 1`` and
   two similar sets still meet in a list. Most sets share no rare shingle and are done.
3. Answers come in stars. Each list names a leader; sets are compared with the leaders they
   meet most, so near copies join one group after one comparison each, not one for each pair.
   Of the leaders that a set has been compared with, the one with most sets is its own: ``y``.
4. Sets of one leader answer each other from their answers with it (``_within``). What two of
   them share is either in the leader or not, so
   |x & z| <= min(|x & y|, |z & y|) + |(x - y) & (z - y)|.
   Pairs without a common shingle outside the leader need the first part alone: a join by size
   that skips what is too large or too small. The others meet in lists of what sets have beside
   their leader: lists of at most ``OFTEN`` sets in full, longer ones by size again.
5. Sets of different leaders and groups that meet in an index list are left (``_across``). Lists
   are read in blocks by set size, and blocks that cannot hold a partner are skipped: a set's
   shingles that no other set has bound its partners' sizes.
6. The pairs of 4 and 5 that no bound rules out are compared shingle by shingle, best bounds first and
   in rounds (``_settle``): groups are merged between, and pairs of one group need no comparison.

No link between different sets is lost, and no group is expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .components import least_labels
from .shared import keyed, spread_join, step
from .wordhash import NON_BLANK, mix, shingles, slices, whole, words

ROUNDS, LEADERS = 3, 2
#: Pairs of a set that the first round of ``_settle`` compares, and how many times more the next.
FIRST, MORE = 8, 8
#: A shingle of more sets of one leader makes sets of their own, whose sizes are compared first.
OFTEN = 64


def _ceil(n, num: int, den: int):
    return -(-n * num // den)


def sampled(n, num: int, den: int):
    """How many of a set's n shingles are kept: similar sets share at least ``need`` of them."""
    return n - _ceil(n, num, den) + 1 + n // 12


def need(n, num: int, den: int):
    return 1 + _ceil(n, num, den) // 12


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text one after the other, text of each)."""
    hashes, _, _, first = words(texts, NON_BLANK)
    h, at = shingles(hashes, first, k)
    text = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([whole(hashes, first[t], first[t + 1]) for t in short], np.uint64)
        h, text = np.concatenate([h, extra]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs between the entries of ``at`` (len + 1), modulo 2**64."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def describe(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(row_key, doc_id, n_shingles, low, high, tokens): set size, 128-bit signature, sample. Written.

    ``docs`` has ``_key``, which differs in all rows."""
    schema = "row_key long, doc_id long, n_shingles long, low long, high long, tokens array<long>"

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                h, text = _sets(batch.column(2)[lo:hi], k)
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                n = np.diff(at)
                kept = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(sampled(n, num, den), n)
                bound = np.concatenate([[0], np.cumsum(kept)])[at]
                tokens = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(h[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n), pa.array(_sums(mix(h), at)), pa.array(_sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)), tokens], ["row_key", "doc_id", "n_shingles", "low", "high", "tokens"])

    rows = docs.select("_key", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return step(rows.mapInArrow(scan, schema), "sets")


def index_lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(token, set_id, n, own): the rarest shingles of each set that may have a partner, and the
    share of its sample that it has alone. Written.

    reps: set_id, n_shingles, tokens.
    """
    rows = reps.select("set_id", F.col("n_shingles").alias("n"), F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = rows.join(often, "token")
    by_set = Window.partitionBy("set_id")
    size = f"cast(ceil(n * {num} / {den}d - 1e-9) as long)"
    kept = F.expr(f"n - {size} + 1 + n div 12 - ({size} div 12)")  # sampled - need + 1
    lone = F.expr(f"n - {size} + 1 + n div 12") - F.count(F.lit(1)).over(by_set)
    ranked = met.withColumn("lone", lone).withColumn("rank", F.row_number().over(by_set.orderBy("df", "token")))
    chosen = ranked.filter(F.col("rank") <= kept - F.col("lone"))
    return step(chosen.select("token", "set_id", "n", (F.col("lone") / F.expr(f"n - {size} + 1 + n div 12")).alias("own")), "lists")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) of the pairs, counted shingle by shingle."""

    def count(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x = [np.frombuffer(v, np.uint64) for v in a]
            y = [np.frombuffer(v, np.uint64) for v in b]
            common = [len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, x)), pa.int64()), pa.array(list(map(len, y)), pa.int64()), pa.array(common, pa.int64())], ["a", "b", "n_a", "n_b", "common"])

    with_a = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("a"), F.col("items").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("set_id").alias("b"), F.col("items").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, n_a long, n_b long, common long")


def _similar(common: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    return common * (num + den) >= (n_a + n_b) * num


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, first_key), a row for each row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set
    is its distinct ``k``-word shingles, of fewer words the whole sequence. Sets link when
    den * |intersection| >= num * |union|. ``component_id`` is the least doc_id reachable by
    links and ``first_key`` the row key of the group's row to keep (least doc_id, then row key).

    Null or empty text, and text of white space, has an empty set and no links, not even to its
    like. Ids may be null (the least of a group ignores them) or repeated: rows are told apart by
    ``row_key``, which is the id where ids are unique. Other columns are not read. An empty table
    has no rows.
    """
    docs = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = describe(docs, k, num, den, "doc_id", "text")
    sig = ["low", "high", "n_shingles"]
    equal = step(rows.filter("n_shingles > 0").groupBy(*sig).agg(F.min("row_key").alias("set_id"), F.min("doc_id").alias("least")), "equal")
    first = rows.join(equal.select(F.col("set_id").alias("row_key")), "row_key", "left_semi")
    lists = index_lists(first.select(F.col("row_key").alias("set_id"), "n_shingles", "tokens"), num, den)
    comps = _link(docs, rows, lists, k, num, den)

    label = F.coalesce("comp", "set_id")
    sets = equal.join(comps, "set_id", "left").select(*sig, "set_id", "least", label.alias("comp"))
    of_comp = step(sets.groupBy("comp").agg(F.min("least").alias("component_id")), "groups")
    placed = sets.join(of_comp, "comp").select(*sig, "comp", "component_id")
    out = rows.drop("tokens").join(placed, sig, "left")
    kept = out.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")).select("comp", F.col("m.row_key").alias("first_key"))
    out = out.join(kept, "comp", "left")
    return out.select("row_key", "doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first_key", "row_key").alias("first_key"))


def _link(docs, rows, lists, k, num, den) -> DataFrame:
    """(set_id, comp) of the sets that are in an index list."""
    nodes = lists.select("set_id").distinct()
    sets = _load(docs, rows.join(nodes.withColumnRenamed("set_id", "row_key"), "row_key", "left_semi"), k)
    comps = step(nodes.withColumn("comp", F.col("set_id")), "comps")
    answers = None
    for r in range(ROUNDS):
        named = lists.join(comps, "set_id")
        # First the sets with the least of their own: originals, which copies resemble more than
        # they resemble one another. Then any.
        draw = F.struct(F.col("own") if r == 0 else F.lit(0.0), F.xxhash64("set_id", F.lit(r)), "set_id", "comp", "n")
        leaders = named.groupBy("token").agg(F.min(draw).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", F.col("l.set_id").alias("b"), F.col("l.comp").alias("other"), F.col("l.n").alias("n_b"))
        # A leader of twice or half the size says nothing.
        met = named.join(leaders, "token").filter("comp <> other and n <= 2 * n_b and n_b <= 2 * n").groupBy(F.col("set_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
        if answers is not None:
            met = met.join(answers.select("a", "b"), ["a", "b"], "left_anti")
        asked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).filter(F.col("rank") <= LEADERS)
        got = step(overlaps(asked, sets), "answers")
        if got.isEmpty():
            if answers is None:  # every list holds one set
                return comps
            break
        comps = _merge(comps, got.filter(_similar(F.col("common"), F.col("n_a"), F.col("n_b"), num, den)))
        answers = got if answers is None else answers.unionByName(got)
    answers = step(answers, "answers")
    led, facts = _beside(_led(answers, comps), sets)
    # The most central set of each leader's may resemble those that the leader doesn't.
    central = led.groupBy("y").agg(F.max(F.struct(2 * F.col("shared") - F.col("n"), "set_id")).alias("m")).select("y", F.col("m.set_id").alias("b"))
    asked = led.filter("apart").join(central, "y").filter("set_id <> b and y <> b").select(F.col("set_id").alias("a"), "b")
    got = step(overlaps(asked, sets), "answers")
    comps = _merge(comps, got.filter(_similar(F.col("common"), F.col("n_a"), F.col("n_b"), num, den)))
    answers = answers.unionByName(got)
    lead = comps.select(F.col("set_id").alias("y"), F.col("comp").alias("comp_y"))
    led = led.drop("comp", "apart").join(comps, "set_id").join(lead, "y").withColumn("apart", F.col("comp") != F.col("comp_y")).drop("comp_y")
    led = step(led, "led")
    named = lists.join(comps, "set_id").join(led.select("set_id", F.col("y").alias("lead")), "set_id", "left").withColumn("lead", F.when(F.col("lead").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("lead").alias("of"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("comp").alias("of"))))
    pairs = _within(led, facts, num, den).unionByName(_across(named, sets, num, den)).groupBy("a", "b").agg(F.max("bound").alias("bound"))
    asked = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _settle(comps, pairs.join(asked, ["a", "b"], "left_anti"), sets, num, den)


def _settle(comps: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``comps`` with the links of ``pairs`` (a, b, bound), compared in rounds.

    A round compares of each set the pairs with the best bounds and merges the groups that turn out to
    be linked; pairs of one group are done then. So sets that are all alike cost a few comparisons
    each, not one for each pair. Each round takes ``MORE`` times as many pairs of a set as the one before.
    """
    left, take = step(pairs, "doubt"), FIRST
    while not left.isEmpty():
        best = Window.partitionBy("a").orderBy(F.desc("bound"), "b")
        now = step(left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= take).select("a", "b"), "asked")
        found = overlaps(now, sets).filter(_similar(F.col("common"), F.col("n_a"), F.col("n_b"), num, den))
        comps = _merge(comps, step(found, "found"))
        ends = [comps.select(F.col("set_id").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab"]
        rest = left.join(now, ["a", "b"], "left_anti").join(ends[0], "a").join(ends[1], "b").filter("c_a <> c_b")
        left, take = step(rest.select("a", "b", "bound"), "doubt"), take * MORE
    return comps


def _led(answers: DataFrame, comps: DataFrame) -> DataFrame:
    """(set_id, comp, n, y, shared, apart): each compared set with its leader, what the two share and
    whether they are of different groups. Sets of which the leader has less than half have none. Written."""
    size = answers.groupBy("b").agg(F.count(F.lit(1)).alias("sets"))
    near = answers.filter("2 * common >= n_a").join(size, "b")
    best = near.groupBy("a").agg(F.max(F.struct("sets", "b", "common", "n_a")).alias("m")).select(F.col("a").alias("set_id"), F.col("m.b").alias("y"), F.col("m.common").alias("shared"), F.col("m.n_a").alias("n"))
    lead = comps.select(F.col("set_id").alias("y"), F.col("comp").alias("comp_y"))
    own = best.join(comps, "set_id").join(lead, "y")
    return step(own.select("set_id", "comp", "n", "y", "shared", (F.col("comp") != F.col("comp_y")).alias("apart")), "led")


def _block(c: str) -> Column:
    """Sizes in steps of a fiftieth."""
    return F.floor(F.log(F.col(c).cast("double")) / float(np.log(1.02)) + 1e-9).cast("int")


def _beside(led: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(led, facts). led: with ``many``, the shingles that a set has beside its leader and that many other
    sets of the leader have too; facts: (set_id, y, item, kind), the shingles beside the leader
    that several of its sets have. Written."""
    some = led.join(led.filter("apart").select("y").distinct(), "y")

    # What each set has beside its leader. What most sets have counts to the leader from here on: it
    # may be an edited copy itself, and the bounds hold for any set.
    def beside(batches):
        for batch in batches:
            x = [np.frombuffer(v, np.uint64) for v in batch.column(2).to_pylist()]
            y = [np.frombuffer(v, np.uint64) for v in batch.column(3).to_pylist()]
            items = [np.setdiff1d(u, v, assume_unique=True) for u, v in zip(x, y, strict=True)]
            n = [len(u) for u in items]
            own, lead = (np.repeat(np.asarray(batch.column(k)), n) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(lead, pa.int64()), pa.array(np.concatenate(items).view(np.int64) if items else np.empty(0, np.int64))], ["set_id", "y", "item"])

    texts = some.select("set_id", "y").join(sets.select("set_id", F.col("items").alias("x")), "set_id").join(sets.select(F.col("set_id").alias("y"), F.col("items").alias("of_y")), "y")
    rows = step(texts.select("set_id", "y", "x", "of_y").mapInArrow(beside, "set_id long, y long, item long"), "beside")
    met = rows.groupBy("y", "item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = some.groupBy("y").agg(F.count(F.lit(1)).alias("sets"))
    met = step(met.join(sizes, "y").select("y", "item", "n", F.when(F.col("n") * 2 > F.col("sets"), "most").when(F.col("n") > OFTEN, "many").otherwise("few").alias("kind")), "met")
    facts = step(spread_join(rows, met, ["y", "item"]), "facts")
    more = facts.groupBy("set_id").agg(F.count_if(F.col("kind") == "most").alias("most"), F.count_if(F.col("kind") == "many").alias("many"))
    none = F.lit(0)
    some = some.join(more, "set_id", "left").withColumn("shared", F.col("shared") + F.coalesce("most", none)).withColumn("many", F.coalesce("many", none)).drop("most")
    some = step(some, "led")

    return some, facts


def _within(led: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, bound), a < b: sets of one leader, but of different groups, that may be similar, and what share
    of both together they can have in common.

    One of the two at least is not of the leader's group; it is on the left of each join.
    """
    some = step(led.join(led.filter("apart").select("y").distinct(), "y"), "led")

    # In the leader: what both share with it is enough for sets of no more than ``hi`` shingles.
    # Pairs that have a shingle of many sets, too, meet once more among those sets.
    def inside(rows: DataFrame, keys: list[str], shared: Column) -> DataFrame:
        hi = F.floor(F.least(F.col("n") * den / num, shared * (num + den) / num - F.col("n")) + 1e-9)
        rows = rows.withColumn("lo", F.ceil(F.col("n") * num / den - 1e-9)).withColumn("hi", hi).withColumn("held", shared).filter("lo <= hi")
        cols = ["set_id", "comp", "n", "lo", "hi", "held"]
        left = rows.filter("apart").select(*keys, *[F.col(c).alias(f"{c}_x") for c in cols]).withColumn("block", F.explode(F.sequence(_block("lo_x"), _block("hi_x"))))
        right = rows.withColumn("block", _block("n")).select(*keys, "block", *[F.col(c).alias(f"{c}_z") for c in cols])
        return left.join(right, [*keys, "block"]).filter("comp_x <> comp_z and n_z between lo_x and hi_x and n_x between lo_z and hi_z")

    base = inside(some, ["y"], F.col("shared"))
    among = inside(facts.filter("kind = 'many'").select("set_id", "item").join(some, "set_id"), ["y", "item"], F.col("shared") + F.col("many"))

    # Beside it: pairs that share such shingles, and how many.
    facts = facts.filter("kind = 'few'").select("set_id", "y", "item").join(some.select("set_id", "comp", "n", (F.col("shared") + F.col("many")).alias("shared"), "apart"), "set_id")
    x = facts.filter("apart").select("y", "item", *[F.col(c).alias(f"{c}_x") for c in ("set_id", "comp", "n", "shared")])
    z = facts.select("y", "item", *[F.col(c).alias(f"{c}_z") for c in ("set_id", "comp", "n", "shared")])
    fits = (F.col("n_x") * num <= F.col("n_z") * den) & (F.col("n_z") * num <= F.col("n_x") * den)
    both = x.join(z, ["y", "item"]).filter((F.col("comp_x") != F.col("comp_z")) & fits)
    counted = both.groupBy("set_id_x", "set_id_z").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("n_x", "n_z", "shared_x", "shared_z")])
    needed = F.ceil((F.col("n_x") + F.col("n_z")) * num / (num + den) - 1e-9)  # what similar sets share
    outside = counted.filter(F.least("shared_x", "shared_z") + F.col("c") >= needed)
    ends = [F.least("set_id_x", "set_id_z").alias("a"), F.greatest("set_id_x", "set_id_z").alias("b")]
    both_n = F.col("n_x") + F.col("n_z")
    held = (F.least("held_x", "held_z") / both_n).alias("bound")
    beside = ((F.least("shared_x", "shared_z") + F.col("c")) / both_n).alias("bound")
    return base.select(*ends, held).unionByName(among.select(*ends, held)).unionByName(outside.select(*ends, beside))


def _across(named: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, bound), a < b: sets of different groups and leaders that meet in a list and may be similar.
    (``lead`` is a set's leader, or its group where that is settled.)

    A set can share no more than what of it any other set has too, ``s`` of its n shingles; so a
    partner has at most s * (num + den) / num - n shingles. For an edited copy that is fewer than
    its original and all its other copies have, and their blocks of the list are skipped. The
    sets of a list's commonest leader are not compared with each other: they are on the right.
    """
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("lead").alias("y"), F.max("lead").alias("z")).filter("lo < hi and y < z").select("token")
    named = step(named.join(mixed, "token").select("token", "set_id", "n", "comp", "lead"), "mixed")

    def items(batches):
        for batch in batches:
            parts = [np.frombuffer(v, np.int64) for v in batch.column(1).to_pylist()]
            owner = np.repeat(np.asarray(batch.column(0)), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))], ["set_id", "item"])

    rows = sets.join(named.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "items").mapInArrow(items, "set_id long, item long")
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item")
    shared = rows.join(often, "item").groupBy("set_id").agg(F.count(F.lit(1)).alias("s"))
    low, high = F.ceil(F.col("n") * num / den - 1e-9), F.floor(F.least(F.col("n") * den / num, F.coalesce("s", F.lit(0)) * (num + den) / num - F.col("n")) + 1e-9)
    named = named.join(shared, "set_id", "left").withColumn("lo", low).withColumn("hi", high).filter("lo <= hi")
    named = step(named.select("token", "set_id", "n", "comp", "lead", "lo", "hi"), "feasible")
    largest = named.groupBy("token", "lead").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "lead")).alias("m"), F.count(F.lit(1)).alias("leads")).filter("leads > 1").select("token", F.col("m.lead").alias("largest"))
    named = named.join(largest, "token")
    cols = ["set_id", "n", "comp", "lead", "lo", "hi"]
    left = named.filter("lead <> largest").select("token", F.explode(F.sequence(_block("lo"), _block("hi"))).alias("block"), *[F.col(c).alias(f"{c}_x") for c in cols])
    right = named.select("token", _block("n").alias("block"), *[F.col(c).alias(f"{c}_z") for c in cols])
    met = left.join(right, ["token", "block"]).filter("comp_x <> comp_z and lead_x <> lead_z and n_z between lo_x and hi_x and n_x between lo_z and hi_z")
    bound = (F.least("n_x", "n_z") / (F.col("n_x") + F.col("n_z"))).alias("bound")
    return met.select(F.least("set_id_x", "set_id_z").alias("a"), F.greatest("set_id_x", "set_id_z").alias("b"), bound).distinct()


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    ends = [comps.select(F.col("set_id").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab"]
    edges = links.select("a", "b").join(ends[0], "a").join(ends[1], "b").select("c_a", "c_b").filter("c_a <> c_b")
    labels = least_labels(edges, "c_a", "c_b").withColumnRenamed("node", "comp")
    return step(comps.join(labels, "comp", "left").select("set_id", F.coalesce("label", "comp").alias("comp")), "comps")


def _load(docs, wanted, k) -> DataFrame:
    """(set_id, items): whole sets, as sorted unsigned longs, of the rows ``wanted``. Written."""

    def read(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                h, text = _sets(batch.column(1)[lo:hi], k)
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["set_id", "items"])

    texts = docs.select(F.col("_key").alias("row_key"), "text").join(wanted.select("row_key"), "row_key", "left_semi")
    return step(texts.mapInArrow(read, "set_id long, items binary"), "items")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLE = {
    "op4_ngram_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as g from d),
n as (select doc_id, len(g)::bigint as n from s),
x as (select doc_id, unnest(g) as t from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as o from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 85 * (p.n + q.n - o)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as v, doc_id as c from n union select e.b, r.c from r join e on e.a = r.v)
select n.doc_id, n.n as n_shingles, m.c as component_id from n join (select v, min(c) as c from r group by v) m on m.v = n.doc_id""",
}
