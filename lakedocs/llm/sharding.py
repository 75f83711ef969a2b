"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's key hashes to a place on the ring; the next virtual node clockwise names its shard. A
shard takes its capacity and no more, and what overflows goes on clockwise to the next shard
with room. All rows of one arc (the places before one virtual node) walk the same shards, so the
walk is planned from the number of rows in each arc: a table of the ring's size, whatever the
input. Each row then finds its shard from its rank within its arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import written

PLACES = 1 << 16


def _hash(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 48)


def ring(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise. A node depends on its shard and number
    alone, so one more shard adds nodes and moves none."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("nth"))
    found = nodes.select(_hash(F.lit("node"), "shard", "nth").alias("place"), "shard").collect()  # shards * virtual rows
    first: dict[int, int] = {}
    for place, shard in sorted((r["place"], r["shard"]) for r in found):
        first.setdefault(place, shard)
    return sorted(first.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """With no slack the capacities sum to ``total``, at most one apart; else (1 + slack) times the mean."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-total * (1 + slack) // shards)] * shards


def walk(nodes: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): in round r every arc offers what it still
    holds to the r-th shard on its way, arcs clockwise from place 0."""
    n, free = len(nodes), list(room)
    ways = []
    for k in range(n):
        way: list[int] = []
        for j in range(n):
            s = nodes[(k + j) % n][1]
            if s not in way:
                way.append(s)
                if len(way) == len(room):
                    break
        ways.append(way)
    done, out = [0] * n, []
    for r in range(len(room)):
        for k in range(n):
            left = counts.get(k, 0) - done[k]
            if left and r < len(ways[k]):
                s = ways[k][r]
                take = min(left, free[s])
                if take:
                    out.append((k, done[k], done[k] + take, s, room[s] - free[s]))
                    done[k] += take
                    free[s] -= take
    assert all(done[k] == c for k, c in counts.items()), "the shards together have too little room"
    return out


def shard(rows: DataFrame, keys: list[str], shards: int = 16, virtual: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 within the shard) and ``home``, the
    shard that the key has on an unbounded ring.

    Keys may be null (they hash as null) or repeated: rows of one key lie in one arc and share
    its walk. Which of an arc's rows go on is settled by the hash of all their columns, never by
    input order or partitions; rows equal in all columns are interchangeable, and are counted
    before they move. An empty table has no rows in any shard. ``rows`` must be narrow, of types
    that can be grouped. Columns named shard, slot or home are replaced.

    One more shard takes rows from all others; with no slack, the capacities of the old shards
    shrink at once, and what they no longer hold goes on clockwise, some of it to other old
    shards: see ``tests/llm`` for figures.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "home")
    columns = rows.columns
    nodes = ring(spark, shards, virtual)
    ends = [p for p, _ in nodes]
    arcs = [(k, (ends[k - 1] + 1) if k else 0, ends[k], nodes[k][1]) for k in range(len(ends))]
    if ends[-1] < PLACES - 1:
        arcs.append((0, ends[-1] + 1, PLACES - 1, nodes[0][1]))
    places = spark.createDataFrame(arcs, "_arc int, low int, high int, home int").select("_arc", "home", F.explode(F.sequence("low", "high")).alias("_place"))

    # 64 parts of an arc, so that one repeated key does not fill a task.
    once = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    placed = once.withColumn("_place", _hash(*keys).cast("int")).withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(64)).cast("int"))
    placed = written(placed.join(F.broadcast(places), "_place").drop("_place"), "placed")  # PLACES rows

    by_part = placed.groupBy("_arc", "_part").agg(F.sum("_n").alias("n"))
    earlier = Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = written(by_part.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "arcs")
    counts = {r["_arc"]: r["n"] for r in before.groupBy("_arc").agg(F.sum("n").alias("n")).collect()}  # a row for each virtual node
    plan = walk(nodes, counts, capacities(sum(counts.values()), shards, slack))

    # The plan's ranges cut by part: a part's rows lie in few of them.
    ranges = spark.createDataFrame(plan, "_arc int, _low long, _high long, shard int, _slot long")
    lists = ranges.groupBy("_arc").agg(F.collect_list(F.struct("_low", "_high", "shard", "_slot")).alias("_ranges"))  # at most ``shards`` for each arc
    inside = lambda x: (x["_high"] > F.col("_before")) & (x["_low"] < F.col("_before") + F.col("n"))
    known = before.join(F.broadcast(lists), "_arc").select("_arc", "_part", "_before", F.filter("_ranges", inside).alias("_ranges"))
    order = Window.partitionBy("_arc", "_part").orderBy(F.xxhash64(*columns), *columns)
    nth = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranked = placed.withColumn("_nth", nth).join(F.broadcast(known), ["_arc", "_part"])  # 64 rows for each virtual node
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_before") + F.col("_nth"), F.col("_before") + F.col("_nth") + F.col("_n") - 1)))
    hit = F.filter("_ranges", lambda x: (x["_low"] <= F.col("_rank")) & (x["_high"] > F.col("_rank")))[0]
    return ranked.withColumn("_hit", hit).select(*columns, "home", F.col("_hit.shard").alias("shard"), (F.col("_hit._slot") + F.col("_rank") - F.col("_hit._low")).alias("slot"))


def op3_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(rows, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


QUERIES = {"op3_consistent_ring": op3_consistent_ring}
