"""Token files: ids under a canonical, length-limited Huffman code with independent blocks.

``write_tokens`` encodes every text, counts all ids, fixes one code for the whole corpus and
writes blocks in ascending document order; ``read_tokens`` decodes them with a table.

Format. The files are Parquet, so any Spark-readable store holds them; a row is one block:

    shard, block      place of the block; blocks of a shard are in ascending document order
    row_keys, sizes   the block's documents (row, doc_id) and their numbers of ids
    n_ids             ids in the block
    every             a checkpoint each so many ids
    checkpoints       little-endian uint32 bit offsets of those ids in ``payload``
    payload           the bit stream, most significant bit first

The code itself (symbols in canonical order and the number of codes of each length) is one row
beside them. A block needs nothing but itself and the code. A lost task rewrites its own
blocks; Spark's committer decides which attempt counts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import new_path, written
from .tokens import TEXT_BYTES, encoder
from .wordhash import slices

MAX_BITS = 20
CHECKPOINT_EVERY = 128
BLOCK_IDS = 1 << 18
NAMES = ["doc_id", "n_tokens", "ids", "id", "n"]


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the positive counts (package-merge).

    One symbol alone gets one bit; no symbols, no code. Ties go to the smaller symbol.
    """
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[order].astype(np.float64), len(order)
    # A level's list holds coins and pairs of the level below in order of weight. Of a prefix of
    # it we need only how many coins it has: the cheapest coins, by one more bit each.
    coins_in: list[np.ndarray] = []
    pairs = np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([weight, pairs])
        rank = np.argsort(merged, kind="stable")
        coins_in.append(np.cumsum(rank < n))
        ranked = merged[rank]
        even = len(ranked) // 2 * 2
        pairs = ranked[:even:2] + ranked[1:even:2]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for coins in reversed(coins_in):
        if take <= 0:
            break
        k = int(coins[take - 1])
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by length and value, their codes)."""
    symbols = np.flatnonzero(lengths > 0)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    n = lengths[symbols]
    top = int(n.max(initial=1))
    steps = (np.int64(1) << (top - n)) if len(n) else n
    return symbols, (np.cumsum(steps) - steps) >> (top - n)


class Codec:
    """Vectorised coding and decoding under the canonical code of ``lengths``."""

    def __init__(self, lengths: np.ndarray):
        symbols, codes = canonical(lengths)
        self.lengths = lengths.astype(np.int64)
        self.top = int(lengths.max(initial=1))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = codes.astype(np.uint64)
        spans = np.int64(1) << (self.top - self.lengths[symbols])
        fill = (1 << self.top) - int(spans.sum())
        self.symbol_at = np.concatenate([np.repeat(symbols, spans), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.length_at = np.concatenate([np.repeat(self.lengths[symbols], spans), np.ones(fill, np.int64)])

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, bytes]:
        """(payload, checkpoints)."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        bits = int(ends[-1]) if len(ids) else 0
        out = np.zeros(bits // 32 + 3, np.uint64)
        if len(ids):
            word = at >> 5
            wide = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.add.reduceat(wide >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: (bits + 7) // 8], at[::every].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n_ids: int, every: int) -> np.ndarray:
        """All lanes, one from each checkpoint, step together."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint64)
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        window = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
        out = np.zeros((len(at), every), np.uint32)
        last, mask = len(window) - 1, np.uint64((1 << self.top) - 1)
        for k in range(every):
            key = window[np.minimum(at >> 3, last)] >> (40 - self.top - (at & 7)).astype(np.uint64) & mask
            out[:, k] = self.symbol_at[key]
            at += self.length_at[key]
        return out.ravel()[:n_ids]


def tokenized(docs: DataFrame, tokenizer: str, blanks: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, id, n): ids as little-endian uint32, compressed with zstd, a row per row; and
    behind a task's rows one for each ``id`` among them, with its number ``n``. The others have null there."""
    schema = "doc_id long, n_tokens int, ids binary, id int, n long"

    def encode(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        enc = encoder(tokenizer, blanks)
        total = np.zeros(0, np.int64)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts, TEXT_BYTES):
                ids, sizes = enc.encode(texts[low:high], end)
                cut = np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])
                packed = [press.compress(x.astype("<u2").tobytes() if len(x) == 0 or x.max() < 65536 else b"4" + x.tobytes()) for x in cut]
                got = np.bincount(ids)
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
                yield pa.RecordBatch.from_arrays([names[low:high], pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(high - low, pa.int32()), pa.nulls(high - low, pa.int64())], names=NAMES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def unpacked(blob: bytes) -> np.ndarray:
    """The ids of a row of :func:`tokenized`: 16 bits each, or a mark and 32 bits (an odd size)."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype(np.uint32)


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows of :func:`tokenized`; a task that made them has a row for each id at most."""
    return ids.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, blanks: str = "whole", end: int | None = None, vocabulary: int = 1 << 20, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of ``docs`` and write the token files under ``path``.

    Null text counts as empty; a null id sorts first; repeated ids keep all their rows, in any
    order among themselves; no rows make files without blocks. Other columns are not read. The
    counts sent to the driver have a row for each id of the tokenizer, at most ``vocabulary``.
    """
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer, blanks, end, id_col, text_col), "ids")
    found = count_ids(ids).limit(vocabulary + 1).toPandas()
    if len(found) > vocabulary:
        raise ValueError("more distinct ids than the vocabulary has")
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(counts)
    symbols, _ = canonical(lengths)
    spark.createDataFrame([(bytearray(symbols.astype("<u4").tobytes()), bytearray(lengths[symbols].astype("u1").tobytes()))], "symbols binary, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths.astype(np.uint8))  # a byte for each id

    def encode(batches):
        codec, shard, block = Codec(shared.value), TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                parts.append(unpacked(blob))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield row(codec, shard, block, names, parts)
                    names, parts, held, block = [], [], 0, block + 1
        if names:
            yield row(codec, shard, block, names, parts)

    def row(codec, shard, block, names, parts):
        ids = np.concatenate(parts)
        payload, marks = codec.encode(ids, CHECKPOINT_EVERY)
        values = {"shard": shard, "block": block, "doc_ids": names, "sizes": [len(x) for x in parts], "n_ids": len(ids), "every": CHECKPOINT_EVERY, "checkpoints": marks, "payload": payload}
        return pa.RecordBatch.from_pylist([values], pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("every", pa.int32()), ("checkpoints", pa.binary()), ("payload", pa.binary())]))

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.filter("id is null").select("doc_id", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(encode, "shard int, block int, doc_ids array<long>, sizes array<long>, n_ids long, every int, checkpoints binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian uint32, start in ids of all documents."""
    code = spark.read.parquet(f"{path}/code").first()
    symbols, n = np.frombuffer(code["symbols"], "<u4"), np.frombuffer(code["lengths"], "u1")
    lengths = np.zeros(int(symbols.max(initial=0)) + 1, np.uint8)
    lengths[symbols] = n
    shared = spark.sparkContext.broadcast(lengths)  # a byte for each id
    blocks = spark.read.parquet(f"{path}/blocks")
    # Shards first (one row each), then the blocks of a shard: no window over all blocks.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before")).join(before, "shard").select("shard", "block", (F.col("before") + F.col("shard_start")).alias("start"))

    def decode(batches):
        codec = Codec(shared.value)
        for batch in batches:
            for b in batch.to_pylist():
                ids = codec.decode(b["payload"], b["checkpoints"], b["n_ids"], b["every"]).astype("<u4")
                sizes = np.array(b["sizes"], np.int64)
                ends = np.cumsum(sizes)
                for low in range(0, len(sizes), 1000):
                    part = slice(low, low + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"][part], pa.int64()), pa.array(b["start"] + (ends - sizes)[part], pa.int64()), pa.array(sizes[part], pa.int64()), pa.array([ids[e - s : e].tobytes() for s, e in zip(sizes[part], ends[part], strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "sizes", "n_ids", "every", "checkpoints", "payload", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replaces ``ids`` by the unsigned CRC-32 of its bytes."""

    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), "lead", 2)
    return with_crc(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_files": op1_token_files}
