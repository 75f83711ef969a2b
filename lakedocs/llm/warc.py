"""WARC archives of pages, each record its own Zstandard frame under one shared dictionary.

A file is a skippable frame that holds the dictionary, then a frame for each record, so any
record can be read on its own once the dictionary is known. Of pages with equal payloads of at
least ``least`` bytes, the one with the largest id is kept as a response and the others are
revisits that name it.

Tasks stream their files straight to the output folder under names that no other attempt uses;
the manifest, written through Spark's committer, lists the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import new_path

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
FILE_BYTES = 64 << 20
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 32 << 10, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    inside = (uri or "")[len("<urn:page:") : -1]
    return int(inside) if inside else None


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if payload is None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a payload that doesn't match its digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To"))}


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; too few or too small samples serve as it are."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def frames(stream):
    """(is the dictionary, bytes) of each frame of a file, one at a time."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("the archive ends within a frame")
        return got

    while magic := stream.read(4):
        if struct.unpack("<I", magic)[0] == SKIPPABLE:
            yield True, take(struct.unpack("<I", take(4))[0])
            continue
        if magic != FRAME:
            raise ValueError("not a frame")
        out = [magic, take(1)]
        flags = out[1][0]
        single = flags >> 5 & 1
        out.append(take((not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])))
        last = False
        while not last:
            out.append(take(3))
            word = int.from_bytes(out[-1], "little")
            last = bool(word & 1)
            out.append(take(1 if word >> 1 & 3 == 1 else word >> 3))
        if flags >> 2 & 1:
            out.append(take(4))
        yield False, b"".join(out)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, refers_to) of the revisits alone."""
    long = pages.filter(F.col("payload_bytes") >= least)
    keys = ["payload_digest", "payload_bytes"]
    kept = long.groupBy(keys).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return long.select("page_id", *keys).join(kept, keys).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).dropDuplicates(["page_id", *keys])


def write_warc(pages: DataFrame, path: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``pages`` as archives under ``path``.

    Null payload counts as empty, a null url is left out. A null id is the smallest; rows that
    share the largest id of their payload are all responses. No rows make no archive.
    Other columns are not read. The dictionary comes from at most ``SAMPLE_ROWS`` records of at
    most ``SAMPLE_BYTES``, those with the least hash.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # Which records: by narrow rows, so that tasks send the driver no payloads but the sample's.
    order = rows.filter(F.col("payload_bytes") <= SAMPLE_BYTES).select(F.xxhash64("page_id", "payload_digest").alias("h"), F.col("page_id").alias("p"), F.col("payload_digest").alias("d"))
    chosen = F.broadcast(order.orderBy("h").limit(SAMPLE_ROWS).select("p", "d").distinct())  # SAMPLE_ROWS rows
    some = rows.join(chosen, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))).dropDuplicates(["page_id", "payload_digest"]).orderBy("payload_digest").collect()  # SAMPLE_ROWS * SAMPLE_BYTES at most
    words = train([record(r["page_id"], r["url"], bytes(r["payload"]), r["payload_digest"], r["payload_bytes"], None) for r in some])
    shared = spark.sparkContext.broadcast(words)  # DICTIONARY_BYTES at most

    again = plan_revisits(rows.drop("payload", "url"), least)
    on = (F.col("a.payload_digest") == F.col("b.payload_digest")) & (F.col("a.payload_bytes") == F.col("b.payload_bytes")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    all_rows = rows.alias("a").join(again.alias("b"), on, "left").select("a.page_id", "a.url", F.when(F.col("b.payload_digest").isNull(), F.col("a.payload")).alias("payload"), "a.payload_digest", "a.payload_bytes", "b.refers_to")

    def write(batches):
        import zstandard

        held = shared.value
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held) if held else None, write_checksum=True, write_content_size=True)
        fs, folder = _open(path)
        fs.create_dir(f"{folder}/archive", recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    out, n = fs.open_output_stream(f"{folder}/archive/{name}"), 0
                    size = out.write(struct.pack("<II", SKIPPABLE, len(held)) + held) or len(held)
                frame = press.compress(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    all_rows.mapInArrow(write, "file string, records long, bytes long").write.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record."""

    def read(batches):
        import zstandard

        fs, folder = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/archive/{name}") as stream:
                    press, rows, held = zstandard.ZstdDecompressor(), [], 0
                    for is_words, data in frames(stream):
                        if is_words:
                            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
                            continue
                        rows.append(parse(press.decompress(data)))
                        held += rows[-1]["payload_bytes"]
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    files = spark.read.parquet(f"{path}/manifest").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc_dictionary": op7_warc_dictionary}
ORACLE = {
    "op7_warc_dictionary": """
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select h, max(page_id) as keep from p where octet_length(encode(h)) >= 1000 group by h)
select p.page_id, octet_length(encode(p.h))::bigint as payload_bytes, sha1(p.h) as payload_digest,
       case when k.keep is not null and k.keep <> p.page_id then 'revisit' else 'response' end as record_type,
       case when k.keep is not null and k.keep <> p.page_id then k.keep end as refers_to
from p left join k on p.h = k.h""",
}
