"""Media columns by content-defined chunking: payloads are stored as ordered lists of chunks that are kept once.

A chunk ends where a rolling gear hash of the last 32 bytes has ``BITS`` leading zeros, at least ``SHORTEST`` and at most
``LONGEST`` bytes after the cut before, so an edit moves only the cuts beside it. A chunk is known by the SHA-256 of its
bytes. Three tables come of it:

- ``payloads``: for each document the SHA-256 of its payload and the ordered chunk list (no payload bytes),
- ``chunks``: each distinct chunk once, compressed, bucketed by digest; repeated chunks are dropped before they move as
  far as one task sees them, and after the shuffle by digest for good,
- the read side joins the lists of distinct payloads with the bucketed chunks, brings each payload's chunks together in
  order, checks every digest, and computes features from the bytes so read.

The media of a document is its chunk list: the bytes ``CDC1``, the number of chunks, and length and digest of each.

Defined cases: null or empty text has the payload of 64 zero bytes; a very long text is a list of more chunks, of at most
``LONGEST`` bytes each; repeated rows and equal texts (ties) share one list and one set of chunks; a null doc_id stays
null; an empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import partitions_for, read, scratch, settle, staged, stir

UNIT, TAIL = 64, 64
BITS, SHORTEST, LONGEST = 12, 512, 16_384
LEVEL = 9
#: Payloads that one copy of a chunk serves, and bytes of payload that a task gets about.
HOT, PER_TASK = 20_000, 256 << 20
_GEAR = (stir(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last its length."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):  # after step k an entry covers 2^(k+1) bytes
        shift = 1 << k
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while at - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if at - last >= SHORTEST:
            ends.append(at)
            last = at
    while len(data) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def feature(data: bytes) -> str:
    """Mean, entropy and a sixteen-part histogram of the bytes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    parts = ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
    return f"{float((counts * np.arange(256)).sum()) / len(data):.4f};{abs(float((p * np.log2(p)).sum())):.4f};{parts}"


def _list(batches):
    for b in batches:
        out = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = payload_of(text)
            parts = chunks_of(data)
            out.append((doc, len((text or "").encode("utf-8", "surrogatepass")), hashlib.sha256(data).digest(), [hashlib.sha256(c).digest() for c in parts], [len(c) for c in parts]))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["doc_id", "n_bytes", "payload", "digests", "sizes"])


def _store(batches):
    """Distinct chunks of a task, as far as a bounded memory of digests tells."""
    known: set[bytes] = set()
    z = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        digests, data = [], []
        for text in b.column("text").to_pylist():
            for c in chunks_of(payload_of(text)):
                d = hashlib.sha256(c).digest()
                if d not in known:
                    known.add(d)
                    digests.append(d), data.append(z.compress(c))
        if len(known) > 500_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])


def _rebuild(batches):
    """Rows (payload, no, size, digest, data) in order; one row a payload comes out once its last chunk is in."""
    unpack = zstandard.ZstdDecompressor()
    key, parts, heads = None, [], []

    def whole():
        data, head = b"".join(parts), b"CDC1" + struct.pack("<I", len(heads)) + b"".join(heads)
        if hashlib.sha256(data).digest() != key:
            raise ValueError("a payload differs from its digest")
        return (
            key, len(data), zlib.crc32(data[-TAIL:]), len(head), hashlib.sha256(head).hexdigest(), feature(data),
        )

    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["payload", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)
    for b in batches:
        out = []
        for payload, size, digest, data in zip(*(b.column(c).to_pylist() for c in ("payload", "size", "digest", "data")), strict=True):
            if payload != key:
                if key is not None:
                    out.append(whole())
                key, parts, heads = payload, [], []
            chunk = unpack.decompress(data, max_output_size=LONGEST)
            if len(chunk) != size or hashlib.sha256(chunk).digest() != digest:
                raise ValueError("a chunk differs from its digest")
            parts.append(chunk), heads.append(struct.pack("<I", size) + digest)
        yield pack(out)
    if key is not None:
        yield pack([whole()])


def store_chunks(docs: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """Writes the table of distinct chunks (digest, data), bucketed by digest; the table and its name in the catalogue,
    which it keeps until it is dropped (its files stay in the shared folder)."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    once = docs.select("text").mapInArrow(_store, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    once.write.bucketBy(buckets, "digest").sortBy("digest").option("path", scratch(spark, name)).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name), name


def read_media(lists: DataFrame, chunks: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """payload, payload_bytes, tail_crc32, media_bytes, media_sha256, feature; one row a distinct payload. A chunk that more
    than ``hot`` payloads name is copied, once for each so many, and the copies are dealt out among them."""
    distinct = lists.groupBy("payload").agg(F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    entries = distinct.select("payload", F.size("sizes").alias("parts"), F.posexplode(F.arrays_zip("digests", "sizes")).alias("no", "entry")).select(
        "payload", "parts", "no", F.col("entry.digests").alias("digest"), F.col("entry.sizes").alias("size")
    )
    schema = "payload binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # A chunk that is missing must fail, not vanish: left joins. A payload of one chunk is whole where it is joined; only
    # those of several move once more, to bring their chunks together
    columns = ["payload", "no", "size", "digest", "data"]
    alone, several = entries.where("parts = 1"), entries.where("parts > 1")
    often = several.groupBy(F.col("digest").alias("often")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    often = staged(often.select("often", F.ceil(F.col("n") / hot).cast("int").alias("copies")), "op2-often")
    known = F.col("digest") == F.col("often")
    asked = several.join(often, known).withColumn("copy", F.pmod(F.xxhash64("payload", "no"), F.col("copies")).cast("int")).drop("often", "copies")
    copied = chunks.join(often, known).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("often", "copies")
    joined = several.join(often, known, "left_anti").join(chunks, "digest", "left").select(*columns).unionByName(asked.join(copied, ["digest", "copy"], "left").select(*columns))
    joined = joined.repartition(buckets, "payload").sortWithinPartitions("payload", "no")
    columns.remove("no")
    return alone.join(chunks, "digest", "left").select(*columns).mapInArrow(_rebuild, schema).unionByName(joined.select(*columns).mapInArrow(_rebuild, schema))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = staged(docs.mapInArrow(_list, "doc_id long, n_bytes long, payload binary, digests array<binary>, sizes array<int>"), "op2-lists")
    n = partitions_for(spark, (lists.agg(F.sum("n_bytes")).first()[0] or 0) // PER_TASK)
    chunks, name = store_chunks(docs, n)
    try:
        media = staged(read_media(lists.select("payload", "digests", "sizes"), chunks, n), "op2-media")
    finally:
        spark.sql(f"DROP TABLE {name}")
    return (
        lists.select("doc_id", "n_bytes", F.col("payload").alias("of"))
        .join(media, F.col("of") == F.col("payload"))
        .select(
            "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes",
            "media_sha256", "feature",
        )
    )
