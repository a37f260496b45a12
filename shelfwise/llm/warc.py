"""WARC: a deterministic sharded writer and its reader.

Records are sorted by (page_id, payload digest) and cut into shards, ranges of that key of about ``SHARD`` bytes of payload
each. The cuts are taken from the keys with the lowest hashes, so they depend on the rows alone, not on how these are
partitioned or sampled, and a rerun writes the same files. Each task writes its shard in order, every record as its own
gzip member, and begins a new file once the current one has ``ROLL`` compressed bytes. Headers and digests are made anew
from the payload; there is no clock and no random number in them. A file gets its name only when it is whole (written
under a temporary name and moved), and counts only when the manifest lists it, so a task that runs again does no harm. Of
records with equal payloads of at least ``LEAST`` bytes the one with the largest page_id is a response; the others become
revisit records without the payload.

Files lie in the folder that spark.checkpoint.dir names, and are opened by pyarrow.fs, which reaches local or mounted
folders and the usual object stores.

Defined cases: null html is an empty payload, a very long one is one record; null page_ids sort first, by digest, and
revisit a response that has an id; if none has one, records stay responses, as do repeated rows of the largest page_id;
rows that tie in page_id and digest stand together, in the order of their url; a null url is left out of the headers; an
empty table gives no files and an empty result. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import LongType

from shelfwise.llm.common import partitions_for, read, scratch, settle, staged

SHARD, ROLL, LEAST = 64 << 20, 64 << 20, 1000
#: For very large inputs shards grow, so that there are no more of them; a cut is drawn from so many keys a shard.
MOST_SHARDS, KEYS = 10_000, 50
DATE = "2024-01-01T00:00:00Z"


def _record_id(page, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest_hex}')}>"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _one(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, sha.hexdigest())), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, sha.hexdigest())),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    headers += [
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", _b32(sha.digest())),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _one(headers, block)


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.store, self.folder, self.name = store, folder, name
        self.temporary = f"{folder}/_temporary-{name}-{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.temporary)
        self.bytes = self.records = 0
        self.sha = hashlib.sha1()
        self.add(_one([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _write(uri: str, roll: int):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(uri)
        open_file, shard, no, revisit, done = None, None, 0, None, []
        for b in batches:
            for at, page, digest, kind, url, html, target in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "html", "refers_to")), strict=True):
                if kind == 0:  # says where the page that follows refers to
                    revisit = (page, digest, target)
                    continue
                if at != shard or open_file.bytes >= roll:
                    if open_file:
                        done.append(open_file.close())
                    no = no + 1 if at == shard else 0
                    shard = at
                    open_file = _File(store, folder, f"pages-{at:05d}-{no:05d}.warc.gz")
                to = revisit[2] if revisit and revisit[:2] == (page, digest) else None
                open_file.add(record(page, url, (html or "").encode(), to))
        if open_file:
            done.append(open_file.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha1"])

    return run


def cuts(rows: DataFrame, shard: int) -> list[tuple[bool, int, int]]:
    """Keys (page_id is not null, page_id, head of the digest) at which shards begin, but for the first; ``rows`` has page_id,
    head and size. The keys they are drawn from are a bounded number: those with the lowest hashes."""
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, -(-size // shard))
    if shards < 2:
        return []
    lowest = rows.select("page_id", "head", "size").orderBy(F.xxhash64("page_id", "head"), "page_id", "head", "size").limit(KEYS * shards).collect()
    # Every key stands for as many bytes as its payload
    keys = sorted((r.page_id is not None, r.page_id or 0, r.head, r.size) for r in lowest)
    total, held, found = sum(k[3] + 1 for k in keys), 0, []
    for k in keys:
        if held >= total * (len(found) + 1) / shards:
            found.append(k[:3])
        held += k[3] + 1
    return sorted(set(found))


def write_warc(pages: DataFrame, uri: str, shard: int = SHARD, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Writes the archives below ``uri`` and returns the manifest: file, records, bytes, sha1."""
    spark = pages.sparkSession
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(f"{folder}/data", recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sums = staged(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size"), F.conv(F.left("digest", F.lit(15)), 16, 10).cast("long").alias("head")), "warc-sums")
    bounds = cuts(sums, shard)
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf(LongType())
    def shard_of(page: pa.Array, head: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value, (p is not None, p or 0, h)) for p, h in zip(page.to_pylist(), head.to_pylist(), strict=True)], pa.int64())

    large = sums.where(F.col("size") >= least)
    last = large.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = (
        large.hint("merge").join(staged(last, "warc-last"), F.col("digest") == F.col("d"))
        .where("refers_to is not null and not (page_id <=> refers_to)")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    none = F.lit(None).cast("string")
    lines = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(
        others.select("page_id", "digest", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "refers_to")
    )
    head = F.conv(F.left("digest", F.lit(15)), 16, 10).cast("long")
    manifest = (
        lines.withColumn("shard", shard_of("page_id", head))
        .repartitionById(len(bounds) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .mapInArrow(_write(f"{uri}/data", roll), "file string, records long, bytes long, sha1 string")
    )
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def records_in(data) -> object:
    """(headers, block) of each record in a stream of gzip members."""
    rest, z, whole = b"", zlib.decompressobj(31), bytearray()
    while True:
        got = rest or data.read(1 << 20)
        if not got:
            break
        whole += z.decompress(got)
        rest = z.unused_data
        if z.eof:
            head, _, block = bytes(whole).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])]
            z, whole = zlib.decompressobj(31), bytearray()
    if whole:
        raise ValueError("the archive ends inside a record")


def _read(uri: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                out = []
                with store.open_input_stream(f"{folder}/{name}", compression=None) as data:
                    for h, block in records_in(data):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(payload).digest() != digest or len(payload) != size:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                        out.append((page and int(page), size, digest.hex(), h["WARC-Type"], to and int(to)))
                if len(out) != records:
                    raise ValueError(f"{name}: {len(out)} records, the manifest has {records}")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_warc(manifest: DataFrame, uri: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the files of the manifest."""
    n = partitions_for(manifest.sparkSession)
    return manifest.repartition(n, "file").mapInArrow(_read(f"{uri}/data"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    uri = scratch(spark, "warc")
    return read_warc(write_warc(read(spark, sf_dir, "pages"), uri), uri)


OP10_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {LEAST} AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""
