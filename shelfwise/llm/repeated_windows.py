"""Substring dedup: words covered by a window of 20 words that has stood somewhere before are removed.

Every window of every document gets a Rabin-Karp hash: the sum of its words' hashes times powers of an odd base, modulo
2^64, rolled along as the difference of two prefix sums. Spark counts them, and repeated windows merge into maximal
intervals of words to remove:

1. Documents are dealt out by ranges of (doc_id, hash of the text) and packed, in that order, into blocks of some MB, so
   that "earlier" is "in an earlier block, or before in the same one". Blocks are written as a table, a row each.
2. Each block sends its distinct window hashes, sorted and as byte planes of their differences, to the buckets of the hash
   range. A bucket counts the blocks of each hash, and answers each block with one bit a hash: does another block have it?
3. Windows that other blocks have too are sent again, now with the second half of a 128-bit key (another base, other word
   hashes), so that colliding hashes part. A bucket answers with one bit a key: does an earlier block have it?
4. Each block removes the words of windows that an earlier block has, or that stand before in the block itself.

A window that stands in a third of all documents is one hash a block, so no key is hot, and what moves is about 6 bytes a
window, once. Buckets grow in number with the windows (``PER_BUCKET``), and so do tasks.

Defined cases: null or empty text has no words; texts of fewer than 20 words lose none; a very long text is a block of its
own, hashed in slices; rows without doc_id come after all others; rows that tie in doc_id come in the order of a hash of
their texts, and of repeated rows the first stays; an empty table gives an empty result. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import partitions_for, read, settle, staged, stir

WINDOW = 20
#: Bytes of text in a block, and in a slice that is cut into words at once.
BLOCK, SLICE = 4 << 20, 1 << 20
#: Windows that a bucket holds about (8 bytes each, a few times over), and bytes of windows that a task of buckets gets.
PER_BUCKET, PER_TASK = 2 << 20, 256 << 20
#: Bytes of text that a task packs into blocks.
PER_PACKER = 128 << 20
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _slices(data: bytes, size: int = SLICE):
    """Parts of about ``size`` bytes, cut at blanks."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + size) if len(data) - at > size else None
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows."""
    one = xxhash.xxh3_128_digest
    parts = [np.frombuffer(b"".join(map(one, s.split())), np.uint64).reshape(-1, 2) for s in _slices(data)]
    return np.concatenate(parts) if parts else np.empty((0, 2), np.uint64)


_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if (base, n) not in _powers:
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[base, n] = tuple(tables)
    return _powers[base, n]


def rolling(h: np.ndarray, base: int, width: int = WINDOW) -> np.ndarray:
    """The Rabin-Karp hash of each ``width`` neighbours of ``h``, stirred so that its upper bits are even."""
    out = np.empty(max(0, len(h) - width + 1), np.uint64)
    up, down = _power_tables(base, _CHUNK + width)
    for at in range(0, len(out), _CHUNK):
        part = h[at : at + _CHUNK + width - 1]
        upto = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=upto[1:])
        n = len(part) - width + 1
        out[at : at + n] = (upto[width:] - upto[:n]) * down[:n]
    return stir(out)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences: the upper planes shrink to nearly nothing."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _binary(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def _pack(width: int, most: int):
    def pack(batches):
        """Rows (doc_id, text) in order to rows (block, windows, data)."""
        names, types = ["block", "windows", "data"], [pa.int64(), pa.int64(), pa.binary()]
        block = TaskContext.get().partitionId() << 32
        ids, texts, held, windows = [], [], 0, 0

        def whole():
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            return _binary([(block, windows, sink.getvalue().to_pybytes())], names, types)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and held + len(data) > most:
                    yield whole()
                    block, ids, texts, held, windows = block + 1, [], [], 0, 0
                ids.append(doc), texts.append(data)
                held += len(data)
                windows += max(0, sum(len(s.split()) for s in _slices(data)) - width + 1)
        if ids:
            yield whole()

    return pack


class Block:
    """The documents of a packed block, the hashes of their words, and which windows lie inside one document."""

    def __init__(self, data: bytes, width: int):
        batch = pa.ipc.open_stream(data).read_next_batch()
        self.ids, self.width = batch.column("doc_id").to_pylist(), width
        self.texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
        per_doc = [word_hashes(t) for t in self.texts]
        self.ends = np.cumsum([len(h) for h in per_doc], dtype=np.int64)
        words = np.concatenate(per_doc)
        self.lanes = [np.ascontiguousarray(words[:, k]) for k in (0, 1)]
        inside = np.ones(max(0, len(words) - width + 1), bool)
        for end in self.ends[:-1].tolist():
            inside[max(0, end - width + 1) : end] = False
        self.at = np.flatnonzero(inside)
        self.first = rolling(self.lanes[0], BASES[0], width)[self.at]

    def second(self) -> np.ndarray:
        return rolling(self.lanes[1], BASES[1], self.width)[self.at]

    def shared(self, answers: dict[int, np.ndarray], bits: int) -> np.ndarray:
        """For each window: has another block its hash?"""
        distinct, back = np.unique(self.first, return_inverse=True)
        return spread(answers, distinct, bits)[back]


def spread(answers: dict[int, np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """One bool a sorted key from the bits that the buckets have answered; buckets without an answer say no."""
    out = np.zeros(len(keys), bool)
    for bucket, a, z in _buckets(keys, bits):
        if bucket in answers:
            out[a:z] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=z - a)
    return out


def _buckets(keys: np.ndarray, bits: int):
    """(bucket, begin, end) of the runs of sorted keys that share their upper bits."""
    if not len(keys):
        return
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield int(of[a]), a, z


_SENT = "bucket int, block long, first binary, second binary"
_SENT_NAMES, _SENT_TYPES = ["bucket", "block", "first", "second"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _send_all(width: int, bits: int):
    def send(batches):
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                keys = np.unique(Block(data.as_py(), width).first)
                yield _binary([(k, block, pack_sorted(keys[a:z]), b"") for k, a, z in _buckets(keys, bits)], _SENT_NAMES, _SENT_TYPES)

    return send


def _answers_of(cell) -> dict[str, dict[int, bytes]]:
    found: dict[str, dict[int, bytes]] = {"shared": {}, "earlier": {}}
    for a in cell.as_py() or []:
        found[a["kind"]][a["bucket"]] = a["bits"]
    return found


def _keys_of(block: Block, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit keys of the windows ``where``, sorted; the first window of each key, and each window's key."""
    k = np.empty(len(where), [("a", np.uint64), ("b", np.uint64)])
    k["a"], k["b"] = block.first[where], block.second()[where]
    order = np.lexsort((np.arange(len(k)), k["b"], k["a"]))
    k = k[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    return k["a"][new], k["b"][new], where[order[new]], back


def _send_shared(width: int, bits: int):
    def send(batches):
        for b in batches:
            for no, data, cell in zip(b.column("block").to_pylist(), b.column("data"), b.column("answers"), strict=True):
                block = Block(data.as_py(), width)
                first, second, _, _ = _keys_of(block, np.flatnonzero(block.shared(_answers_of(cell)["shared"], bits)))
                yield _binary([(k, no, pack_sorted(first[a:z]), second[a:z].tobytes()) for k, a, z in _buckets(first, bits)], _SENT_NAMES, _SENT_TYPES)

    return send


_ANSWER = "block long, kind string, bucket int, bits binary"


def _count(kind: str):
    """Rows of a bucket, all together and in the order of their blocks, to one bit a key and block."""

    def answer(bucket, blocks, firsts, seconds):
        first = np.concatenate(firsts)
        if kind == "shared":
            order = np.argsort(first, kind="stable")
            same = first[order][1:] == first[order][:-1]
            yes = np.zeros(len(first), bool)
            yes[order[1:]] |= same
            yes[order[:-1]] |= same
        else:  # keys tie in the order of blocks, and a block has a key once
            second = np.concatenate(seconds)
            order = np.lexsort((np.arange(len(first)), second, first))
            f, s = first[order], second[order]
            yes = np.zeros(len(first), bool)
            yes[order[1:]] = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
        out, at = [], 0
        for block, keys in zip(blocks, firsts, strict=True):
            part = yes[at : at + len(keys)]
            at += len(keys)
            if part.any():
                out.append((block, kind, bucket, np.packbits(part).tobytes()))
        return _binary(out, ["block", "kind", "bucket", "bits"], [pa.int64(), pa.string(), pa.int32(), pa.binary()])

    def count(batches):
        bucket, blocks, firsts, seconds = None, [], [], []
        for b in batches:
            for k, block, first, second in zip(*(b.column(c).to_pylist() for c in _SENT_NAMES), strict=True):
                if k != bucket:
                    if blocks:
                        yield answer(bucket, blocks, firsts, seconds)
                    bucket, blocks, firsts, seconds = k, [], [], []
                blocks.append(block), firsts.append(unpack_sorted(first)), seconds.append(np.frombuffer(second, np.uint64))
        if blocks:
            yield answer(bucket, blocks, firsts, seconds)

    return count


def removed_words(block: Block, answers: dict[str, dict[int, bytes]], bits: int) -> np.ndarray:
    """One bool a word of the block."""
    distinct, back, often = np.unique(block.first, return_inverse=True, return_counts=True)
    shared = spread(answers["shared"], distinct, bits)[back]
    where = np.flatnonzero(shared | (often[back] > 1))  # no other window can have stood before
    gone = np.zeros(len(block.lanes[0]) + 1, np.int32)
    if len(where):
        first, second, leader, key = _keys_of(block, where)
        earlier = np.zeros(len(first), bool)
        sent = shared[leader]  # these keys were sent, in this order
        earlier[sent] = spread(answers["earlier"], first[sent], bits)
        again = block.at[where[earlier[key] | (leader[key] != where)]]
        gone[again] += 1
        np.subtract.at(gone, again + block.width, 1)
    return np.cumsum(gone[:-1]) > 0


_KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary"


def _remove(width: int, bits: int):
    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def kept_text(text: bytes, gone: np.ndarray) -> bytes:
        parts, at = [], 0
        for s in _slices(text):
            words = s.split()
            mask = gone[at : at + len(words)]
            at += len(words)
            parts.extend([b" ".join(words)] if words and not mask.any() else [w for w, g in zip(words, mask.tolist(), strict=True) if not g])
        return b" ".join(parts)

    def remove(batches):
        for b in batches:
            for data, cell in zip(b.column("data"), b.column("answers"), strict=True):
                block, out, begin = Block(data.as_py(), width), [], 0
                gone = removed_words(block, _answers_of(cell), bits)
                for doc, text, end in zip(block.ids, block.texts, block.ends.tolist(), strict=True):
                    part = gone[begin:end]
                    turns = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0)).tolist()
                    spans = [{"begin": a, "end": z} for a, z in zip(turns[::2], turns[1::2], strict=True)]
                    out.append((doc, end - begin, int(np.count_nonzero(part)), spans, kept_text(text, part)))
                    begin = end
                yield _binary(out, names, types)

    return remove


def remove_repeats(docs: DataFrame, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal runs of removed words, from 0, end not in), kept (what is left, words joined
    by one space). A word goes if a window of ``width`` words covers it that starts earlier as well. ``block``: bytes of text
    in a block."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions_for(spark, -(-size // PER_PACKER))
    # Equal rows are told apart by where they were read, so many of them are no single range
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("place")]
    dealt = slim.withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    blocks = staged(dealt.select("doc_id", "text").mapInArrow(_pack(width, block), "block long, windows long, data binary"), "op11-blocks", codec="uncompressed")
    windows = blocks.agg(F.sum("windows")).first()[0] or 0
    counters = partitions_for(spark, -(-windows * 8 // PER_TASK))
    bits = max(2 * counters, -(-windows // PER_BUCKET)).bit_length()

    def counted(sent: DataFrame, kind: str) -> DataFrame:
        together = sent.repartition(counters, "bucket").sortWithinPartitions("bucket", "block")
        return staged(together.mapInArrow(_count(kind), _ANSWER), f"op11-{kind}")

    def answered(answers: DataFrame, how: str) -> DataFrame:
        """Blocks with what buckets have answered: two bits a window at most."""
        told = answers.groupBy(F.col("block").alias("to")).agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers"))
        return blocks.join(told, F.col("block") == F.col("to"), how).select("block", "data", "answers")

    shared = counted(blocks.select("block", "data").mapInArrow(_send_all(width, bits), _SENT), "shared")
    earlier = counted(answered(shared, "inner").mapInArrow(_send_shared(width, bits), _SENT), "earlier")
    left = answered(shared.unionByName(earlier), "left").select("data", "answers").mapInArrow(_remove(width, bits), _KEPT)
    return left.withColumn("kept", F.col("kept").cast("string"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts WHERE len(words) >= 20)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again
), kept AS (
  SELECT u.doc_id, count(*) AS n_kept, string_agg(u.word, ' ' ORDER BY u.p) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts) u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.p = g.p
  GROUP BY u.doc_id
)
SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
