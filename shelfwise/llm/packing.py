"""Best-fit decreasing packing of token runs into sequences of a fixed length.

Pieces of equal length are interchangeable, so best-fit decreasing over all documents needs no more than the number of
pieces of each length: a table of at most ``capacity`` rows, whatever the input. ``plan`` goes through the lengths from
the longest down; a segment tree over remaining capacities finds the tightest open bin in logarithmic time, and bins of
equal remainder take their pieces as one run. Spark ranks the pieces within their length (dealt by a hash first, so that
a length that many copies share is ranked by many tasks) and joins them with the runs.

Defined cases: null or empty text is the end id alone; a text of any length is cut into as many pieces as it needs;
repeated rows are packed as separate documents, and rows that tie in every column take any order among themselves, which
changes nothing in the result; null doc_ids are packed too; an empty table gives an empty result. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import read, settle, staged
from shelfwise.llm.tokens import text_ids

CAPACITY = 1024
END = 2
SALTS, PER_SALT = 64, 2_000_000


class Remainders:
    """A segment tree over 0..capacity that counts open bins by remaining capacity."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, rest: int, bins: int) -> None:
        at = self.base + rest
        while at:
            self.tree[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remainder of at least ``need`` that an open bin has."""
        at = self.base + need
        if self.tree[at]:
            return need
        while at > 1:  # up, until a right sibling holds bins
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.base:  # down, to its first
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.base


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, sequence_from, offset): pieces of that length and of rank r in
    [rank_from, rank_to) go to sequence sequence_from + r - rank_from, at offset."""
    tree, groups, runs, bins = Remainders(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, there = capacity, bins, left
                fresh = True
            else:
                first, there = groups[rest].pop()
                tree.add(rest, -there)
                fresh = False
            fit = rest // length
            full = min(there, left // fit)
            for j in range(fit if full else 0):
                runs.append((length, rank, rank + full, first, capacity - rest + j * length))
                rank += full
            left -= full * fit
            used = [(first, full, rest - fit * length)]
            some = min(left, fit - 1) if full < there else 0
            if some:  # the last bin takes what is left
                for j in range(some):
                    runs.append((length, rank, rank + 1, first + full, capacity - rest + j * length))
                    rank += 1
                left -= some
                used.append((first + full, 1, rest - some * length))
            taken = full + bool(some)
            if fresh:
                bins += taken
            elif taken < there:
                used.append((first + taken, there - taken, rest))
            for at, n, r in used:
                if n and r:
                    groups.setdefault(r, []).append((at, n))
                    tree.add(r, n)
    return runs


def _cut(path: str, capacity: int, end: int):
    tail = struct.pack("<I", end)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        ids_of = text_ids(path, lead=True)
        for b in batches:
            out = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of.encode(b.column("text")), strict=True):
                ids += tail
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_cut(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` has doc_id, piece, start, length, ids_crc32 and is read more than once; adds sequence_id and offset."""
    spark = rows.sparkSession
    salts = max(SALTS, -(-rows.count() // PER_SALT))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    dealt = salted.groupBy(F.col("length").alias("of_length"), F.col("salt").alias("of_salt")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of_length").orderBy("of_salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity x salts rows
    offsets = staged(dealt.withColumn("ranks_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "op6-ranks")
    counts = {r["of_length"]: r["n"] for r in offsets.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "run_length long, rank_from long, rank_to long, sequence_from long, offset long")
    # What a salt's pieces need of the plan travels by the key that they are ranked by, so nothing is broadcast
    meets = (F.col("of_length") == F.col("run_length")) & (F.col("rank_from") < F.col("ranks_before") + F.col("n")) & (F.col("rank_to") > F.col("ranks_before"))
    parts = offsets.join(runs, meets).select("of_length", "of_salt", "ranks_before", "rank_from", "rank_to", "sequence_from", "offset")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    rank = F.col("ranks_before") + F.col("rank_in_salt") - 1
    place = (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to"))
    return (
        salted.withColumn("rank_in_salt", F.row_number().over(within))
        .join(parts, place)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + rank - F.col("rank_from")).alias("sequence_id"), "offset")
    )


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(staged(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "op6-pieces"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return packed(read(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: one row a piece, with its sequence and its place there."""
    settle(spark)
    return packed(docs)
