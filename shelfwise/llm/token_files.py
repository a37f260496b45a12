"""Token-ID output: sharded files of range-coded segments, in ascending doc_id order, and their reader.

Documents are range-partitioned and sorted by doc_id; each partition is a shard. A segment holds whole documents of about
``SEGMENT`` ids in all, coded by ``range_coder``: one model a segment, and blocks that need only the model and are checksummed
one by one, so any block can be read without the others and a damaged one is noticed. A segment is one record of a Parquet file, whose footer is the index: shard,
segment, documents and ids of each.

Defined cases: null or empty text is the end id alone; a very long text is a segment of its own; null doc_ids come first;
rows that tie in doc_id are separate documents, ordered among themselves by a hash of the text, and many of them are still cut into
shards, since the hash is part of the range key; an empty table gives an empty result. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import partitions_for, read, scratch, settle
from shelfwise.llm.range_coder import decode, encode
from shelfwise.llm.tokens import text_ids

END = 1
SEGMENT = 1 << 21


def pack_segment(docs: list[int | None], runs: list[bytes]) -> bytes:
    """doc_ids (with a map of nulls), lengths, coded ids."""
    n = len(docs)
    nulls = np.packbits([d is None for d in docs]).tobytes()
    ids = np.array([0 if d is None else d for d in docs], "<i8")
    sizes = np.array([len(r) // 4 for r in runs], "<u4")
    return struct.pack("<I", n) + nulls + ids.tobytes() + sizes.tobytes() + encode(np.frombuffer(b"".join(runs), np.uint32))


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    at = 4 + -(-n // 8)
    nulls = np.unpackbits(np.frombuffer(data, np.uint8, at - 4, 4), count=n)
    docs = np.frombuffer(data, "<i8", n, at).tolist()
    sizes = np.frombuffer(data, "<u4", n, at + 8 * n).astype(np.int64)
    return [None if z else d for d, z in zip(docs, nulls.tolist(), strict=True)], sizes, decode(data[at + 12 * n :])


def _write(path: str, end: int):
    tail = struct.pack("<I", end)

    def run(batches):
        ids_of = text_ids(path, lead=False)
        docs, runs, held, no, shard = [], [], 0, 0, None

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([no], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_segment(docs, runs)], pa.binary())],
                names=["shard", "segment", "n_docs", "n_tokens", "data"],
            )

        for b in batches:
            for at, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), ids_of.encode(b.column("text")), strict=True):
                shard = at
                docs.append(doc), runs.append(ids + tail)
                held += len(runs[-1]) // 4
                if held >= SEGMENT:
                    yield flush()
                    docs, runs, held, no = [], [], 0, no + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, uri: str, tokenizer_path: str, end: int = END) -> None:
    """Writes the shards below ``uri``; text is tokenised where it is written."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (
        slim.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions_for(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .drop("tie")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(_write(tokenizer_path, end), "shard int, segment long, n_docs long, n_tokens long, data binary")
        .write.option("compression", "uncompressed")
        .parquet(uri)
    )


def _unpack(batches):
    for b in batches:
        for shard, segment, data in zip(*(b.column(c).to_pylist() for c in ("shard", "segment", "data")), strict=True):
            docs, sizes, ids = unpack_segment(data)
            starts = np.cumsum(sizes) - sizes
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            k = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, shard, np.int32)), pa.array(np.full(k, segment)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())],
                names=["shard", "segment", "doc_id", "start_in_segment", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files below ``uri``."""
    files = spark.read.schema("shard int, segment long, n_docs long, n_tokens long, data binary").parquet(uri)
    index = files.select("shard", "segment", F.col("n_tokens").alias("held"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.groupBy(F.col("shard").alias("of_shard")).agg(F.sum("held").alias("shard_held"))
    # One row a shard
    shards = shards.withColumn("shards_before", F.coalesce(F.sum("shard_held").over(Window.orderBy("of_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    index = (
        index.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0)))
        .join(shards, F.col("shard") == F.col("of_shard"))
        .select(F.col("shard").alias("s"), F.col("segment").alias("g"), (F.col("before") + F.col("shards_before")).alias("before"))
    )
    docs = files.select("shard", "segment", "data").mapInArrow(_unpack, "shard int, segment long, doc_id long, start_in_segment long, n_tokens long, ids_crc32 long")
    return docs.join(index, (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g"))).select(
        "doc_id", (F.col("start_in_segment") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settle(spark)
    uri = scratch(spark, "op1-tokens")
    write_tokens(read(spark, sf_dir, "documents"), uri, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, uri)
