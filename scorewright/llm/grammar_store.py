"""Token ids of a corpus in grammar-compressed shards, in document order, and reading them back.

Documents are range partitioned by id; each task encodes its texts and cuts them into shards of whole documents, of
about ``BLOCK_IDS`` ids, so that memory is bounded whatever a task holds; each has a Re-Pair grammar of its own
(``repair``). The folder is a Parquet table, one row per block, so the
write is committed by Spark and a lost executor only repeats its tasks. Columns: ``shard``, ``block`` (counted
within the shard), ``before`` (ids of the shard before the block), ``n_ids``, ``payload``.

Defined cases: a null text is empty; every document gets the end id, so an empty one is one id. Null document ids
come first and repeated ids stay rows of their own, ordered by text. Other columns are ignored. An empty table gives
no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import repair
from scorewright.llm.common import prefix_sums, slices, tasks, whole_text
from scorewright.llm.tokens import encoder
from scorewright.session import new_path

BLOCK_IDS = 1 << 19
BLOCKS = "shard int, block int, before long, n_ids long, payload binary"


def write_shards(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, end_id: int,
                 block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents of (doc_id, text) to ``path``, a folder all executors reach."""

    def write(batches):
        texts_to_ids = encoder(vocabulary, spaced=False, width=2).encode
        end = end_id.to_bytes(2, "little")
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names, sizes, parts, held = [], [], [], 0

        def block():
            ids = np.frombuffer(b"".join(parts), "<u2")
            payload = repair.pack(names, sizes, ids, vocabulary_size)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                ["shard", "block", "before", "n_ids", "payload"])

        for batch in slices(batches, "text", 8_000_000):
            for name, ids in zip(batch.column("doc_id").to_pylist(), texts_to_ids(batch.column("text").to_pylist())):
                names.append(name)
                parts.append(ids + end)
                sizes.append(len(parts[-1]) // 2)
                held += sizes[-1]
                if held >= block_ids:
                    yield block()
                    number, before = number + 1, before + held
                    names, sizes, parts, held = [], [], [], 0
        if names:
            yield block()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
               .repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(write, BLOCKS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts = prefix_sums(blocks.select("shard", "n_ids"), "shard", "n_ids", "shard_start")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, ids = repair.unpack(row["payload"]), repair.decode(row["payload"]).astype("<u4")
                ends = np.cumsum(x["doc_lengths"], dtype=np.int64)
                begins = ends - x["doc_lengths"]
                data = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"].astype(np.int64), mask=x["null"].astype(bool)),
                     pa.array(row["shard_start"] + row["before"] + begins),
                     pa.array(x["doc_lengths"].astype(np.int64)),
                     pa.array([zlib.crc32(data[4 * b:4 * e]) for b, e in zip(begins.tolist(), ends.tolist())], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per shard, as many as the write had tasks
    return (blocks.join(F.broadcast(starts), "shard").select("before", "shard_start", "payload")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_slice(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of the corpus: only the blocks that hold them are read, and only their symbols expanded."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts = prefix_sums(blocks.select("shard", "n_ids"), "shard", "n_ids", "shard_start")
    at = F.col("shard_start") + F.col("before")
    rows = (blocks.join(F.broadcast(starts), "shard").where((at < stop) & (at + F.col("n_ids") > start))
            .select(at.alias("at"), "payload").orderBy("at").collect())  # as many as the slice asks for
    return [int(i) for r in rows for i in repair.decode(bytes(r.payload), max(0, start - r.at), stop - r.at)]


def encode_corpus(docs: DataFrame, vocabulary: str, vocabulary_size: int, end_id: int) -> DataFrame:
    """Write ``docs`` as shards to the shared folder and return what ``read_documents`` finds there."""
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write_shards(docs, path, vocabulary, vocabulary_size, end_id)
    return read_documents(spark, path)
