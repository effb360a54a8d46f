"""Document fingerprints: MinHash over five-word shingles, in numpy; bands joined in Spark, Jaccard verified.

Slot k of a signature is the least value of a universal hash (a multiplier and an offset modulo 2^32) over the text's
set of shingles, cut to 16 bits in the printed fingerprint. The likeness of two fingerprints is the share of equal
slots.

Defined cases: a null text is empty; an empty text has no shingle and a fingerprint of its own, alike only to itself.
Equal texts have equal fingerprints. Null ids come first in the order of documents and repeated ids are rows of their
own, ordered by text. Other columns are ignored. An empty table gives no rows; a table of one document follows itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import slices, tasks, whole_text
from scorewright.llm.linking import band_hashes, near_classes
from scorewright.llm.shingles import whole_shingles

SLOTS = 128
BANDS = 25
ROWS = 5
SIMILAR = 0.8
_EMPTY = np.uint32(0xFFFFFFFF)


def hash_family(slots: int = SLOTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, slots, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, slots, np.uint32)


def signatures(texts: pa.Array, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 32-bit values per text."""
    hashes, counts = whole_shingles(texts)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    multiply, add = hash_family(slots)
    out = np.full((len(counts), slots), _EMPTY)
    filled = np.flatnonzero(counts)
    edge = (np.cumsum(counts) - counts)[filled]
    if len(filled):
        for k in range(slots):
            value = short * multiply[k]
            value += add[k]
            value ^= value >> np.uint32(15)
            out[filled, k] = np.minimum.reduceat(value, edge)
    return out


def printed(signature: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, four digits a slot."""
    return [row.tobytes().hex() for row in (signature & np.uint32(0xFFFF)).astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the rows of two arrays of signatures."""
    return ((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))).mean(axis=1)


def _shift(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def fingerprint_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: fingerprint, that of its edited text, and likeness to the edited and to the next document's text."""
    spark = docs.sparkSession
    parts = parts or 4 * tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = rows.select("doc_id")
    # first id of each range of a range partitioning of the ids alone: as many as ``parts``
    cuts = [r.c for r in ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("p"))
            .agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("c")).orderBy("c").collect()]
    if not cuts:
        return spark.createDataFrame([], _OUT)
    known = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    last = len(cuts) - 1

    def place(batches):
        """The range of each row, and a copy in the range before for the first id of a range."""
        for batch in batches:
            doc = batch.column("doc_id")
            order = doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(known.value, order, "right") - 1
            leads = np.flatnonzero(known.value[at] == order)
            take = pa.array(np.concatenate((np.arange(len(at)), leads)))
            before = np.where(at[leads] > 0, at[leads] - 1, last)  # after the last comes the first
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((at, before)), pa.int32()),
                 pa.array(np.concatenate((np.zeros(len(at), np.int8), np.ones(len(leads), np.int8))), pa.int8()),
                 doc.take(take), batch.column("text").take(take)], ["range_", "copy_", "doc_id", "text"])

    placed = (rows.mapInArrow(place, "range_ int, copy_ byte, doc_id long, text string")
              .repartition(tasks(spark), "range_").sortWithinPartitions("range_", "copy_", "doc_id", "text"))

    def compare(batches):
        held = None  # (range, copy, doc_id, text, signature) of the row before
        for batch in slices(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            signature = signatures(batch.column("text"))
            new = list(zip(batch.column("range_").to_pylist(), batch.column("copy_").to_pylist(),
                           batch.column("doc_id").to_pylist(), texts, signature))
            rows_ = ([held] if held else []) + new
            held = rows_[-1]
            pairs = [(a, b) for a, b in zip(rows_, rows_[1:]) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            edited = [_shift(a[3], b[3]) for a, b in pairs]
            own, following = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs])
            changed = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                 pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(printed(own)),
                 pa.array(printed(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(compare, _OUT)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingle hashes, given as arrays that may repeat them; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    signature = signatures(texts)[:, :BANDS * ROWS]
    return band_hashes(signature.astype(np.uint64), BANDS, ROWS, signature[:, 0] != _EMPTY)


def similar_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per document: doc_id and class_id, the least id of the documents linked to it by a Jaccard similarity of ``similar``."""
    return near_classes(docs, _bands, jaccard, similar, np.unique)
