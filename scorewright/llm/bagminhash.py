"""Near copies by BagMinHash: weighted Jaccard similarity of shingle multisets.

A text is a multiset of five-word shingles, its weights the counts. Weights are discretised at 1, 2, 4, 8 and so on;
every interval between has a Poisson process of its own, of rate proportional to its width, whose points carry a time,
a slot and a level within the interval: a point counts if the weight reaches its level. Slot k of the signature is the
earliest counting point, so two signatures agree in a slot with a probability equal to the weighted Jaccard
similarity. Points are drawn in order of time from keyed hashes, and only until no later point can lower any slot.
Bands of the signature give candidates, and the multiset overlap is verified on the whole texts.

Defined cases: a null or empty text has no shingle and is a copy of other empty ones alone. Repeated ids and rows are
documents of their own; of rows alike in id and text ``deduplicated`` keeps one. A class is named by its least id;
null ids only name a class (with null) that has no other. Other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.linking import band_hashes, near_classes, node
from scorewright.llm.shingles import mix, whole_shingles

BANDS = 25
ROWS = 5
SIMILAR = 0.8
_BITS = np.uint64(44)


def _draw(seed: np.ndarray, turn: int) -> np.ndarray:
    """Uniform in (0, 1], by a keyed hash."""
    bits = mix(seed + np.uint64(0x9E3779B97F4A7C15 * turn % (1 << 64)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def signatures(hashes: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` times per text; infinite where a text has no shingle."""
    texts = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keyed = np.sort(texts << _BITS | hashes >> (np.uint64(64) - _BITS))
    edge = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1]))) if len(keyed) else np.zeros(0, np.int64)
    weight = np.diff(edge, append=len(keyed))
    text = (keyed[edge] >> _BITS).astype(np.int64)
    element = keyed[edge] & ((np.uint64(1) << _BITS) - np.uint64(1))
    rows = []
    low, width, level = 0, 1, 0
    while (reach := weight > low).any():
        rows.append((text[reach], mix(element[reach] ^ np.uint64(level) << np.uint64(50)),
                     np.full(reach.sum(), float(width)), np.minimum(weight[reach] - low, width)))
        low, width, level = low + width, max(1, low + width), level + 1
    out = np.full((len(counts), slots), np.inf)
    if not rows:
        return out
    text, seed, width, reached = (np.concatenate(c) for c in zip(*rows))
    # a slot's earliest point is exponential at the rate of the total weight; few slots are open after this long
    limit = (math.log(slots) + 6) / np.maximum(counts, 1)
    todo = counts > 0
    while todo.any():
        at = np.flatnonzero(todo[text])
        of, key, rate, full = text[at], seed[at], slots * width[at], reached[at] / width[at]
        time, turn = np.zeros(len(at)), 0
        while len(of):
            time = time - np.log(_draw(key, turn)) / rate
            live = time <= limit[of]
            of, key, rate, full, time = of[live], key[live], rate[live], full[live], time[live]
            slot = np.minimum((_draw(key, turn + 1) * slots).astype(np.int64), slots - 1)
            counted = _draw(key, turn + 2) <= full
            np.minimum.at(out.reshape(-1), of[counted] * slots + slot[counted], time[counted])
            turn += 3
        todo = todo & np.isinf(out).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingle hashes; two empty ones are equal."""
    (a_values, a_counts), (b_values, b_counts) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(a_values, b_values, assume_unique=True, return_indices=True)
    both = int(np.minimum(a_counts[i], b_counts[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = whole_shingles(texts)
    times = signatures(hashes, counts, BANDS * ROWS)
    return band_hashes(times.view(np.uint64), BANDS, ROWS, counts > 0)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The multiset as a set: a further occurrence of a shingle is an element of its own."""
    values = np.sort(hashes)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    turn = np.arange(len(values)) - np.repeat(first, np.diff(first, append=len(values)))
    return np.where(turn > 0, mix(values + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), values)


def copy_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per document: doc_id, node (hash of its text), label (of its class), class_id."""
    return near_classes(docs, _bands, weighted_jaccard, similar, numbered)


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, and of rows alike in it the least text hash."""
    classes = copy_classes(docs, similar)
    alike = classes.groupBy("label", "doc_id", "node").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "rows"))
    stay = (alike.groupBy("label").agg(best.alias("best"))
            .select(F.col("best.doc_id").alias("id_"), F.col("best.node").alias("of_"), F.col("best.rows").alias("rows_")))
    kept = (docs.select(F.struct("*").alias("row_"), node().alias("node_"))
            .join(stay.hint("shuffle_hash"), F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (F.col("node_") == F.col("of_"))))
    once = kept.where("rows_ = 1").select("row_.*")
    return once.unionByName(kept.where("rows_ > 1").dropDuplicates(["id_", "node_"]).select("row_.*"))
