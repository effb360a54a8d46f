"""Repeated byte strings by merging shard Burrows-Wheeler transforms, and their removal.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes, all occurrences alike,
judged on the input. Matches never cross documents.

Texts are cut at anchors: the least hash of the eight-byte words of each window of ``window_of(length)`` places. A string of
``length`` bytes fixes the anchors inside it, so equal strings are cut alike, and each string belongs to one anchor,
that of the window it starts in. The stretches between anchors are the symbols of an alphabet that all shards share.

A shard is about a megabyte of texts of one task. It sorts the suffixes of its own symbols once and takes their
Burrows-Wheeler transform. The order of all shards' suffixes together is then refined as an interleave: it starts as
one block, and a round extends the prefix that a block stands for by the transform's symbol, moving each suffix to the
one before it by the last-to-first mapping. Blocks are named by what they stand for, so shards refine in step and no
suffix is sorted again or compared with one of another shard. A suffix's rounds end when its common prefix reaches
what every string of its anchor is sure to hold; the bytes from there to the sure horizon complete the name. Blocks
of all shards then meet in one shuffle: a block of one suffix is dropped, others are repeated intervals.

In a repeated interval an anchor whose whole context (all strings that belong to it) occurs twice is settled. Where an
interval has several contexts, at the ends of repeats, the strings of one anchor of each are hashed and counted. All counts are sums that are taken in tasks
first; no block is ever collected, however many suffixes it has. Hashes that decide have 128 bits.

Defined cases: a null or empty text has no bytes, stays as it is and loses nothing. Repeated rows are documents of
their own and so match each other; null and repeated ids do not matter. Other columns pass through. Bytes that are
no longer UTF-8 once neighbours are gone are kept in the digest and replaced in ``text``. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scorewright.llm.common import slices, tasks, whole_text
from scorewright.llm.shingles import mix
from scorewright.session import materialise, settled

LENGTH = 400
WORD = 8
_STEP = 32  # strings of an anchor that are shuffled together
_PLACES = 20  # bits of a place in a shard
_ROOM = 1 << _PLACES
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(None)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    base, out = _BASES[which], []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.full(_ROOM + 1, factor, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def window_of(length: int) -> int:
    """Places of a window: few enough that a string of ``length`` bytes fixes at least one whole symbol."""
    if length < 3 * WORD:
        raise ValueError(f"strings must have {3 * WORD} bytes at least")
    return (length - WORD) * 180 // 392


class Stretches:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        powers, self.back = _powers(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[begin]) * self.back[begin]
        return mix(value ^ (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by windows of doubling width."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


class Shard:
    """The transform of the symbols of some texts (pieces), and its interleave blocks."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, length: int = LENGTH):
        """``edges``: where the pieces begin and end in ``data``."""
        self.length, self.window = length, (window := window_of(length))
        self.first, self.second = Stretches(data, 0), Stretches(data, 1)
        n, sizes = len(data), np.diff(edges)
        words = np.ndarray(max(0, n - WORD + 1), "<u8", np.ascontiguousarray(data), strides=(1,))
        keys = mix(words) & ~np.uint64(_ROOM - 1) | np.arange(len(words), dtype=np.uint64)
        at = (window_minima(keys, window) & np.uint64(_ROOM - 1)).astype(np.int64) if len(keys) >= window else np.zeros(0, np.int64)
        end = np.repeat(edges[1:], sizes)[:len(at)]
        place = np.arange(len(at))
        cut = at[place + (window + WORD - 1) <= end]
        self.anchors = cut[np.flatnonzero(np.diff(cut, prepend=-1))]
        starts = np.flatnonzero(place + length <= end)
        own = at[starts]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        self.low = starts[edge]  # strings that belong to an anchor start here ...
        self.high = starts[np.append(edge[1:], len(starts)) - 1] if len(edge) else self.low  # ... to here
        self.of = np.searchsorted(self.anchors, own[edge])
        self.piece = np.searchsorted(edges, self.anchors, "right") - 1
        self.edges = edges

    def transform(self):
        """Symbols before each suffix in sorted order, the last-to-first mapping (-1 at a piece's begin), ranks.

        The suffixes are those at the anchors, and one empty suffix at the end of each piece that has anchors.
        """
        many = len(self.anchors)
        last = np.flatnonzero(np.diff(self.piece, append=-1)) if many else np.zeros(0, np.int64)
        stops = np.where(np.diff(self.piece, append=-1) != 0, self.edges[self.piece + 1], np.append(self.anchors[1:], 0)) if many else self.anchors
        symbols = self.first(self.anchors, stops)
        after = np.arange(1, many + 1)
        after[last] = many + np.arange(len(last))  # the empty suffix of the piece
        rank = self._ranks(symbols, after, len(last))
        before = np.full(many + len(last), -1, np.int64)
        before[after] = np.arange(many)
        order = np.argsort(rank)
        bwt = np.where(before[order] >= 0, symbols[before[order]] if many else np.uint64(0), np.uint64(0))
        mapping = np.where(before[order] >= 0, rank[before[order]], -1)
        return bwt, mapping, rank

    @staticmethod
    def _ranks(symbols: np.ndarray, after: np.ndarray, ends: int) -> np.ndarray:
        """By doubling: ranks of prefixes of 1, 2, 4, ... symbols; empty suffixes come first, in order of pieces."""
        many = len(symbols)
        rank = np.concatenate((np.unique(symbols, return_inverse=True)[1].astype(np.int64).reshape(-1) + ends, np.arange(ends)))
        to = np.concatenate((after, many + np.arange(ends)))
        for _ in range(64):
            key = rank * (many + ends + 1) + rank[to]
            values, rank = np.unique(key, return_inverse=True)
            rank = rank.astype(np.int64).reshape(-1)
            if len(values) == len(rank):
                break
            to = to[to]
        return rank

    def names(self) -> np.ndarray:
        """The name of the interleave block of each anchor that strings belong to."""
        bwt, mapping, rank = self.transform()
        sure = self.length + 1 - 2 * self.window - WORD
        upto = np.searchsorted(self.anchors, self.anchors + sure, "right")
        stop = np.searchsorted(self.piece, self.piece, "right")
        rounds = np.minimum(upto, stop)[self.of] - self.of
        block = np.zeros(len(rank), np.uint64)
        moving = np.flatnonzero(mapping >= 0)
        prefix = np.zeros(len(self.of), np.uint64)
        for turn in range(1, int(rounds.max(initial=0)) + 1):
            finer = np.full(len(rank), np.uint64(turn))
            finer[mapping[moving]] = mix(bwt[moving] ^ mix(block[moving] + np.uint64(turn)))
            block = finer
            done = np.flatnonzero(rounds == turn)
            prefix[done] = block[rank[self.of[done]]]
        begin = self.anchors[self.of]
        reached = self.of + rounds
        tail = np.where(reached < stop[self.of], self.anchors[np.minimum(reached, len(self.anchors) - 1)] if len(self.anchors) else begin,
                        begin + self.length)
        horizon = begin + self.length + 1 - self.window
        tail = np.minimum(tail, horizon)
        return mix(prefix + self.first(tail, horizon))

    def contexts(self) -> np.ndarray:
        """A hash of all bytes of the strings that belong to each such anchor."""
        return self.second(self.low, self.high + self.length)


def pieces(sizes: list[int], length: int = LENGTH, room: int = _ROOM):
    """Lists of (text, begin, end) for one shard each; long texts are cut so that each string lies in one piece."""
    shard, used = [], 0
    stretch = room // 2
    for text, size in enumerate(sizes):
        for begin in range(0, max(1, size - length + 1), stretch):
            end = min(size, begin + stretch + length - 1)
            if end - begin < length:
                continue
            if used + end - begin > room:
                yield shard
                shard, used = [], 0
            shard.append((text, begin, end))
            used += end - begin
    if shard:
        yield shard


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins and ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


_ANCHORS = "key binary, place long, name long, context long"


def _placed(low, at, high, many) -> np.ndarray:
    """One number of: the first start, how far the anchor and the last start are from it, whether equal texts have it too."""
    return low << 33 | (at - low) << 17 | (high - low) << 1 | (many > 1)


def _unplaced(place: np.ndarray):
    low = (place.view(np.uint64) >> np.uint64(33)).astype(np.int64)
    return low, low + (place >> 17 & 0xFFFF), low + (place >> 1 & 0xFFFF)


def anchor_blocks(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of (key, text as binary): where the strings of each anchor start, its block and its context."""

    def cut(batches):
        for batch in slices(batches, "text", 4_000_000):
            keys = batch.column("key").to_pylist()
            many = Counter(keys)
            once = list({k: i for i, k in enumerate(keys)}.values())  # one of equal texts
            data, offsets = _bytes(batch.column("text"))
            for part in pieces([int(offsets[i + 1] - offsets[i]) for i in once], length):
                begin = np.array([offsets[once[t]] + b for t, b, _ in part])
                sizes = np.array([e - b for _, b, e in part])
                edges = np.concatenate(([0], np.cumsum(sizes)))
                shard = Shard(np.concatenate([data[b:b + s] for b, s in zip(begin, sizes)]), edges, length)
                of = np.searchsorted(edges, shard.low, "right") - 1
                shift = (np.array([b for _, b, _ in part]) - edges[:-1])[of]
                of_key = [keys[once[t]] for t, _, _ in part]
                place = _placed(shard.low + shift, shard.anchors[shard.of] + shift, shard.high + shift, np.array([many[k] for k in of_key])[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of_key, pa.binary()).take(pa.array(of)), pa.array(place), pa.array(shard.names().view(np.int64)),
                     pa.array(shard.contexts().view(np.int64))], ["key", "place", "name", "context"])

    return texts.mapInArrow(cut, _ANCHORS)


def strings_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of (key, anchors, text): hashes of the strings of each anchor, ``_STEP`` distances from the anchor to a row.

    ``part`` numbers the rows of an anchor by distance, ``start`` is where the first string of the row begins.
    """

    def spell(batches):
        for batch in slices(batches, "text", 2_000_000):
            data, offsets = _bytes(batch.column("text"))
            keys, rows, used = batch.column("key"), [], 0
            for i, anchors in enumerate(batch.column("anchors").to_pylist()):
                for a in anchors:
                    low, at, high = (int(x) for x in _unplaced(np.int64([a["place"]])))
                    for part in range((at - high) // _STEP, (at - low) // _STEP + 1):
                        b, e = max(low, at - _STEP * part - _STEP + 1), min(high, at - _STEP * part)
                        rows.append((i, b, e, a["name"], part, a["open"]))
                        used += e + length - b
                    if used > _ROOM - 2 * length - 66_000:
                        yield _spelled(data, offsets, keys, rows)
                        rows, used = [], 0
            if rows:
                yield _spelled(data, offsets, keys, rows)

    def _spelled(data, offsets, keys, rows):
        of, low, high, name, part, alone = (np.array(c) for c in zip(*rows))
        sizes = high + length - low
        edges = np.concatenate(([0], np.cumsum(sizes)))
        hashes = Stretches(np.concatenate([data[b:b + s] for b, s in zip(offsets[of] + low, sizes)]), 1)
        many = high - low + 1
        ends = np.cumsum(many)
        begin = np.repeat(edges[:-1], many) + np.arange(ends[-1]) - np.repeat(ends - many, many)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(hashes(begin, begin + length).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(of)), pa.array(name), pa.array(part.astype(np.int32)), pa.array(low.astype(np.int32)), lists, pa.array(alone)],
            ["key", "name", "part", "start", "hashes", "open"])

    return texts.mapInArrow(spell, "key binary, name long, part int, start int, hashes array<long>, open boolean")


def text_key():
    """A 128-bit hash of the text; empty and null texts are alike."""
    return F.unhex(F.md5(whole_text()))


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per text ``key`` with any: ``runs``, numbers of low << 17 | high - low; all strings of the text that start from low to
    high also start elsewhere."""
    texts = docs.select(text_key().alias("key"), whole_text().cast("binary").alias("text")).where(F.octet_length("text") >= length)
    met = settled(docs.sparkSession, lambda: _intervals(texts, length), "intervals")
    mixed = met.where("not alike")
    copies = F.sum((F.col("place").bitwiseAND(1)) + 1)
    contexts = materialise(mixed.groupBy("name", "context").agg(copies.alias("n"), F.min(F.struct("key", "place")).alias("one")), "contexts")
    twice = mixed.join(contexts.where("n > 1").select("name", "context"), ["name", "context"])
    # one anchor of each context; its strings may be those of another context of the block
    anchors = (contexts.select("one.key", F.struct("one.place", "name", (F.col("n") == 1).alias("open")).alias("anchor"))
               .groupBy("key").agg(F.collect_list("anchor").alias("anchors")))
    spelled = strings_of(texts.join(anchors.hint("shuffle_hash"), "key").select("key", "text", "anchors"), length)
    every = (spelled.repartition(tasks(docs.sparkSession), "name", "part")
             .select("key", "name", "part", "start", "open", F.posexplode("hashes").alias("step", "hash")))
    again = every.withColumn("n", F.count("*").over(Window.partitionBy("name", "part", "hash"))).where("open and n > 1")
    low = F.shiftrightunsigned("place", 33)
    run = F.shiftleft(low, 17).bitwiseOR(F.shiftright("place", 1).bitwiseAND(0xFFFF)).alias("run")
    found = again.select("key", F.shiftleft((F.col("start") + F.col("step")).cast("long"), 17).alias("run"))
    return (met.where("alike").select("key", run).unionByName(twice.select("key", run)).unionByName(found)
            .groupBy("key").agg(F.collect_set("run").alias("runs")))


def _intervals(texts: DataFrame, length: int) -> DataFrame:
    """Anchors of the interleave's blocks of two suffixes and more; ``alike``: all contexts of the block are the same."""
    anchors = materialise(anchor_blocks(texts, length), "anchors")
    copies = F.sum((F.col("place").bitwiseAND(1)) + 1)
    blocks = (anchors.groupBy("name").agg(copies.alias("n"), F.min("context").alias("c"), F.max("context").alias("d"))
              .where("n > 1").select("name", (F.col("c") == F.col("d")).alias("alike")))
    return anchors.join(materialise(blocks, "blocks"), "name")  # written, so that the join of a hot block can be split


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of the bytes that strings starting within the ranges cover."""
    out: list[list[int]] = []
    for low, high in sorted(starts):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [(b, e) for b, e in out]


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row_`` (the document, its text without the removed bytes) and ``dedup_``: n_bytes, n_removed, n_spans, spans
    (maximal removed runs, [begin, end) in bytes) and kept_sha256."""
    starts = settled(docs.sparkSession, lambda: repeated_starts(docs, length), "repeats")
    rows = docs.select(F.struct("*").alias("row_"), text_key().alias("key"))
    met = rows.join(starts.hint("shuffle_hash"), "key", "left").select(
        "row_", "runs", F.coalesce("row_.text", F.lit("")).cast("binary").alias("data_"))
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def drop(batches):
        for batch in slices(batches, "data_", 4_000_000):
            out = []
            for data, found in zip(batch.column("data_").to_pylist(), batch.column("runs").to_pylist()):
                runs = merged([(r >> 17, (r >> 17) + (r & 0x1FFFF)) for r in found or ()], length)
                kept, at = [], 0
                for b, e in runs:
                    kept.append(data[at:b])
                    at = e
                left = b"".join([*kept, data[at:]])
                out.append((left.decode("utf-8", "replace") if runs else None, len(data), len(data) - len(left), len(runs),
                            [{"begin": b, "end": e} for b, e in runs], hashlib.sha256(left).hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), spans, pa.string())
            names = ("text_", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row_"), *columns], ["row_", *names])

    schema = (f"row_ {docs.schema.simpleString()}, text_ string, n_bytes long, n_removed long, n_spans long, "
              "spans array<struct<begin:int,end:int>>, kept_sha256 string")
    done = met.mapInArrow(drop, schema)
    return done.select(F.col("row_").withField("text", F.coalesce("text_", "row_.text")).alias("row_"),
                       F.struct("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256").alias("dedup_"))


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs.select("doc_id", "text"), length).select(
        F.col("row_.doc_id").cast("long").alias("doc_id"), "dedup_.n_bytes", "dedup_.n_removed", "dedup_.n_spans", "dedup_.kept_sha256")
