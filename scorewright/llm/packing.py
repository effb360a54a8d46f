"""Best-fit packing of documents into sequences, by residuals up a tree.

Each task encodes its texts and cuts those longer than a sequence (the first piece takes the remainder, the others
are full and make sequences of their own). It packs the remaining pieces by best fit, longest first, and emits the
nearly full bins. Underfull bins go up as items: groups of them are merged by best fit again, level by level, until
one group is left or no two items fit together. What is underfull then is dissolved into its pieces and packed once
more. A bin carries its pieces, at most as many as a sequence has ids.

A group is bounded by ``rows_per_group``: a level has as many groups as its items need. Bins that no other item of the
level can enter wait for the last round.

Defined cases: a null or empty text is the end id alone. Null and repeated ids are documents of their own. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import slices, whole_text
from scorewright.llm.tokens import encoder
from scorewright.session import materialise

SEQUENCE = 1024
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
_BINS = pa.schema([("bin", pa.int64()), ("used", pa.int32()), ("closed", pa.bool_()), ("pieces", pa.list_(_PIECE))])
BINS = "bin long, used int, closed boolean, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that takes it."""
    space: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # a bit per free space that some bin has
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = space[left].pop()
            if not space[left]:
                free &= ~(1 << left)
            bins[at].append(item)
        else:
            at, left = len(bins), capacity
            bins.append([item])
        left -= size
        space[left].append(at)
        free |= 1 << left
    return bins


def _batches(rows: list[tuple], many: int = 5000):
    for i in range(0, len(rows), many):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + many]), _BINS)], schema=_BINS)


def _merged(items: list[tuple[int, list]], capacity: int, slack: int, number) -> list[tuple]:
    """Bins of (size, pieces) items as rows; closed when nearly full."""
    rows = []
    for members in best_fit([size for size, _ in items], capacity):
        used = sum(items[i][0] for i in members)
        rows.append((number(), used, capacity - used <= slack, [p for i in members for p in items[i][1]]))
    return rows


def local_bins(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, slack: int, rows_per_group: int) -> DataFrame:
    """Bins of each task's own pieces."""

    def fill(batches):
        texts_to_ids = encoder(vocabulary, spaced=True).encode
        end = end_id.to_bytes(4, "little")
        high, made = TaskContext.get().partitionId() << 32, 0

        def number():
            nonlocal made
            made += 1
            return high | made

        rest, full = [], []
        for batch in slices(batches, "text", 8_000_000):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts_to_ids(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                begin, size = 0, (n - 1) % capacity + 1  # the remainder, or a whole piece
                piece = 0
                while begin < n:
                    row = {"doc_id": doc, "piece": piece, "start": begin, "length": size,
                           "ids_crc32": zlib.crc32(ids[4 * begin:4 * (begin + size)])}
                    if size == capacity:
                        full.append((number(), size, True, [row]))
                    else:
                        rest.append((size, [row]))
                    begin, size, piece = begin + size, capacity, piece + 1
            if len(full) >= 5000:
                yield from _batches(full)
                full = []
            if len(rest) >= rows_per_group:
                yield from _batches(_merged(rest, capacity, slack, number))
                rest = []
        yield from _batches(full)
        yield from _batches(_merged(rest, capacity, slack, number))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(fill, BINS)


def merge_bins(underfull: DataFrame, groups: int, level: int, capacity: int, slack: int, dissolve: bool = False) -> DataFrame:
    """Best fit of the underfull bins within each of ``groups`` groups; a bin is one item.

    With ``dissolve`` a piece is one item, and a group stays as it is where that makes no fewer bins.
    """

    def merge(key, table):
        base, made = level << 56 | key[0].as_py() << 32, 0

        def number():
            nonlocal made
            made += 1
            return base | made

        items = sorted(zip(table.column("used").to_pylist(), table.column("pieces").to_pylist(), table.column("bin").to_pylist()),
                       key=lambda x: (x[0], x[2]))
        rows = _merged([(used, pieces) for used, pieces, _ in items], capacity, slack, number)
        if dissolve:
            again = _merged([(p["length"], [p]) for _, pieces, _ in items for p in pieces], capacity, slack, number)
            rows = again if len(again) < len(rows) else rows
        return pa.Table.from_batches(_batches(rows), _BINS)

    group = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).cast("int")
    return underfull.withColumn("group_", group).groupBy("group_").applyInArrow(merge, BINS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE, slack: int = 8,
                   fan_in: int = 8, rows_per_group: int = 50_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``slack``: free ids up to which a bin is emitted as nearly full. ``fan_in``: groups that meet on the next level.
    """
    bins = materialise(local_bins(docs, vocabulary, end_id, capacity, slack, rows_per_group), "bins")
    done, waiting, level = [bins.where("closed")], [], 0
    spread = bins.agg(F.countDistinct(F.shiftright("bin", 32))).first()[0]  # tasks that made bins
    while True:
        open_bins = bins.where("not closed")
        least = open_bins.agg(F.min("used")).first()[0]
        if least is None:
            break
        able = F.col("used") <= capacity - least  # some item still fits
        waiting.append(open_bins.where(~able))
        open_bins = open_bins.where(able)
        items = open_bins.count()
        spread //= fan_in
        groups = max(1, spread, -(-items // rows_per_group))
        if items < 2:
            waiting.append(open_bins)
            break
        level += 1
        bins = materialise(merge_bins(open_bins, groups, level, capacity, slack), "bins")
        done.append(bins.where("closed"))
        if groups == 1 or bins.count() == items and spread <= 1:  # one group, or nothing merged
            waiting.append(bins.where("not closed"))
            break
    if waiting:
        rest = _union(waiting)
        groups = max(1, -(-rest.count() // rows_per_group))
        done.append(materialise(merge_bins(rest, groups, level + 1, capacity, slack, dissolve=True), "bins"))
    out = _union(done)
    before = F.expr("transform(sequence(0, size(pieces) - 1), i -> aggregate(slice(pieces, 1, i), 0L, (s, p) -> s + p.length))")
    return (out.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip(F.col("pieces").alias("p"), before.alias("offset"))).alias("x"))
            .select("x.p.doc_id", "x.p.piece", "x.p.start", "x.p.length", "x.p.ids_crc32", "sequence_id", "x.offset"))
