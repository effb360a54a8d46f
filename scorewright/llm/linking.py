"""Classes of near copies: bands joined in Spark, candidates verified, links followed to components.

Equal texts are one node (a 128-bit hash of the text). Nodes that share a band meet in a bucket. A bucket of n nodes
does not make n * n pairs: the node that meets most others is its head. Every node is verified against the best head of
its buckets, and linked nodes become components. Where a bucket still holds several components, one more pass follows:
in one of at most ``EACH`` nodes all pairs across components are verified, at most EACH / 2 a node; in a larger one its
head is verified against all nodes of other components. What large buckets then hold of several
components is settled exactly by prefix filtering: two sets of sizes s and t and a Jaccard similarity of ``similar`` or
more share o >= similar / (1 + similar) * (s + t) shingles, so in any common order of shingles the first s - o + 1 of
one and t - o + 1 of the other share one. The order is by rarity, so that few others share it. Of two nodes of one
bucket in different components one is outside the bucket's largest component; such nodes emit their whole prefix, the
others only what may stand in one of those. Every pair across components that meets is verified. A multiset counts as
the set of its numbered shingles.

Components come from label passing with shortcuts; links of a later pass join the components of the one before. Tested
pairs are a folder that passes append to, so no plan grows with the passes, and their number is fixed. Nothing is collected but counts and marks of ``CELLS`` cells of shingle
hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import slices, whole_text
from scorewright.llm.shingles import mix, whole_shingles
from scorewright.session import Grown, materialise, settled

EACH = 32
ROWS_PER_TASK = 1_000
CELLS = 1 << 18
Bands = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Elements = Callable[[np.ndarray], np.ndarray]


def node() -> Column:
    """A 128-bit hash of the text; empty and null texts are alike."""
    return F.unhex(F.md5(whole_text()))


def band_hashes(signature: np.ndarray, bands: int, rows: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the signatures marked in ``some``, one after the other, and how many each signature has."""
    parts = signature[some].reshape(-1, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        out = mix(out ^ mix(parts[:, :, r]))
    return out.reshape(-1), np.where(some, bands, 0)


def _sketches(docs: DataFrame, bands_of: Bands) -> DataFrame:
    """doc_id, node and bands of every document."""

    def sketch(batches):
        for batch in slices(batches, "text", 1_000_000):
            values, counts = bands_of(batch.column("text"))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["doc_id", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("node"), whole_text().alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, node binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def verify(batches):
        known, head = None, np.zeros(0, np.uint64)
        for batch in slices(slices(batches, "text_a", 500_000), "text_b", 1_000_000):
            hashes, counts = whole_shingles(batch.column("text_a"))
            ends = np.cumsum(counts)
            keep = []
            for i, (b, text) in enumerate(zip(batch.column("b").to_pylist(), batch.column("text_b"))):
                if b != known:  # pairs of one head come together
                    known, head = b, whole_shingles(pa.array([text.as_py()], pa.string()))[0]
                keep.append(similarity(hashes[ends[i] - counts[i]:ends[i]], head) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
           .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))
    return met.mapInArrow(verify, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node it is connected to."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        labels = materialise(lower.join(jump, "to", "left")
                             .select("node", "was", F.least("to", F.coalesce("further", "to")).alias("label")), "labels")
        if labels.where("was != label").isEmpty():
            return labels.select("node", "label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) as ``components`` makes them of all links, from those of the links before and the further links (a, b).

    Links of components are followed, not those within them again: there are no more of them than further links.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = materialise(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "known")
    a, b = (known.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")) for end in "ab")
    between = links.join(a, "a").join(b, "b").where("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    parts = components(between).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return materialise(known.join(parts, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")


def _heads(members: DataFrame) -> DataFrame:
    """(band, head, rank): of each bucket the node that meets most others in all its buckets, and how many it meets."""
    best = F.max(F.struct("weight", "node"))
    return members.groupBy("band").agg(best.alias("best")).select("band", F.col("best.node").alias("head"), F.col("best.weight").alias("rank"))


def _elements(batch: pa.RecordBatch, elements_of: Elements) -> list[np.ndarray]:
    hashes, counts = whole_shingles(batch.column("text"))
    return [elements_of(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]


def _cell(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) % np.uint64(CELLS)).astype(np.int64)


def _by_cell(counted: DataFrame) -> np.ndarray:
    """Sums of (cell, n) as an array of ``CELLS``."""
    cells = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out


_PREFIX = "element long, node binary, label binary, size int, place int, outside boolean"


def rare_pairs(texts: DataFrame, elements_of: Elements, similar: float) -> DataFrame:
    """Pairs (a, b) of nodes with different labels, among them all of a Jaccard similarity of ``similar``.

    ``texts`` has node, label, text and, if some pairs are not asked for, outside: of each pair one node is. ``elements_of``
    makes the distinct elements of a text of its shingles.
    """
    if "outside" not in texts.columns:
        texts = texts.withColumn("outside", F.lit(True))
    context = texts.sparkSession.sparkContext
    # alike texts in few tasks: what is counted per task is then counted once for many of them
    texts = materialise(texts, "left-texts")
    texts = texts.coalesce(-(-texts.count() // ROWS_PER_TASK) or 1)

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text", 1_000_000):
            for elements in _elements(batch, elements_of):
                np.add.at(total, _cell(elements), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    common = context.broadcast(_by_cell(texts.select("text").mapInArrow(count, "cell long, n long")))

    def prefixes(marked):
        def first(batches):
            for batch in slices(batches, "text", 1_000_000):
                parts, places, sizes = [], [], []
                for elements in _elements(batch, elements_of):
                    n = len(elements)
                    long = n - int(np.ceil(similar * n - 1e-6)) + 1 if n else 0
                    part = elements[np.lexsort((elements, common.value[_cell(elements)]))[:long]]
                    place = np.arange(len(part), dtype=np.int32)
                    if marked is not None:
                        may = marked.value[_cell(part)]
                        part, place = part[may], place[may]
                    parts.append(part)
                    places.append(place)
                    sizes.append(n)
                many = np.array([len(p) for p in parts])
                of = pa.array(np.repeat(np.arange(len(parts)), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), batch.column("node").take(of), batch.column("label").take(of),
                     pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate(places)),
                     batch.column("outside").take(of)], _PREFIX.replace(",", "").split(" ")[::2])
        return first

    rows = texts.select("node", "label", "text", "outside")
    outer = materialise(rows.where("outside").mapInArrow(prefixes(None), _PREFIX), "prefixes")

    def mark(batches):
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            seen[_cell(batch.column("element").to_numpy().view(np.uint64))] = 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    marked = context.broadcast(_by_cell(outer.select("element").mapInArrow(mark, "cell long, n long")) > 0)
    inner = materialise(rows.where("not outside").mapInArrow(prefixes(marked), _PREFIX), "prefixes")
    every = outer.unionByName(inner)
    across = every.groupBy("element").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("element")
    every = materialise(every.join(across, "element"), "prefixes")
    a, b = (every.select("element", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "size", "place", "outside")]) for side in "ab")
    a = a.where("outside_a")
    both = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(similar / (1 + similar)) - 1e-6)
    near = ((a.element == b.element) & (F.col("label_a") != F.col("label_b")) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b")))
            & (F.col("place_a") <= F.col("size_a") - both) & (F.col("place_b") <= F.col("size_b") - both))
    return a.join(b, near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, bands_of: Bands, similarity, similar: float, elements_of: Elements) -> DataFrame:
    """Per document: doc_id, node, label (a node of its class) and class_id, the least id in the class (null ids aside)."""
    sketches = materialise(_sketches(docs, bands_of), "sketches")
    by_node = settled(docs.sparkSession, lambda: _labelled(docs, sketches, similarity, similar, elements_of), "classes")
    return sketches.select("doc_id", "node").join(by_node, "node")


def _labelled(docs: DataFrame, sketches: DataFrame, similarity, similar: float, elements_of: Elements) -> DataFrame:
    """(node, label, class_id) of every node."""
    spark = docs.sparkSession
    nodes = materialise(sketches.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, "band"), "buckets")  # buckets of two nodes and more
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    shared = materialise(shared.join(weights, "node"), "buckets")
    met = shared.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("node"), whole_text().alias("text"))
             .join(met.select(F.col("node").alias("of"), "first").hint("shuffle_hash"),
                   F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("node") == F.col("of"))).select("node", "text"))
    texts = materialise(texts, "texts")
    tested = Grown(spark, "a binary, b binary", "pairs")

    def verify(pairs: DataFrame) -> DataFrame:
        """The similar pairs among those that were not tested before."""
        fresh = materialise(pairs.join(tested.table(), ["a", "b"], "left_anti") if tested.filled else pairs, "fresh")
        found = materialise(_verified(fresh, texts, similarity, similar), "found")
        tested.add(fresh)
        return found

    heads = materialise(_heads(shared), "heads")
    best = (shared.join(heads, "band").where("node != head").groupBy("node")
            .agg(F.max(F.struct("rank", "head")).alias("best")).select(F.col("node").alias("a"), F.col("best.head").alias("b")))
    labels = components(verify(_ordered(best)))
    large, own = _unsettled(shared, labels)
    of = large.join(heads.select("band", F.col("head").alias("node")), ["band", "node"]).select("band", F.col("node").alias("b"), F.col("label").alias("other"))
    small = own.where(F.col("n") <= EACH)
    others = small.select("band", F.col("node").alias("b"), F.col("label").alias("other"))
    fresh = large.join(of, "band").where("label != other").union(small.join(others, "band").where("label < other"))
    labels = joined(labels, verify(_ordered(fresh.select(F.col("node").alias("a"), "b"))))
    large, _ = _unsettled(shared, labels)
    per = large.groupBy("band", "label").agg(F.count("*").alias("many"))
    main = per.groupBy("band").agg(F.max(F.struct("many", "label")).alias("main")).select("band", F.col("main.label").alias("main"))
    left = materialise(large.join(main, "band").groupBy("node").agg(
        F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("outside")), "left")
    if not left.isEmpty():
        labels = joined(labels, verify(_ordered(rare_pairs(texts.join(left, "node"), elements_of, similar))))
    firsts = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    classes = firsts.groupBy("label").agg(F.min("first").alias("class_id"))
    return firsts.join(classes, "label").select("node", "label", "class_id")


def _unsettled(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, node, n, weight, label) of buckets that hold several components: of the large ones, and of all."""
    own = shared.join(labels, "node", "left").select("band", "node", "n", "weight", F.coalesce("label", "node").alias("label"))
    split = own.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("band")
    own = materialise(own.join(split, "band"), "split")
    return own.where(F.col("n") > EACH), own
