"""Toxicity by the nearest labelled examples, found exactly with a block-max inverted index.

Terms are lower-case words. A document's vector holds all its words, by TF-IDF; document frequencies are counted over all
documents. Terms whose labelled documents are reliably toxic weigh ``RAISED`` times as much, since the few toxic words of a
long text would else drown among the others (held-out recall 0.34): the lower bound of the confidence interval of their
toxic share is ``LEAST_SHARE`` or more, on the examples, each counted for those it stands for and documents that share
passages once, and with the term's share among all labelled documents. Examples are a bounded sample of labelled documents
(``per_label`` of each label, none held out); their unit vectors go into an inverted index, cut into blocks of examples
that share their most common word, with a top weight of each common term a block. A document's ``neighbours`` highest
cosines are found exactly: rare terms are summed up for all examples, and blocks whose top weights cannot lift one to the
``neighbours``-th best of these sums are left; what short floats then show to be near is summed up exactly. Votes are weighted by cosine and by how many labelled documents an example stands for, with the
toxic share of examples without a raised term as a prior vote, so the score is calibrated to the labelled share. The ids of
the nearest examples are the evidence.

Defined cases: a null or empty text, or one without a word of any example, has no neighbours and gets the prior. Null ids are held
out and scored. Null labels are not learned from; a document labelled twice counts once, with its lower label; of rows
of one id the one of the least text hash is learned from. Without
labels the score is the prior of nothing known, near 0. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import held_out, slices, whole_text
from scorewright.llm.linking import components
from scorewright.llm.minhash import signatures
from scorewright.llm.rule_ensemble import known_labels, labelled_sample
from scorewright.llm.shingles import mix
from scorewright.session import materialise

PER_LABEL = 3_000
LEAST_SHARE = 0.5
SLOTS = 128  # of the signatures that tell examples which share passages
MET = 16  # slots by which they meet
SHARED = 0.2  # share of equal slots; copies with a word in ten edited still have 0.3
NEIGHBOURS = 15
EVIDENCE = 5
TOXIC = 0.5
BLOCK = 64
RAISED = 30.0  # times the weight of other terms
COMMON = 1 / 16  # share of the examples from which on a term's weights are held for each example
_WORD = re.compile(r"\w+")


class BlockMaxIndex:
    """Exact top-k by inner product over sparse vectors of weights above zero."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        terms = sorted({t for v in vectors for t in v})
        self.row = {t: i for i, t in enumerate(terms)}
        of = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        self._fill(np.array([self.row[t] for v in vectors for t in v], np.int64), of, np.array([w for v in vectors for w in v.values()]), len(terms), len(vectors), block)

    @classmethod
    def of(cls, rows: np.ndarray, at: np.ndarray, weights: np.ndarray, terms: int, n: int, block: int = BLOCK) -> BlockMaxIndex:
        """From postings: a term's row, a vector's number and the weight there."""
        out = cls.__new__(cls)
        out._fill(rows, at, weights, terms, n, block)
        return out

    def _fill(self, rows, at, weights, terms, n, block) -> None:
        self.n, self.block, self.blocks = n, block, -(-n // block)
        many = np.bincount(rows, minlength=terms)
        self.common = np.where(many > max(8, COMMON * n), np.cumsum(many > max(8, COMMON * n)) - 1, -1)  # place among the common terms
        often = self.common[rows] >= 0
        self.dense = np.zeros((int((self.common >= 0).sum()), self.blocks * block))
        self.dense[self.common[rows[often]], at[often]] = weights[often]
        self.dense = self.dense.reshape(len(self.dense), self.blocks, block)
        self.tops = self.dense.max(axis=2, initial=0.0)
        self.short = self.dense.astype(np.float32)  # tells what can be among the nearest, before it is summed up exactly
        rows, at, weights = rows[~often], at[~often], weights[~often]
        order = np.argsort(rows, kind="stable")
        self.at, self.weights = at[order].astype(np.int32), weights[order]
        self.many = np.where(self.common >= 0, 0, many)
        self.start = np.cumsum(self.many) - self.many

    def search(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k highest (cosine, vector number) above zero; of equal cosines the lower numbers."""
        known = [(self.row[t], w) for t, w in query.items() if t in self.row]
        return self.nearest([(np.array([r for r, _ in known], np.int64), np.array([w for _, w in known], np.float64))], k)[0]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``search`` for several queries, as rows of terms and weights."""
        places = self.blocks * self.block
        rare, common = np.zeros((len(queries), places)), np.zeros((len(queries), len(self.dense)), np.float32)
        for j, (rows, weights) in enumerate(queries):
            many = self.many[rows]
            place = np.repeat(self.start[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
            rare[j] = np.bincount(self.at[place], self.weights[place] * np.repeat(weights, many), places)
            often = self.common[rows] >= 0
            common[j, self.common[rows[often]]] = weights[often]
        if places < k:
            floor = np.zeros(len(queries))
        else:
            floor = np.partition(rare, places - k, axis=1)[:, places - k]  # the k-th best has that much by rare terms alone
        shared = common @ self.tops.astype(np.float32)
        slack = 1e-12 + 1.2e-7 * ((common > 0).sum(axis=1) + 4) * shared.max(axis=1, initial=0.0)  # more than the error of short sums
        may = rare.reshape(len(queries), self.blocks, self.block).max(axis=2, initial=0.0) + shared + slack[:, None] >= floor[:, None]
        use = np.flatnonzero(may.any(axis=0))
        short = self.short if len(use) == self.blocks else self.short[:, use]
        about = np.zeros((len(queries), self.blocks, self.block))
        about[:, use] = (common @ short.reshape(len(short), len(use) * self.block)).reshape(len(queries), len(use), self.block)
        about = about.reshape(len(queries), places) + rare
        out = []
        for j, (rows, weights) in enumerate(queries):
            kth = np.partition(about[j], places - k)[places - k] - 2 * slack[j] if places >= k else 0.0
            near = np.flatnonzero(about[j] >= max(kth, 1e-300))
            often = self.common[rows] >= 0
            exact = rare[j, near] + weights[often] @ self.dense.reshape(len(self.dense), places)[self.common[rows[often]][:, None], near]
            out.append([(-s, i) for s, i in sorted((-round(x, 12), i) for x, i in zip(exact.tolist(), near.tolist()))[:k] if s < 0])
        return out


class Voter:
    """Scores texts; holds the terms, the index, the examples' votes and the prior.

    ``idf`` are the raised terms, ``scale`` the inverse weights of all ``terms``. Each of the examples is (id, toxic, weight)
    with its terms' numbers, in the order of ``terms``, and their counts.
    """

    def __init__(self, idf: dict[str, float], terms: list[str], scale: np.ndarray,
                 examples: list[tuple[int, float, float, np.ndarray, np.ndarray]], neighbours: int = NEIGHBOURS):
        self.idf, self.neighbours = idf, neighbours
        self.number = {t: i for i, t in enumerate(terms)}
        raised = np.array([t in idf for t in terms], bool)
        self.scale = np.where(raised, RAISED * scale, scale)
        bare = [e for e in examples if not raised[e[3]].any()]
        total = sum(e[2] for e in bare)
        self.prior = (sum(e[1] * e[2] for e in bare) + 0.01) / (total + 1.0)
        filled = [e for e in examples if len(e[3])]
        spread = np.bincount(np.concatenate([e[3] for e in filled]), minlength=len(terms)) if filled else np.zeros(0, np.int64)
        filled.sort(key=lambda e: (int(e[3][spread[e[3]].argmax()]), e[0]))  # those in one language stand together
        self.ids, self.toxic, self.weight = ([e[i] for e in filled] for i in range(3))
        vectors = [self.unit(e[3], e[4]) for e in filled]
        self.index = BlockMaxIndex.of(
            *(np.concatenate(c) if filled else np.zeros(0, np.int64) for c in (
                [e[3] for e in filled], [np.full(len(e[3]), i, np.int32) for i, e in enumerate(filled)], vectors)), len(terms), len(filled))

    def unit(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.scale[rows]
        return raw / (np.sqrt((raw * raw).sum()) or 1.0)

    def __call__(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        out = []
        for i in range(0, len(texts), self.index.block):
            queries = [self.query(t) for t in texts[i:i + self.index.block]]
            out += [self.vote(near) for near in self.index.nearest(queries, self.neighbours)]
        return out

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(_WORD.findall(text.lower()))
        rows = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        counts = np.fromiter(words.values(), np.int64, len(words))
        order = np.argsort(rows)[np.count_nonzero(rows < 0):]
        return rows[order], self.unit(rows[order], counts[order])

    def vote(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        if not near:
            return self.prior, []
        votes = [(s * self.weight[i], self.toxic[i]) for s, i in near]
        prior_vote = min(w for w, _ in votes)
        score = (sum(v * y for v, y in votes) + prior_vote * self.prior) / (sum(v for v, _ in votes) + prior_vote)
        return score, [self.ids[i] for _, i in near[:EVIDENCE]]


def _copies(examples: DataFrame) -> DataFrame:
    """(doc_id, copies) of examples that share passages with others: the least id of those linked to it.

    A document is compared with one other, the least id, of those with which it shares a slot, so the pairs are few.
    """

    def sketch(batches):
        for batch in slices(batches, "text", 1_000_000):
            slots = signatures(batch.column("text"), SLOTS)
            offsets = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()),
                                              pa.ListArray.from_arrays(offsets, pa.array(slots.reshape(-1).astype(np.int64)))], ["doc_id", "slots"])

    sketches = materialise(examples.select("doc_id", "text").mapInArrow(sketch, "doc_id long, slots array<long>"), "toxic-sketches")
    met = sketches.select("doc_id", F.posexplode(F.slice("slots", 1, MET)).alias("at", "slot"))
    heads = met.groupBy("at", "slot").agg(F.min("doc_id").alias("head"))
    pairs = met.join(heads, ["at", "slot"]).where("doc_id != head").select("doc_id", "head").distinct()
    others = sketches.select(F.col("doc_id").alias("head"), F.col("slots").alias("others"))
    alike = F.size(F.filter(F.zip_with("slots", "others", lambda x, y: x == y), lambda same: same))
    links = pairs.join(sketches, "doc_id").join(others, "head").where(alike >= SHARED * SLOTS)
    return components(links.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))).select(
        F.col("node").alias("doc_id"), F.col("label").alias("copies"))


def _labelled_terms(examples: DataFrame) -> DataFrame:
    """(term, y, weight, copies): examples with a term; those that share passages count once."""

    def terms(batches):
        for batch in slices(batches, "text", 500_000):
            found = [list(set(_WORD.findall(text.lower()))) for text in batch.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for f in found for t in f], pa.string()), *[batch.column(c).take(of) for c in ("y", "weight", "copies")]],
                ["term", "y", "weight", "copies"])

    marked = examples.join(_copies(examples), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.col("doc_id").cast("long")))
    return marked.mapInArrow(terms, "term string, y double, weight double, copies long").distinct()


def _term_hits(texts: DataFrame, terms: frozenset, vocabulary: frozenset) -> DataFrame:
    """(doc_id, key, sketch, terms): every row with those of the terms it has; ``sketch``, of rows with any, is shared by copies.

    Rows with ``counts`` are of no document: how many of a task's documents have each of the vocabulary's ``terms``.
    """
    wanted = texts.sparkSession.sparkContext.broadcast((terms, vocabulary))  # of the bounded sample
    names = ["doc_id", "key", "sketch", "terms", "counts"]

    def meet(batches):
        terms, vocabulary = wanted.value
        have: Counter = Counter()
        for batch in slices(batches, "text", 1_000_000):
            found = []
            for text in batch.column("text").to_pylist():
                words = vocabulary.intersection(_WORD.findall(text.lower()))
                have.update(words)
                found.append(list(terms & words))
            some = np.array([bool(f) for f in found])
            sketch = np.zeros(len(found), np.uint64)
            if some.any():
                slots = signatures(batch.column("text").filter(pa.array(some)), 4)
                sketch[some] = mix(slots.astype(np.uint64) * np.arange(1, 9, 2, dtype=np.uint64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sketch.view(np.int64)),
                                              pa.array(found, pa.list_(pa.string())), pa.nulls(len(found), pa.list_(pa.int64()))], names)
        counted = list(have.items())
        for i in range(0, len(counted), 10_000):
            part = counted[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([[t for t, _ in part]], pa.list_(pa.string())),
                                              pa.array([[n for _, n in part]], pa.list_(pa.int64()))], names)

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(meet, "doc_id long, key long, sketch long, terms array<string>, counts array<long>")


def _bound(share, n):
    """The lower end of Wilson's interval of a share of ``n``: of columns or of numbers."""
    z2 = 1.96 ** 2
    return (share + z2 / (2 * n) - 1.96 * (share * (1 - share) / n + z2 / (4 * n * n)) ** 0.5) / (1 + z2 / n)


def _toxic_terms(examples: DataFrame, known: DataFrame, texts: DataFrame, least_share: float, vocabulary: list[str]) -> tuple[set[str], np.ndarray]:
    """The reliably toxic terms, and how many documents have each term of the vocabulary, which is that of the examples.

    A term must pass on the examples, those that share passages counted once, and keep to it with its share among all
    labelled documents: a clean word may be missing in a sample of clean documents.
    """
    w, hit = F.col("weight"), F.col("y") == 1
    by_term = _labelled_terms(examples).groupBy("term").agg(
        F.sum(F.when(hit, w).otherwise(0.0)).alias("hits"), F.sum(w).alias("all"), F.sum(w * w).alias("squares"))
    by_term = by_term.select("term", (F.col("hits") / F.col("all")).alias("share"),
                             (F.col("all") * F.col("all") / F.col("squares")).alias("n"))  # n: as many equal ones
    # terms of the bounded sample alone
    likely = {r.term: r.n for r in by_term.where(_bound(F.col("share"), F.col("n")) >= least_share).collect()}
    hits = materialise(_term_hits(texts, frozenset(likely), frozenset(vocabulary)), "toxic-hits")
    counted = hits.where("counts is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("of"))
    counted = counted.groupBy(F.col("of.terms").alias("term")).agg(F.sum("of.counts").alias("n")).toArrow()
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[pc.index_in(counted["term"], pa.array(vocabulary, pa.string())).to_numpy()] = counted["n"].to_numpy()
    met = hits.where("counts is null").drop("counts")
    row = F.min(F.struct("key", "sketch", "terms", "y")).alias("row")  # of rows of one id that of the least text hash
    judged = met.join(known, "doc_id").groupBy("doc_id").agg(row).select("row.sketch", "row.y", F.explode("row.terms").alias("term"))
    shares = {r.term: r.share for r in judged.distinct().groupBy("term").agg(F.avg("y").alias("share")).collect()}
    return {t for t, n in likely.items() if t in shares and _bound(shares[t], n) >= least_share}, frequency


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, least_share: float = LEAST_SHARE) -> Voter:
    chosen = labelled_sample(docs, labels, "toxic", per_label)
    texts = docs.select("doc_id", whole_text().alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("key"), "text", "y", "weight").alias("row"))
    examples = materialise(met.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.text", "row.y", "row.weight"), "toxic-examples")

    def counts(batches):
        for batch in slices(batches, "text"):
            found = [Counter(_WORD.findall(t.lower())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y"), batch.column("weight"),
                 pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))],
                ["doc_id", "y", "weight", "terms", "counts"])

    # 2 * per_label rows of their distinct words
    rows = examples.mapInArrow(counts, "doc_id long, y double, weight double, terms array<string>, counts array<long>").toArrow()
    words = pa.chunked_array([c.flatten() for c in rows["terms"].chunks], pa.string())
    found = np.concatenate([c.flatten().to_numpy() for c in rows["counts"].chunks] + [np.zeros(0, np.int64)]).astype(np.int32)
    ends = np.cumsum(pc.list_value_length(rows["terms"]).to_numpy())[:-1]
    heads = [rows[c].to_pylist() for c in ("doc_id", "y", "weight")]
    del rows
    terms = sorted(words.unique().to_pylist())
    numbers = pc.index_in(words, pa.array(terms, pa.string())).to_numpy()
    del words
    toxic, frequency = _toxic_terms(examples, known_labels(labels, "toxic"), texts, least_share, terms)
    scale = np.log((1 + docs.count()) / (1 + frequency)) + 1
    split = zip(*heads, np.split(numbers, ends), np.split(found, ends))
    return Voter({t: float(w) for t, w in zip(terms, scale) if t in toxic}, terms, scale, sorted(split, key=lambda e: e[0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (ids of its nearest examples)."""
    voter = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_label))  # bounded by the sample

    def vote(batches):
        vote_of = voter.value
        for batch in slices(batches, "text"):
            found = vote_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= TOXIC) for s, _ in found], pa.int32()),
                 pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(vote, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
