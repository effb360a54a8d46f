"""Secret scan: fixed patterns, and random-looking strings by two character Markov models.

The models are first-order over ASCII characters: one of random strings, one of ordinary words and identifiers. A
run of characters is a secret if its log-likelihood ratio, in total and per character, passes the thresholds; of a run
that fixed spans overlap, what they leave is one if the whole run or it alone passes. Training strings are labelled by the patterns: their values in a bounded
sample of documents (``sample`` of them, by a hash of the id) are random strings, together with seeded random ones of
common alphabets, so that every table has some; the other words of the sample are ordinary, as written and in capitals,
together with identifiers, dates and rules of one repeated mark.

Defined cases: a null or empty text has no span. Spans are in code points, end exclusive. Overlapping spans of
different patterns all stay. Null and repeated ids are rows of their own. Other columns are ignored by ``scan`` and
pass through ``masked``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import slices, whole_text

SAMPLE = 2_000
LEAST_CHARS = 16
PER_CHAR = 0.5
IN_ALL = 12.0
KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789-")
_IDENTIFIERS = ("identifier", "configuration_value", "HttpRequestHandler", "max-retry-count", "getElementById", "utf8_decode2")
_DATES = tuple(f"{y}-{m:02}-{d:02}" for y in range(1990, 2040) for m in range(1, 13) for d in (1, 9, 17, 25, 30))
_RULES = tuple(c * 100 for c in "-_=+/") * 50
Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def _pairs(string: str):
    """Neighbouring characters of a string as numbers; zero stands for the start, 127 for all that is not ASCII."""
    last = 0
    for c in string:
        now = min(ord(c), 127)
        yield last * 128 + now
        last = now


class MarkovPair:
    """Log-likelihood ratio of random strings to ordinary ones, as a table over character pairs."""

    def __init__(self, random_pairs: Counter, ordinary_pairs: Counter, smoothing: float = 0.5):
        a, b = self._log(random_pairs, smoothing), self._log(ordinary_pairs, smoothing)
        self.ratio = [x - y for x, y in zip(a, b)]

    @staticmethod
    def _log(pairs: Counter, smoothing: float) -> list[float]:
        out = []
        for first in range(128):
            row = [pairs[first * 128 + c] + smoothing for c in range(128)]
            total = sum(row)
            out += [math.log(c / total) for c in row]
        return out

    def __call__(self, string: str) -> float:
        return sum(self.ratio[p] for p in _pairs(string))


def random_strings(many: int = 400, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(16, 40))) for alphabet in _ALPHABETS for _ in range(many)]


def labelled_strings(text: str) -> tuple[list[str], list[str]]:
    """Values of the fixed patterns, and the words outside them."""
    spans = base_spans(text)
    secret = [text[s:e] for s, kind, e in spans if kind != "assign"]
    secret += [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k == "assign" for _, k, _ in spans) else []
    return secret, _WORD.findall(mask(text, spans, " "))


def train(docs: DataFrame, sample: int = SAMPLE) -> MarkovPair:
    """Both models, from pair counts that Spark sums: at most two tables of 128 by 128, whatever the sample."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(whole_text().alias("text"))

    def count(batches):
        for batch in slices(batches, "text"):
            pairs: Counter = Counter()
            for text in batch.column("text").to_pylist():
                for label, strings in enumerate(labelled_strings(text)):
                    for string in strings:
                        for form in {string, string.upper()} if label else (string,):
                            pairs.update((label, p) for p in _pairs(form))
            yield pa.RecordBatch.from_pydict({"label": pa.array([k[0] for k in pairs], pa.int32()),
                                              "pair": pa.array([k[1] for k in pairs], pa.int32()),
                                              "n": pa.array(list(pairs.values()), pa.int64())})

    summed = chosen.mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    random_pairs, ordinary_pairs = Counter(), Counter()
    for row in summed.collect():
        (ordinary_pairs if row.label else random_pairs)[row.pair] = row.n
    for strings, into in ((random_strings(), random_pairs), (_IDENTIFIERS + _DATES + _RULES, ordinary_pairs)):
        for string in strings:
            into.update(_pairs(string))
    return MarkovPair(random_pairs, ordinary_pairs)


def _random(string: str, model: MarkovPair) -> bool:
    return len(string) >= LEAST_CHARS and (ratio := model(string)) >= IN_ALL and ratio >= PER_CHAR * len(string)


def all_spans(text: str, model: MarkovPair) -> list[Span]:
    spans = base_spans(text)
    found = []
    for m in _RUN.finditer(text):
        begin, end = m.span()
        over = [s for s in spans if s[0] < end and begin < s[2]]
        # an assigned value reaches to the run's end, and before it stands its name
        end = min([end, *(max(begin, s) for s, kind, _ in over if kind == "assign")])
        free, at = [], begin
        for start, _, stop in over:
            if at < min(start, end):
                free.append((at, min(start, end)))
            at = max(at, stop)
        if at < end:
            free.append((at, end))
        if free:
            whole = _random(text[begin:end], model)
            found += [(a, "markov", b) for a, b in free if whole or _random(text[a:b], model)]
    return sorted(spans + found, key=lambda s: (s[0], KINDS.index(s[1])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))  # two tables of 128 by 128
    out = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                     ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def find(batches):
        pair = model.value
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = all_spans(text, pair)
                counts = [sum(k == kind for _, k, _ in spans) for kind in KINDS]
                base = _joined([s for s in spans if s[1] != "markov"])
                rows.append((doc, *counts, hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
            .mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"))


def mask(text: str, spans: list[Span], mark: str) -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    parts, at = [], 0
    for start, _, end in sorted(spans, key=lambda s: (s[0], s[2])):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, mark: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with secrets masked in the text; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    place = docs.columns.index("text")

    def cover(batches):
        pair = model.value
        for batch in slices(batches, "text"):
            texts = [t if t is None or not (s := all_spans(t, pair)) else mask(t, s, mark) for t in batch.column("text").to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(cover, docs.schema)
