"""Near copies and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from scorewright.llm import bagminhash, minhash, shingles


def shingle_bag(text):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").lower()) if w]
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def likeness(a, b, weighted):
    if not weighted:
        a, b = Counter(dict.fromkeys(a, 1)), Counter(dict.fromkeys(b, 1))
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if a or b else 1.0


def brute_classes(rows, weighted=True):
    """Row number to the row numbers of its class."""
    bags = [shingle_bag(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(list)
    for i, bag in enumerate(bags):
        for s in bag or ["none"]:
            holders[s].append(i)
    for i, bag in enumerate(bags):
        for j in {j for s in (bag or ["none"]) for j in holders[s] if j < i}:
            same_text = (rows[i][1] or "") == (rows[j][1] or "")
            if same_text or (bag and likeness(bag, bags[j], weighted) >= 0.8):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(rows))]


def family(seed=3):
    """Copies with few edits, a chain of edits, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(25):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 2)):
            copy[at] = word()
        rows.append(" ".join(copy))
    chain = [word() for _ in range(150)]
    for i in range(12):
        chain[i * 9 + 3] = word()
        rows.append("  ".join(chain))
    rows += [rows[0]] * 30 + [" ".join(word() for _ in range(80)) for _ in range(20)] + ["one two", "one two", "One\tTWO", "x"] + [None, "", " "]
    return list(enumerate(rows))


def as_names(rows, roots):
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return Counter((doc, least.get(r)) for (doc, _), r in zip(rows, roots))


def test_shingles_do_not_depend_on_slices():
    texts = [t for _, t in family() if t is not None]
    hashes, counts = shingles.shingle_hashes(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(re.findall(r"[^ \t-\r]+", t)) for t in texts]
    assert hashes.tolist() == [h for t in texts for h in shingles.shingle_hashes(pa.array([t]))[0].tolist()]


def test_bagminhash_is_unbiased():
    values = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.repeat(values, np.arange(1, 40)), np.repeat(values, np.arange(39, 0, -1))
    s = bagminhash.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), 4000)
    assert abs((s[0] == s[1]).mean() - bagminhash.weighted_jaccard(a, b)) < 0.03
    assert np.isinf(bagminhash.signatures(np.zeros(0, np.uint64), np.array([0]), 8)).all()


def test_classes(spark):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = as_names(rows, brute_classes(rows))
    assert Counter((r.doc_id, r.class_id) for r in bagminhash.copy_classes(docs).collect()) == want
    kept = bagminhash.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want})
    assert Counter((r.doc_id, r.class_id) for r in minhash.similar_classes(docs).collect()) == as_names(rows, brute_classes(rows, weighted=False))


def test_classes_of_documents(documents, texts):
    rows = sorted(texts.items())
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.copy_classes(documents).collect())
    assert got == as_names(rows, brute_classes(rows))


def test_classes_odd(odd_docs, odd_rows, no_docs):
    got = bagminhash.copy_classes(odd_docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == as_names(odd_rows, brute_classes(odd_rows))
    kept = bagminhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    roots = brute_classes(odd_rows)
    assert kept.count() == len(set(roots))
    assert bagminhash.copy_classes(no_docs).collect() == []
    assert bagminhash.deduplicated(no_docs).collect() == []


def brute_neighbours(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        yield doc, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints(documents, texts):
    got = minhash.fingerprint_neighbours(documents, parts=7).collect()
    rows = sorted(texts.items())
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(brute_neighbours(rows))
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    bags = {d: shingle_bag(t) for d, t in rows}
    edited = {d: (t[:len(t) - len(t) // 2] + n[:len(t) // 2]) for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1])}
    errors = [abs(r.near_edited - likeness(bags[r.doc_id], shingle_bag(edited[r.doc_id]), False)) for r in got]
    assert np.mean(errors) < 0.05 and max(errors) < 0.25


def test_fingerprints_odd(spark, odd_docs, odd_rows, no_docs):
    got = minhash.fingerprint_neighbours(odd_docs, parts=3).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(brute_neighbours(odd_rows))
    assert minhash.fingerprint_neighbours(no_docs).collect() == []
    one = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    assert minhash.fingerprint_neighbours(one).first().near_next == 1.0
