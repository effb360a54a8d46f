"""Hot buckets and edges of shingles, against brute force on plain shingles."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from scorewright.llm import bagminhash, linking, minhash, shingles

KINDS = [(bagminhash.weighted_jaccard, bagminhash.numbered, True), (minhash.jaccard, np.unique, False)]


def templated(many=300, hidden=10, seed=8):
    """Texts of one template with a Jaccard similarity near 0.7, and ``hidden`` further ones near 0.84 to one of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    template = [word() for _ in range(400)]

    def edited(words):
        words = list(words)
        for at in rng.sample(range(5, 395), 7):
            words[at] = word()
        return words

    texts = [edited(template) for _ in range(many)]
    texts += [edited(texts[many - 1 - i]) for i in range(hidden)]
    return [" ".join(t) for t in texts]


def hashed(text):
    return shingles.whole_shingles(pa.array([text], pa.string()))[0]


@pytest.mark.parametrize("similarity, elements, weighted", KINDS)
def test_hot_bucket_loses_no_pair(spark, similarity, elements, weighted):
    texts = templated()
    bags = [hashed(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if similarity(bags[i], bags[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert len(set(root)) == 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    one = lambda batch: (np.full(len(batch), 7, np.uint64), np.ones(len(batch), np.int64))
    got = linking.near_classes(docs, one, similarity, 0.8, elements).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == list(enumerate(root))


@pytest.mark.parametrize("similarity, elements, weighted", KINDS)
def test_prefixes_lose_no_pair(spark, similarity, elements, weighted):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(250)]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(b"%03d" % i, b"%03d" % i, t) for i, t in enumerate(texts)], "node binary, label binary, text string")
    pairs = {(int(r.a), int(r.b)) for r in linking.rare_pairs(rows, elements, 0.8).collect()}
    bags = [hashed(t) for t in texts]
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(bags[i]) and len(bags[j]) and similarity(bags[i], bags[j]) >= 0.8}
    assert near and near <= pairs


def plain(text):
    words = text.lower().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_shingles_are_whole():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcde", k=n)) for n in (0, 1, 2, 4, 5, 6, 9, 20, 40)] + ["a b c d", "a b c d", ""]
    hashes, counts = shingles.whole_shingles(pa.array(texts, pa.string()))
    assert counts.tolist() == [plain(t).total() for t in texts]
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    for (s, a), (t, b) in combinations(zip(texts, parts), 2):
        both, every = (plain(s) & plain(t)).total(), (plain(s) | plain(t)).total()
        assert bagminhash.weighted_jaccard(a, b) == (both / every if every else 1.0)


def test_first_word_spoils_one_shingle(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words), " ".join(["other", *words[1:]]), " ".join(["before", *words]), " ".join(words[:10] + [f"v{i}" for i in range(10)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for classes in (bagminhash.copy_classes, minhash.similar_classes):
        assert sorted((r.doc_id, r.class_id) for r in classes(docs).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_later_links_join_components(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda n: [tuple(sorted(rng.sample(range(200), 2))) for _ in range(n)]
    first, later = draw(90), draw(60)
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    plain = linking.components
    labels = plain(frame(first))
    component = dict(labels.collect())
    followed = []
    monkeypatch.setattr(linking, "components", lambda links: (followed.append(links.count()), plain(links))[1])
    got = dict(linking.joined(labels, frame(later)).collect())
    monkeypatch.undo()
    assert got == dict(plain(frame(first + later)).collect())
    assert followed == [sum(component.get(a, a) != component.get(b, b) for a, b in later)]
    assert dict(linking.joined(labels, frame([])).collect()) == component
