"""Repeated byte strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scorewright.llm import bwt_merge


def plain(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[p:p + length] for _, d in data for p in range(len(d) - length + 1))
    for i, d in data:
        cover = np.zeros(len(d) + 1, np.int64)
        for p in range(len(d) - length + 1):
            if count[d[p:p + length]] > 1:
                cover[p] += 1
                cover[p:p + length] |= 1 << 30
        gone = cover[:-1] > 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        yield i, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else x for x in row)


def same(df, rows, length=400):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(plain(rows, length), key=key)


def edited(rng, text, many):
    text = list(text)
    for at in rng.sample(range(len(text)), min(many, len(text))):
        text[at] = rng.choice("xyzé ")
    return "".join(text)


def family(seed, many=30, size=900):
    """Copies with edits, shared passages, repeats within a text, low-entropy texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n // 5))
    base, passage = prose(size), prose(size // 2)
    texts = [edited(rng, base, rng.choice([0, 1, 2, 5])) for _ in range(many)]
    texts += [prose(rng.randint(0, size)) + passage[rng.randint(0, 60):rng.randint(size // 3, size // 2)] + prose(rng.randint(0, size)) for _ in range(many)]
    texts += [prose(100) + passage + prose(50) + passage, "a" * size, "ab" * (size // 2), "a" * (size // 3) + "b" + "a" * (size // 2), "-" * 30 + prose(300)]
    texts += [base[:size // 2], base[size // 2:], base + base, passage * 3]
    return list(enumerate(texts))


@pytest.mark.parametrize("length, size", [(24, 60), (40, 120), (400, 1500)])
def test_like_all_strings(spark, length, size):
    rows = family(length, size=size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(bwt_merge.removals(docs, length), rows, length)


def test_documents(documents, texts):
    same(bwt_merge.removals(documents), list(texts.items()))


def test_odd_texts(spark, odd_docs, odd_rows, no_docs):
    same(bwt_merge.removals(odd_docs), odd_rows)
    done = bwt_merge.removed(odd_docs)
    assert done.select("row_.*").columns == odd_docs.columns
    assert bwt_merge.removed(no_docs).collect() == []


def test_long_texts_are_cut_into_pieces():
    """Small shards: strings across the cuts are found, each start lies in one piece."""
    sizes = [5_000, 0, 399, 400, 401, 1_023, 1_424, 20_000]
    starts = Counter()
    for shard in bwt_merge.pieces(sizes, 400, 2_048):
        assert sum(e - b for _, b, e in shard) <= 2_048
        starts.update((t, p) for t, b, e in shard for p in range(b, e - 400 + 1))
    assert starts == Counter((t, p) for t, n in enumerate(sizes) for p in range(n - 400 + 1))


def test_transform_and_blocks():
    """The transform's suffix order and last-to-first mapping, and blocks that stand for equal prefixes."""
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 110, 3_000).astype(np.uint8)
    parts = [np.concatenate((rng.integers(97, 110, 500).astype(np.uint8), passage, rng.integers(97, 110, 700).astype(np.uint8))) for _ in range(3)]
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    shard = bwt_merge.Shard(np.concatenate(parts), edges)
    bwt, mapping, rank = shard.transform()
    assert sorted(rank.tolist()) == list(range(len(rank)))
    many = len(shard.anchors)
    for i in range(many - 1):
        if shard.piece[i] == shard.piece[i + 1]:
            assert mapping[rank[i + 1]] == rank[i]
    assert (mapping >= 0).sum() == many
    # last-to-first keeps the order of suffixes after equal symbols
    by_symbol = {}
    for symbol, to in zip(bwt[mapping >= 0].tolist(), mapping[mapping >= 0].tolist()):
        assert by_symbol.get(symbol, -1) < to
        by_symbol[symbol] = to
    names = Counter(shard.names().tolist())
    assert sum(n == 3 for n in names.values()) >= 10


def test_windows():
    values = np.random.default_rng(1).integers(0, 99, 300)
    for width in (1, 2, 5, 64, 160, 300):
        assert bwt_merge.window_minima(values, width).tolist() == [values[i:i + width].min() for i in range(301 - width)]
