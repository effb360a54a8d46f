"""Shards and packing: equal to encoding whole texts, exact round trips, and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorewright.llm import grammar_store, packing, repair
from scorewright.llm.tokens import WordEncoder
from scorewright.session import new_path

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b\n c\t ", "It's  we'll don't.'s x'S", "ΑΣ Σας İstanbul Å É Å", "a b  c", "", " ", "\n", "foo!!bar's ... '''s _x_ 12ab3 ²³ 五六",
       "<|endoftext|> x<|endoftext|>y", "é. x́, \x1c \x85 a", "x" * 3000, "THE the The!! (the) the?!"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path, spaced, width", [(WORDS, False, 2), (BYTES, True, 4)])
def test_words_equal_whole_texts(texts, path, spaced, width):
    coder, whole = WordEncoder(path, spaced, width, limit=500), Tokenizer.from_file(path)
    many = ODD + list(texts.values())[:60]
    for _ in range(2):  # with an empty and a filled cache
        got = [np.frombuffer(b, f"<u{width}").tolist() for b in coder.encode(many)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in many]


@pytest.mark.parametrize("path, spaced, width", [(WORDS, False, 2), (BYTES, True, 4)])
def test_latin_splits_equal_whole_texts(path, spaced, width):
    rng = random.Random(6)
    letters = "aAzZéÉßŉƻǅªº09²¼½_-.,'\"  \t\n\r\u00a0\u00ad§€<|>sdmtrvl\u0130\u0131\u024f"
    many = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    many += [chr(c) + " a" + chr(c) + "b " + chr(c) for c in range(0x260)]
    coder, whole = WordEncoder(path, spaced, width), Tokenizer.from_file(path)
    got = [np.frombuffer(b, f"<u{width}").tolist() for b in coder.encode(many)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in many]


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [7], [7, 7], [1] * 999, rng.integers(0, 9, 20_000), rng.integers(0, 49_408, 5_000), np.tile(rng.integers(0, 99, 50), 300)):
        ids = np.array(ids, np.uint16)
        block = repair.pack([3, None], [len(ids), 0], ids, 49_408)
        assert (repair.decode(block) == ids).all() and len(repair.decode(block)) == len(ids)
        for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 5)):
            assert repair.decode(block, max(0, a), b).tolist() == ids[max(0, a):b].tolist()
    assert len(block) < len(ids)  # repeats shrink


def test_repeats_shrink_to_rules():
    """A passage however often repeated, with all its pairs equally frequent, costs little more than its rules."""
    rng = np.random.default_rng(4)
    for size, times in ((1_000, 50), (997, 50), (50, 1_000)):
        ids = np.tile(rng.integers(0, 49_408, size), times).astype(np.uint16)
        block = repair.pack([1], [len(ids)], ids, 49_408)
        assert len(block) <= 0.3 * len(ids) and (repair.decode(block) == ids).all()


def test_no_pair_is_left_frequent():
    rng = np.random.default_rng(7)
    ids = rng.choice(300, 60_000, p=np.arange(300, 0, -1) / 45_150).astype(np.uint16)
    rules, per_round, seq = repair.compress(ids, 49_408, least=8)
    assert max(Counter(zip(seq.tolist(), seq[1:].tolist())).values()) < 8 or len(rules) + 49_408 == 1 << 16
    assert sum(per_round) == len(rules)


def test_slices_expand_what_covers_them():
    ids = np.tile(np.random.default_rng(2).integers(0, 49_408, 4_096), 64).astype(np.uint16)
    x = repair.unpack(repair.pack([1], [len(ids)], ids, 49_408))
    got, expanded = repair._covering(x, x["symbols"].astype(np.int64), 100_000, 100_010)
    assert (got == ids[100_000:100_010]).all() and expanded < 200


def test_shards(spark, documents, texts):
    path = new_path(spark, "shards")
    grammar_store.write_shards(documents, path, WORDS, 49_408, 1, block_ids=5_000)
    got = {r.doc_id: r for r in grammar_store.read_documents(spark, path).collect()}
    whole, start, every = Tokenizer.from_file(WORDS), 0, []
    for doc in sorted(texts):
        ids = whole.encode(texts[doc], add_special_tokens=False).ids + [1]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
        every += ids
    assert grammar_store.read_slice(spark, path, 4_000, 13_000) == every[4_000:13_000]


def test_shards_odd(odd_docs, odd_rows, no_docs):
    got = grammar_store.encode_corpus(odd_docs, WORDS, 49_408, 1).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    assert [r.doc_id is None for r in ordered] == [True] * 3 + [False] * (len(got) - 3)
    assert grammar_store.encode_corpus(no_docs, WORDS, 49_408, 1).collect() == []


def test_best_fit():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= -(-sum(sizes) // 100) * 1.02
    assert packing.best_fit([], 5) == []


def check_packed(rows, texts, capacity):
    """``texts``: list of (id, text)."""
    whole = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        want.update((doc, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(documents, texts):
    rows = packing.pack_documents(documents.repartition(6), BYTES, 2, fan_in=2).collect()
    bins, least = check_packed(rows, list(texts.items()), 1024)
    assert bins <= least * 1.02 + 1


def test_packing_in_bounded_groups(documents, texts):
    rows = packing.pack_documents(documents, BYTES, 2, capacity=64, rows_per_group=10).collect()
    check_packed(rows, list(texts.items()), 64)


def test_packing_odd(odd_docs, odd_rows, no_docs):
    check_packed(packing.pack_documents(odd_docs, BYTES, 2).collect(), odd_rows, 1024)
    assert packing.pack_documents(no_docs, BYTES, 2).collect() == []
