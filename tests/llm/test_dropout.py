"""Dropout varies by occurrence and document, with the distribution of independent skips."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scorewright.llm.merge_dropout import DropoutCoder
from scorewright.llm.shingles import mix

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def split_ids(coder, word, key, many):
    """The segmentations of a word at the places of one text."""
    ids = np.frombuffer(coder.encode(" ".join([word] * many), key), "<u2").tolist()
    out, part = [], []
    for i in ids:
        if part and coder.back[i].startswith(b" "):
            out.append(tuple(part))
            part = []
        part.append(i)
    return out + [tuple(part)]


def test_occurrences_and_documents_differ():
    coder = DropoutCoder(PIECES, 0.3)
    in_one = split_ids(coder, "international", 5, 200)
    assert len(in_one) == 200 and len(set(in_one)) > 8
    assert len({coder.encode("international", d) for d in range(200)}) > 8
    assert coder.encode("a few international words " * 9, 3) == DropoutCoder(PIECES, 0.3).encode("a few international words " * 9, 3)


def test_skips_are_independent():
    coder, rng = DropoutCoder(PIECES, 0.2), random.Random(1)
    many = 20_000
    got = Counter(split_ids(coder, "window", 9, many))

    def plain():
        parts, gone = list("▁window"), set()
        agenda = [coder.rank.get(a + b, coder.none) for a, b in zip(parts, parts[1:])]
        while agenda and min(agenda) < coder.none:
            i = agenda.index(min(agenda))
            if rng.random() < 0.2:
                agenda[i] = coder.none
                continue
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = coder.rank.get(parts[i] + parts[i + 1], coder.none)
            if i:
                agenda[i - 1] = coder.rank.get(parts[i - 1] + parts[i], coder.none)
        return tuple(coder.ids[p] for p in parts)

    want = Counter(plain() for _ in range(many))
    assert all(abs(got[k] - want[k]) < 6 * (want[k] + got[k] + 1) ** 0.5 for k in want | got)


def plain_word(coder, word, key):
    """One word by a list of candidates, skipped by the keyed hash of their turn."""
    parts, turn = list(word), 0
    agenda = [coder.rank.get(a + b, coder.none) for a, b in zip(parts, parts[1:])]
    while agenda and min(agenda) < coder.none:
        i = agenda.index(min(agenda))
        turn += 1
        if int(mix(np.array([(key + turn * 0xC2B2AE3D27D4EB4F) % (1 << 64)], np.uint64))[0]) >> 32 < coder.bar:
            agenda[i] = coder.none
            continue
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del agenda[i]
        if i < len(agenda):
            agenda[i] = coder.rank.get(parts[i] + parts[i + 1], coder.none)
        if i:
            agenda[i - 1] = coder.rank.get(parts[i - 1] + parts[i], coder.none)
    return [coder.ids[p] for p in parts]


@pytest.mark.parametrize("size", [3, 11, 40, 130, 400])
def test_words_of_all_lengths_like_a_plain_agenda(size):
    coder, rng = DropoutCoder(PIECES, 0.25), random.Random(size)
    for document in range(6):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, size))) for _ in range(12)]
        base = int(mix(np.array([document + coder.seed * 1_000_003], np.uint64))[0])
        want = []
        for place, word in enumerate(words):
            key = int(mix(np.array([(base + place * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            want += plain_word(coder, "▁" + word, key)
        assert np.frombuffer(coder.encode(" ".join(words), document), "<u2").tolist() == want


def test_batches_do_not_matter():
    coder, rng = DropoutCoder(PIECES, 0.2), random.Random(3)
    texts = ["".join(rng.choices("ab é五▁ ", k=rng.randint(0, 40))) for _ in range(200)]
    keys = np.arange(200) * 7 - 50
    assert coder.encode_batch(texts, keys) == [coder.encode(t, int(k)) for t, k in zip(texts, keys)]
