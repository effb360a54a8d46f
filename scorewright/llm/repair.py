"""Re-Pair in numpy: frequent id pairs become nonterminals, round by round, within one shard of ids.

A shard is ``uint16`` throughout: ids below ``base`` are tokens, ``base + r`` is rule r. Each round counts all
neighbouring pairs and ranks those seen at least ``least`` times, the more frequent first and equally frequent ones by
a hash of the pair, so that all occurrences of a repeated passage are cut alike. A pair is replaced where it ranks above
both neighbouring pairs, then where it does so among what is left; of a run of one pair every other one counts. Rounds
go on until no pair is frequent (or all 65,536 symbols are taken); the best pair of a round is always replaced, so they
end. Decoding is exact. Rules of one round only use symbols of earlier rounds.

Each rule is stored with the length of its expansion, so a range of ids is decoded from the top down: symbols that lie
outside the range are skipped by their lengths, and only those that cover it are expanded.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG2"
LEAST = 8
_HEAD = struct.Struct("<4sIIIIQBI")  # magic, base, documents, rules, symbols, ids, rounds, long expansions
_SLOTS = 20  # bits of the pair table


def _pair_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)


def _ranked(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """The pairs seen ``least`` times and more, best first, at most ``most``."""
    ordered = np.sort(keys)
    edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    count = np.diff(edge, append=len(ordered))
    chosen = np.flatnonzero(count >= least)
    value = ordered[edge[chosen]]
    return value[np.lexsort((_pair_hash(value), -count[chosen]))[:most]]


def _places(keys: np.ndarray, value: np.ndarray, table: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a ranked pair stands, and its rank there. Of two pairs in one slot of the table the better stays; slots
    differ by turn."""
    factor = np.uint32(2654435761 | turn << 1)
    table[:] = 0
    table[(value[::-1] * factor) >> np.uint32(32 - _SLOTS)] = np.arange(len(value), 0, -1)
    rank = table[(keys * factor) >> np.uint32(32 - _SLOTS)] - 1
    hit = np.flatnonzero(rank >= 0)
    return hit[value[rank[hit]] == keys[hit]], rank


def _chosen(keys: np.ndarray, hit: np.ndarray, rank: np.ndarray, pairs: int) -> np.ndarray:
    """Places to replace, no two of them neighbours."""
    weight = np.zeros(len(keys) + 2, np.int32)  # of place i at i + 1
    weight[hit + 1] = pairs - rank[hit]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    if len(same):  # a run of one pair: every other one
        fresh = np.concatenate(([True], np.diff(same) != 1))
        begin = same[np.maximum.accumulate(np.where(fresh, np.arange(len(same)), 0))]
        weight[same[(same - begin) % 2 == 0] + 2] = 0
        hit = hit[weight[hit + 1] > 0]
    spots = []
    for _ in range(2):
        mid = weight[hit + 1]
        spot = hit[(mid > weight[hit]) & (mid > weight[hit + 2])]
        spots.append(spot)
        weight[spot] = weight[spot + 1] = weight[spot + 2] = 0
        hit = hit[weight[hit + 1] > 0]
    return np.concatenate(spots)


def compress(ids: np.ndarray, base: int, least: int = LEAST):
    """Rules (n, 2), rules made by each round, and the remaining symbols."""
    seq = ids.astype(np.uint16)
    made: list[np.ndarray] = []  # the pairs of each round
    first = base
    table = np.zeros(1 << _SLOTS, np.int32)
    while len(seq) > least and first < 1 << 16:
        keys = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        value = _ranked(keys, least, (1 << 16) - first)
        if not len(value):
            break
        hit, rank = _places(keys, value, table, len(made))
        spot = _chosen(keys, hit, rank, len(value))
        used = np.bincount(rank[spot], minlength=len(value))
        keep = used >= max(2, least // 2)
        spot = spot[keep[rank[spot]]]
        if not len(spot):
            break
        seq[spot] = (np.cumsum(keep) - 1 + first)[rank[spot]]
        live = np.ones(len(seq), bool)
        live[spot + 1] = False
        seq = seq[live]
        made.append(value[keep])
        first += len(made[-1])
    pairs = np.concatenate(made) if made else np.zeros(0, np.uint32)
    return np.stack((pairs >> 16, pairs & 0xFFFF), axis=1).astype(np.uint16), [len(m) for m in made], seq


def _levels(per_round) -> list[slice]:
    ends = np.cumsum(per_round, dtype=np.int64).tolist()
    return [slice(b, e) for b, e in zip([0, *ends], ends)]


def expansion_lengths(rules: np.ndarray, per_round, base: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    size = np.ones(base + len(rules), np.uint32)
    for level in _levels(per_round):
        size[base + level.start:base + level.stop] = size[rules[level, 0]] + size[rules[level, 1]]
    return size


def _copy(flat, begin, size, symbols):
    n = size[symbols]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(begin[symbols], n) + step], step, n


def _expansions(rules, per_round, base: int, rule_sizes):
    """All expansions in one array, where each symbol's begins, and its length."""
    size = np.concatenate((np.ones(base, np.int64), rule_sizes.astype(np.int64)))
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint16)
    flat[:base] = np.arange(base)
    for level in _levels(per_round):
        place = begin[base + level.start:base + level.stop]
        for side, shift in ((0, 0), (1, size[rules[level, 0]])):
            ids, step, n = _copy(flat, begin, size, rules[level, side].astype(np.int64))
            flat[np.repeat(place + shift, n) + step] = ids
    return flat, begin, size


def pack(doc_ids: list, doc_lengths: list[int], ids: np.ndarray, base: int, **how) -> bytes:
    """One shard: head, document ids (with a null mask), document lengths, rules, expansion lengths, symbols.

    Lengths take a byte, 255 for those that follow as four.
    """
    rules, per_round, seq = compress(ids, base, **how)
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sizes = expansion_lengths(rules, per_round, base)[base:]
    long = sizes[sizes >= 255]
    return b"".join((
        _HEAD.pack(MAGIC, base, len(doc_ids), len(rules), len(seq), len(ids), len(per_round), len(long)),
        numbers.tobytes(), null.tobytes(), np.array(doc_lengths, "<u4").tobytes(),
        np.array(per_round, "<u4").tobytes(), rules.astype("<u2").tobytes(),
        np.minimum(sizes, 255).astype("<u1").tobytes(), long.astype("<u4").tobytes(), seq.astype("<u2").tobytes()))


def unpack(block: bytes) -> dict:
    magic, base, n_docs, n_rules, n_symbols, n_ids, n_rounds, n_long = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a shard of this format")
    out, at = {"base": base, "n_ids": n_ids}, _HEAD.size
    for name, kind, n in (("doc_ids", "<i8", n_docs), ("null", "<u1", n_docs), ("doc_lengths", "<u4", n_docs),
                          ("per_round", "<u4", n_rounds), ("rules", "<u2", 2 * n_rules), ("sizes", "<u1", n_rules),
                          ("long", "<u4", n_long), ("symbols", "<u2", n_symbols)):
        out[name] = np.frombuffer(block, kind, n, at)
        at += out[name].nbytes
    out["rules"] = out["rules"].reshape(-1, 2)
    out["sizes"] = out["sizes"].astype(np.int64)
    out["sizes"][out["sizes"] == 255] = out["long"]
    return out


def decode(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; of a part only the symbols that cover it are expanded."""
    x = unpack(block)
    stop = x["n_ids"] if stop is None else min(stop, x["n_ids"])
    if stop <= start:
        return np.zeros(0, np.uint16)
    symbols = x["symbols"].astype(np.int64)
    if start <= 0 and stop == x["n_ids"]:
        flat, begin, size = _expansions(x["rules"], x["per_round"], x["base"], x["sizes"])
        return _copy(flat, begin, size, symbols)[0]
    return _covering(x, symbols, start, stop)[0]


def _covering(x: dict, symbols: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, int]:
    """The ids of the range, and how many symbols were looked into below the top."""
    base, size = x["base"], np.concatenate((np.ones(x["base"], np.int64), x["sizes"]))
    expanded = 0
    while True:
        ends = np.cumsum(size[symbols])
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = int(ends[first] - size[symbols[first]])
        symbols, start, stop = symbols[first:last], start - skip, stop - skip
        inner = symbols >= base
        if not inner.any():
            return symbols[start:stop].astype(np.uint16), expanded
        expanded += int(inner.sum())
        place = np.arange(len(symbols)) + np.cumsum(inner) - inner
        out = np.empty(len(symbols) + int(inner.sum()), np.int64)
        out[place] = symbols
        pairs = x["rules"][symbols[inner] - base]
        out[place[inner]], out[place[inner] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
