"""SentencePiece encoding with seeded merge dropout, and decoding.

The pieces and merge order come from a SentencePiece BPE model. A text is split before every space that follows
another character (no piece of such a model goes on past one). Within a word an agenda holds the candidate merges,
best piece first, then leftmost; each candidate is skipped with probability ``dropout``, decided by a keyed hash of
seed, document id, the word's place in the text and the candidate's turn, so that documents and occurrences differ and
any run gives the same ids. Without dropout the ids equal the library's.

All words of a batch are worked on at once: a matrix per class of word lengths holds their parts and candidates, and a
turn of the agenda is one pass of array operations over the words that still have candidates. Words beyond ``WIDE``
characters have an agenda (a heap) of their own, by the same rule and with the same ids. Characters without a piece
become their bytes, and so does the model's space mark where a text holds it literally, so decoding always returns the
text.

Defined cases: a null text is empty; an empty text has no pieces. Null and repeated ids are rows of their own, a null
id has key 0 (``variant``). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import slices, whole_text
from scorewright.llm.shingles import mix

DROPOUT = 0.1
WIDE = 128
CLASSES = (8, 12, 16, 24, 48, WIDE)
CHARS = 250_000  # of a batch, or one longer text
MARK = "▁"  # stands for a space
_LITERAL = 0x110000  # code of a mark that was in the text
_PLACE, _TURN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1
_coders: dict[tuple, "DropoutCoder"] = {}


class PairTable:
    """Pairs of symbols to the piece they merge to, -1 if none; looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        self.levels = []
        while len(keys):  # what finds its slot taken goes to a further, smaller table
            bits = max(4, int(8 * len(keys)).bit_length())
            shift, odd = np.uint64(64 - bits), np.uint64(_PLACE + 2 * len(self.levels))
            slot = keys.view(np.uint64) * odd >> shift
            held, to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            held[slot], to[slot] = keys, values
            self.levels.append((odd, shift, held, to))
            left = held[slot] != keys
            keys, values = keys[left], values[left]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 21 | b
        out, rest = np.full(len(key), -1, np.int32), None
        for odd, shift, held, to in self.levels:
            slot = key.view(np.uint64) * odd >> shift
            found = held[slot]
            hit = found == key
            value = np.where(hit, to[slot], -1)
            if rest is None:
                out = value
            else:
                out[rest] = value
            deeper = np.flatnonzero(~hit & (found >= 0))  # an empty slot ends the search
            if not len(deeper):
                break
            rest = deeper if rest is None else rest[deeper]
            key = key[deeper]
        return out


class DropoutCoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 1, wide: int = WIDE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {pieces[i]: i for i in plain}
        order = sorted({-model.get_score(i) for i in plain})
        place = {score: r for r, score in enumerate(order)}
        self.rank = {pieces[i]: place[-model.get_score(i)] for i in plain}
        self.none = len(order)
        self.bytes = {bytes([int(pieces[i][3:5], 16)]): i for i in range(len(pieces)) if model.is_byte(i)}
        table = {i: pieces[i].replace(MARK, " ").encode() for i in plain} | {i: b for b, i in self.bytes.items()}
        self.back = [table.get(i, b"") for i in range(len(pieces))]
        self.bar, self.seed, self.wide = round(dropout * 2.0 ** 32), seed, wide
        self.many = len(pieces)
        self.of_char = np.arange(0x110001, dtype=np.int32) + self.many  # a symbol of its own where no piece is
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.rank_of = np.full(self.many + 1, self.none, np.int32)  # the last is for -1
        for piece, i in self.ids.items():
            self.rank_of[i] = self.rank[piece]
        self.pairs = PairTable({(self._symbol(p[:k]), self._symbol(p[k:])): i for p, i in self.ids.items()
                                for k in range(1, len(p)) if self._part(p[:k]) and self._part(p[k:])})
        self.byte_ids = np.array([self.bytes[bytes([b])] for b in range(256)], np.uint16)

    def _part(self, text: str) -> bool:
        return len(text) == 1 or text in self.ids

    def _symbol(self, text: str) -> int:
        return int(self.of_char[ord(text)]) if len(text) == 1 else self.ids[text]

    def _skips(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return mix(keys + np.uint64((turn + 1) * _TURN & _ALL)) >> np.uint64(32) < self.bar

    def _merge(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Symbols of words, a row each, -1 beyond their ends: after all merges, in place, -1 where a part is gone."""
        n, width = symbols.shape
        size = (symbols >= 0).sum(axis=1)
        out = symbols.copy()
        inside = np.arange(1, width)[None, :] < size[:, None]
        merged = np.full((n, width), -1, np.int32)
        row, at = np.nonzero(inside)
        merged[row, at] = self.pairs(symbols[row, at], symbols[row, at + 1])
        ranks = self.rank_of[merged]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        rows, turn = np.arange(n), 0  # rows of the input that the matrices still hold
        parts = symbols.copy()
        while len(rows):
            best = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            live = ranks[every, best] < self.none
            if live.mean() < 0.7:  # go on with those alone
                out[rows[~live]] = parts[~live]
                rows, best, keys, size = rows[live], best[live], keys[live], size[live]
                parts, merged, ranks, after, before = (m[live] for m in (parts, merged, ranks, after, before))
                every = np.arange(len(rows))
                if not len(rows):
                    break
            else:
                every, best = every[live], best[live]
            if self.bar:
                skip = self._skips(keys[every], turn)
                ranks[every[skip], best[skip]] = self.none
                every, best = every[~skip], best[~skip]
            turn += 1
            right = after[every, best]
            piece = merged[every, best]
            parts[every, best] = piece
            parts[every, right] = -1
            ranks[every, right] = self.none
            far = after[every, right]
            after[every, best] = far
            ranks[every, best] = self.none
            inner = far < size[every]
            r, b, f = every[inner], best[inner], far[inner]
            before[r, f] = b
            found = self.pairs(piece[inner], parts[r, f])
            merged[r, b], ranks[r, b] = found, self.rank_of[found]
            left = before[every, best]
            inner = left >= 0
            r, b = every[inner], left[inner]
            found = self.pairs(parts[r, b], piece[inner])
            merged[r, b], ranks[r, b] = found, self.rank_of[found]
        return out

    def _merge_long(self, symbols: list[int], key: int) -> list[int]:
        """The same for one word, with a heap."""
        n, rank = len(symbols), self.rank_of
        parts, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        version = [0] * n  # of the candidate at a place; older ones are stale
        agenda: list[tuple[int, int, int, int]] = []

        def offer(places: list[int]):
            found = self.pairs(np.array([parts[i] for i in places]), np.array([parts[after[i]] for i in places])) if places else []
            for i, piece in zip(places, found):
                version[i] += 1
                if piece >= 0:
                    heapq.heappush(agenda, (int(rank[piece]), i, version[i], int(piece)))

        offer(list(range(n - 1)))
        turn = 0
        while agenda:
            _, i, made, piece = heapq.heappop(agenda)
            if parts[i] < 0 or version[i] != made:
                continue
            turn += 1
            if self.bar and self._skips(np.array([key], np.uint64), turn - 1)[0]:
                version[i] += 1
                continue
            j = after[i]
            parts[i], parts[j] = piece, -1
            version[i], version[j] = version[i] + 1, version[j] + 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            offer([p for p in (i, before[i]) if p >= 0 and after[p] < n])
        return parts

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, each after one mark; where words begin, the word's text, and its place there."""
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        starts = np.cumsum(sizes) - sizes
        space = codes == 32
        symbols = self.of_char[np.where(codes == ord(MARK), _LITERAL, np.where(space, ord(MARK), codes))]
        first = np.zeros(len(codes), bool)
        first[starts[sizes > 0]] = True
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begin = np.flatnonzero(begins | first)
        text = np.searchsorted(starts + sizes, begin, "right")
        place = np.arange(len(begin)) - np.searchsorted(begin, starts)[text]
        return symbols, begin, text, place

    def encode_batch(self, texts: list[str], variants: np.ndarray) -> list[bytes]:
        """Ids of each text as 16-bit little-endian; ``variants`` are the documents' keys."""
        symbols, begin, text, place = self._words(texts)
        size = np.diff(begin, append=len(symbols))
        base = mix(np.asarray(variants, np.int64).view(np.uint64) + np.uint64(self.seed * 1_000_003 & _ALL))
        keys = mix(base[text] + place.astype(np.uint64) * np.uint64(_PLACE)) if len(begin) else np.zeros(0, np.uint64)
        out = np.full(len(symbols), -1, np.int32)
        low = 0
        for width in (*[w for w in CLASSES if w < self.wide], self.wide):
            chosen = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(chosen):
                column = np.arange(width)
                inside = column[None, :] < size[chosen][:, None]
                at = np.minimum(begin[chosen][:, None] + column, len(symbols) - 1)
                done = self._merge(np.where(inside, symbols[at], -1).astype(np.int32), keys[chosen])
                out[at[inside]] = done[inside]
        for w in np.flatnonzero(size > self.wide):
            part = slice(begin[w], begin[w] + size[w])
            out[part] = self._merge_long(symbols[part].tolist(), int(keys[w]))
        alive = out >= 0
        ends = np.cumsum(np.array([len(t) + 1 if t else 0 for t in texts]))
        flat = out[alive]
        cuts = np.concatenate(([0], np.cumsum(alive)))[ends] if len(out) else np.zeros(len(texts), np.int64)
        odd = np.flatnonzero(flat >= self.many)
        if len(odd):
            flat, cuts = self._spelled(flat, odd, cuts)
        ids, cuts = flat.astype("<u2").tobytes(), [0, *(2 * cuts).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _spelled(self, flat: np.ndarray, odd: np.ndarray, cuts: np.ndarray):
        """Symbols without a piece replaced by the ids of their bytes."""
        codes = flat[odd] - self.many
        data = [(MARK if c == _LITERAL else chr(c)).encode() for c in codes.tolist()]
        many = np.ones(len(flat), np.int64)
        many[odd] = [len(d) for d in data]
        ends = np.cumsum(many)
        out = np.repeat(flat, many)
        joined = np.frombuffer(b"".join(data), np.uint8)
        spot = np.zeros(len(out), bool)
        spot[np.repeat(ends[odd] - many[odd], many[odd]) + np.arange(len(joined)) - np.repeat(np.cumsum(many[odd]) - many[odd], many[odd])] = True
        out[spot] = self.byte_ids[joined]
        return out, np.concatenate(([0], ends))[cuts]

    def encode(self, text: str, variant: int) -> bytes:
        """Ids of one text."""
        return self.encode_batch([text], np.array([variant], np.int64))[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.back.__getitem__, array("H", ids)))[1:].decode()


def coder(path: str, dropout: float, seed: int) -> DropoutCoder:
    """This worker's coder; the words it knows serve all its tasks."""
    key = path, dropout, seed
    if key not in _coders:
        _coders[key] = DropoutCoder(path, dropout, seed)
    return _coders[key]


def encode_pieces(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """Per document: doc_id, variant, sha256 of the text, ids (16-bit little-endian)."""
    variant = F.when(F.col("doc_id").isNull(), 0).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), variant.cast("long").alias("variant"),
                       F.sha2(whole_text(), 256).alias("sha256"), whole_text().alias("text"))

    def encode(batches):
        encode_texts = coder(path, dropout, seed).encode_batch
        for batch in slices(batches, "text", CHARS):
            ids = encode_texts(batch.column("text").to_pylist(), batch.column("variant").to_numpy())
            yield batch.select(["doc_id", "variant", "sha256"]).append_column("ids", pa.array(ids, pa.binary()))

    return rows.mapInArrow(encode, "doc_id long, variant long, sha256 string, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text, decoded from the ids, and ids_crc32 (of the ids as 32-bit little-endian)."""

    def decode(batches):
        decode_ids = coder(path, 0.0, 0).decode
        for batch in slices(batches, "ids"):
            ids = batch.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(i, "<u2").astype("<u4").tobytes()) for i in ids]
            yield (batch.append_column("text", pa.array([decode_ids(i) for i in ids], pa.string()))
                   .append_column("ids_crc32", pa.array(crc, pa.int64())))

    return encoded.mapInArrow(decode, "doc_id long, variant long, sha256 string, ids binary, text string, ids_crc32 long")


def round_trips(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """Per document: doc_id, variant, n_chars (decoded), n_pieces, ids_crc32, lossless (decoded equals the original by hash)."""
    decoded = decode_pieces(encode_pieces(docs, path, dropout, seed), path)
    return decoded.select("doc_id", "variant", F.length("text").cast("long").alias("n_chars"),
                          (F.octet_length("ids") / 2).cast("long").alias("n_pieces"), "ids_crc32",
                          (F.sha2("text", 256) == F.col("sha256")).alias("lossless"))
