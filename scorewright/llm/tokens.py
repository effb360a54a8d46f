"""Ids of whole texts by the ``tokenizers`` library, encoding each distinct word of a task only once.

Both vocabularies used here split a text before merging, and never merge across a split. A text of Latin letters is
split by the vocabulary's own pattern, stated for Python, and each distinct part is looked up or merged by the
library's model. Any other text is cut at white space where a split is certain, each distinct part is encoded by the
library, and the ids are put together. The result equals encoding the whole text (tested against it, also on odd
white space and scripts).
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r"(?<=\S)(?= \S)")
_CONTROLS = re.compile("[\x1c-\x1f]")  # white space to str.split alone
_BLANKS = re.compile(r"[\t-\r ]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


_LETTERS = _byte_letters()
_OTHER = re.compile("[\x1c-\x1f\x85\u0130\u0250-\U0010ffff]|<\\|")  # not split by the patterns below
#: The split patterns of the two vocabularies (fixed values), for characters up to U+024F.
_ENDS, _ALPHA, _DIGIT, _MARKS = "'s|'t|'re|'ve|'m|'ll|'d", r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+", r"[\d\xb2\xb3\xb9\xbc-\xbe]", r"(?:[^\s\w]|_)+"
_PLAIN = re.compile(f"{_ALPHA}|{_ENDS}|{_DIGIT}|{_MARKS}")  # letters first: no ending begins with one
_SPACED = re.compile(rf" ?{_ALPHA}|{_ENDS}| ?{_DIGIT}+| ?{_MARKS}|\s+(?!\S)|\s+")
_encoders: dict[tuple, "WordEncoder"] = {}


class _Parts(dict):
    """Ids by part of a split, merged by the model when first met; a full table is emptied."""

    def __init__(self, tokenizer, kind: str, limit: int):
        self.model, self.kind, self.limit = tokenizer.model, kind, limit

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if part.isascii() and part.isprintable():
            word = part.replace(" ", "Ġ")  # a space's letter
        else:
            word = "".join(map(_LETTERS.__getitem__, part.encode()))
        ids = self[part] = array(self.kind, [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids


class _Words(dict):
    """Ids by word, where white space is dropped: its parts, put together when first met; a full table is emptied."""

    def __init__(self, known: _Parts, limit: int):
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.known.__getitem__, _PLAIN.findall(word)))
        if len(word) < 40:  # longer ones are rarely met again
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts to the bytes of little-endian ids.

    ``spaced``: a space belongs to the word after it (byte-level vocabularies); otherwise white space is dropped and
    case is ignored. ``limit`` bounds the cached words; a full cache is emptied.
    """

    def __init__(self, path: str, spaced: bool, width: int = 4, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.limit = spaced, limit
        self.kind = {2: "H", 4: "I"}[width]
        self.parts: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what stands before a word
        self.cores: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.known = _Parts(self.tokenizer, self.kind, limit)
        self.words = _Words(self.known, limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        other = [i for i, t in enumerate(texts) if _OTHER.search(t)]
        if not other:
            return list(map(self._split, texts))
        rest = dict(zip(other, self._encode_words([texts[i] for i in other])))
        return [rest[i] if i in rest else self._split(t) for i, t in enumerate(texts)]

    def _split(self, text: str) -> bytes:
        if self.spaced:
            return b"".join(map(self.known.__getitem__, _SPACED.findall(text)))
        return b"".join(map(self.words.__getitem__, text.lower().split()))  # no part goes past a word's end

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            words = [t.split() if not _CONTROLS.search(t) else [w for w in _BLANKS.split(t) if w] for t in texts]
            ids = self._ids(set().union(*words), "")
            return [b"".join(map(ids.__getitem__, w)) for w in words]
        words = [t.split(" ") for t in texts]
        known = set().union(*words)
        odd = {w for w in known if not w or w[0].isspace() or w[-1].isspace()}
        rare = {i: _CUT.split(texts[i]) for i, w in enumerate(words) if odd and not odd.isdisjoint(w)}
        first = self._ids({w[0] for i, w in enumerate(words) if i not in rare}.union(*rare.values()), "")
        rest = self._ids(known - odd, " ")
        return [b"".join(map(first.__getitem__, rare[i])) if i in rare
                else first[w[0]] + b"".join(map(rest.__getitem__, w[1:])) for i, w in enumerate(words)]

    def _ids(self, words: set[str], before: str) -> dict[str, bytes]:
        """Ids of each word after ``before``; a tail of punctuation is looked up apart from the word it follows."""
        parts, cores, tails = self.parts[before], self.cores[before], self.cores[""]
        out = {w: cores[w] for w in words if w in cores}
        out.update((w, parts[w]) for w in words if w in parts)
        split: dict[str, tuple[str, str]] = {}
        fresh: dict[str, bytes] = {}
        ends: dict[str, bytes] = {}
        for w in words - out.keys():
            core = w.rstrip(string.punctuation)
            tail = w[len(core):]
            if not tail or not core or not core[-1].isalpha() or core[-1] == "İ" or "<|" in w:  # special tokens stay whole, and a mark with its tail
                core, tail = w, ""
            if not self.spaced and core and max(core) < "İ":  # one letter becomes one letter there
                core = core.lower()
            split[w] = core, tail
            if core not in cores:
                fresh[core] = b""
            if tail and tail not in tails:
                ends[tail] = b""
        self._encode_all(fresh, before)
        self._encode_all(ends, "")
        for w, (core, tail) in split.items():
            ids = fresh[core] if core in fresh else cores[core]
            out[w] = ids + (ends[tail] if tail in ends else tails[tail]) if tail else ids
        self._keep(cores, fresh)
        self._keep(tails, ends)
        self._keep(parts, {w: out[w] for w, (core, _) in split.items() if core != w})
        return out

    def _keep(self, cache: dict[str, bytes], new: dict[str, bytes]) -> None:
        if len(cache) + len(new) > self.limit:
            cache.clear()
        cache.update(new)

    def _encode_all(self, names: dict[str, bytes], before: str) -> None:
        """Fill in the ids of each name after ``before``."""
        whole = []
        merge, kind = self.tokenizer.model.tokenize, self.kind
        space = _LETTERS[32] if before else ""
        for name in names:
            if name.isalpha() and (name.isascii() or max(name) < "İ") and (
                    self.spaced or name.islower() and unicodedata.is_normalized("NFC", name)):
                # one run of letters is one part of the split, so the model alone is asked
                word = space + (name if name.isascii() else "".join(map(_LETTERS.__getitem__, name.encode())))
                names[name] = array(kind, [t.id for t in merge(word)]).tobytes()
            else:
                whole.append(name)
        for name, e in zip(whole, self.tokenizer.encode_batch_fast([before + n for n in whole], add_special_tokens=False)):
            names[name] = array(kind, e.ids).tobytes()


def encoder(path: str, spaced: bool, width: int = 4) -> WordEncoder:
    """The encoder of this worker for a file; its cached words serve all tasks of the worker."""
    key = path, spaced, width
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, spaced, width)
    return _encoders[key]
