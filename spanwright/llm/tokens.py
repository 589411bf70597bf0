"""Token ids of whole texts by a public word-BPE tokenizer file, with a bounded cache of words in each worker."""

from __future__ import annotations

import re
from array import array

#: Texts with other characters take the tokenizer's own path: for these, lower-casing, normal form and white space agree with Python's.
_ODD = re.compile("[^\t-\r -~\xa1-įı-ɏ]")
_PLAIN_ASCII = bytes([*range(9, 14), *range(32, 127)])
#: Words and word pieces that a worker remembers: two generations of so many.
CACHE = 250_000

_loaded: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return dict(zip(prints, prints)) | {b: 256 + k for k, b in enumerate(others)}


class _Cache(dict):
    """When full, it becomes the older generation, from which what is asked for again comes back."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordTokenizer:
    """encode(text) gives the ids as little-endian 32-bit numbers, those of Tokenizer.encode without special tokens.

    The file's tokenizer splits at white space first, so a text's ids are those of its
    words one after the other; words are looked up, new ones go through the model.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.shown = _byte_letters()
        self.words = _Cache(self._word)

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.shown)
        return _little([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        head, mark = word[:-1], word[-1]
        if head.isalpha() and mark in ".,;:|!?":
            return self.words[head] + self.words[mark]
        parts = self.split(word)
        return self._piece(word) if parts == [word] else b"".join([self.words[p] for p in parts])

    def _simple(self, text: str) -> bool:
        odd = text.encode("ascii").translate(None, _PLAIN_ASCII) if text.isascii() else _ODD.search(text)
        return not odd and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self._simple(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return _little(self.whole.encode(text, add_special_tokens=False).ids)


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _SAME else b"".join(i.to_bytes(4, "little") for i in ids)


_SAME = array("I", [1]).tobytes() == (1).to_bytes(4, "little")


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
