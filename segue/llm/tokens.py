"""Token ids by the ``tokenizers`` library, with bounded caches of text segments.

A byte-level BPE of this kind never joins a token across the change from a visible character to white space, so a text is
cut there and each distinct segment is encoded once. New segments of plain characters are split by the vocabulary's own
pattern and go to the library's BPE model directly, which spares the bookkeeping of offsets; all others, and texts with
control characters that Python and the library class differently, go through the library's whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

from .common import per_process

END_ID = 2
CACHED = 300_000
"""Segments in one generation of a worker's cache; two generations are kept (some 130 MB)."""
CACHED_CHARS = 48
# Letters and numbers up to U+024F, and the word pattern of the vocabulary.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_SIMPLE = re.compile(rf"( ?[{_L}]+)([^\s{_L}{_N}]*)")
_PLAIN = re.compile("[ \n]?[!-~¡-ɏ]+")
_SEGMENT = re.compile(r"\s*\S+|\s+")
_UNSAFE = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte in a byte-level vocabulary: itself, or the next free code from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Computes what is missing; keeps the entries of two generations at most."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest, self.old = make, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``ids(texts)`` gives one little-endian uint32 byte string for each text, with the end id last."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.end = end_id.to_bytes(4, "little")
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.words, self.segments = _Cache(self._word, CACHED_CHARS), _Cache(self._segment, CACHED_CHARS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and "\n" not in word:
            shown = self.space + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.tokenize(shown)])

    def _segment(self, segment: str) -> bytes:
        simple = _SIMPLE.fullmatch(segment)
        if simple and len(segment) <= 256:
            word, mark = simple.groups()
            return self.segments[word] + self.words[mark] if mark else self._word(word)
        if len(segment) <= 256 and _PLAIN.fullmatch(segment):
            return b"".join([self.words[w] for w in _WORDS.findall(segment)])
        return self._whole(segment)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        segment = self.segments.__getitem__
        return [self._whole(t) + self.end if _UNSAFE.search(t) else b"".join(map(segment, _SEGMENT.findall(t))) + self.end
                for t in (t or "" for t in texts)]


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return per_process("encoder", (path, end_id), lambda: Encoder(path, end_id))


def portions(texts: list, chars: int = 1 << 20):
    """Slices of a list of texts of about ``chars`` characters each, at least one text."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]
