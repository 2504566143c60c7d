"""Token ids of whole texts under a word-level BPE file, fast enough for a full corpus.

The tokenizer normalises, splits and merges within stretches that hold no blank, so a text's ids are the
ids of its blank-separated chunks in order. Chunks recur, so each worker keeps a bounded memo. A chunk of
plain Latin letters, digits and marks is merged through ``tiktoken`` with the same vocabulary as ranks; any
other chunk goes to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

MEMO_ENTRIES = 200_000
_END = b"\xff"  # stands for the end-of-word mark: no UTF-8 text holds this byte
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]*")
_PLAIN_TEXT = re.compile(r"[ \n!-~¡-¬®-ÿ]*")
# by code point: 0 blank, 1 letter, 2 number, 3 other
_KIND = np.array([0 if c in b" \n" else 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3 for c in range(256)], np.uint8)
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\w\s]|_)+")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Computes what is missing; starts anew when full, so memory stays bounded."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class WordTokens:
    """ids_bytes(text): the ids as little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        code = byte_alphabet()
        ranks = {}
        for token, number in vocabulary.items():
            word = token.endswith("</w>")
            body = token.removesuffix("</w>")
            if all(c in code for c in body):
                ranks[bytes(code[c] for c in body) + _END * word] = number
        self.merge = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts, self.chunks = _Memo(self._part), _Memo(self._chunk)

    def _part(self, part: bytes) -> bytes:
        return array("I", self.merge(part.decode("latin-1").encode() + _END)).tobytes()

    def _plain(self, text: str) -> bytes:
        """NFC leaves these characters alone, and each lower-cases to one character of the same set."""
        raw = text.lower().encode("latin-1")
        if b"'" in raw:
            parts = [x.encode("latin-1") for x in _PARTS.findall(raw.decode("latin-1"))]
        else:
            kind = _KIND[np.frombuffer(raw, np.uint8)]
            cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
            parts = np.insert(np.frombuffer(raw, np.uint8), cuts, 32).tobytes().split()
        return b"".join(map(self.parts.__getitem__, parts))

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return self._plain(chunk)
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids_bytes(self, text: str) -> bytes:
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One instance for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


