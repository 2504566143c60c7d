"""Counts the tokens of texts under a byte-level BPE file, merging batches of pre-tokens as ragged arrays.

Every batch of texts becomes one array of code points. Classes of characters (blank, letter, number, other) give
the pre-tokens' bounds, those that occur in the batch are told apart by their bytes, and those not yet counted
are merged together: one array holds the symbols of all of them, and in each round every sequence applies its
own lowest-ranked pair wherever it stands, left to right. What survives is counted.

That the lowest pair may be applied everywhere at once rests on the vocabulary: a token has one pair that makes it,
so a pair with a new symbol ranks after the pair that made this symbol. A file where that fails is refused. A
sequence is cut where no token holds the two bytes side by side, for nothing merges over such a place; so a word
without a blank of any length is many short sequences, and rounds stay few.

Defined cases: a null text is empty and has no bytes and no tokens; repeated rows and rows without a doc_id are
counted like others, row by row, so there are no ties; further columns are left out, whatever their names; an empty
table gives an empty one; a long text is taken whole, alone in its batch if need be. A special token's
string inside a text is that token, as the library has it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadloom.llm.common import lean, utf8_batch
from roadloom.llm.word_tokens import byte_alphabet

#: Counts of so many pre-tokens are kept by a worker; then it begins anew.
MEMO_ENTRIES = 500_000
#: Code points of one array; a longer text has an array of its own.
ARRAY_CHARS = 1 << 21

BLANK, LETTER, NUMBER, OTHER, BOUND = range(5)
_UNKNOWN = 255
_NEVER = np.int64(1) << 40
#: The endings that the pre-tokeniser splits off after an apostrophe (fixed values of its pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class ByteCounts:
    """count(texts as bytes): how many tokens each text has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, before = parts["model"], parts["pre_tokenizer"]
        plain = parts["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.shown = library.pre_tokenizer
        self.special = [t["content"].encode() for t in sorted(parts["added_tokens"], key=lambda t: -len(t["content"]))]
        ids, alphabet = model["vocab"], byte_alphabet()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in alphabet.items():
            self.of_byte[byte] = ids[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len({a + b for a, b in pairs}) != len(pairs):
            raise ValueError("two pairs make the same token")
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.joined = np.zeros((256, 256), bool)
        for token in ids:
            raw = [alphabet[c] for c in token] if all(c in alphabet for c in token) else []
            self.joined[raw[:-1], raw[1:]] = True
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.memo: dict[bytes, int] = {}

    def _class(self, char: str) -> int:
        """The class of a character as the library itself sees it: what it forms one pre-token with."""
        if 0xD800 <= ord(char) < 0xE000:
            return OTHER
        for beside, kind in (("a", LETTER), ("1", NUMBER), (".", OTHER)):
            if len(self.shown.pre_tokenize_str(beside + char)) == 1:
                return kind
        return BLANK

    def bounds(self, chars: np.ndarray) -> np.ndarray:
        """True where a pre-token begins, and at every separator: chars are code points, -1 between texts."""
        kind = np.full(len(chars), BOUND, np.uint8)
        inside = chars >= 0
        kind[inside] = self.classes[chars[inside]]
        if (kind == _UNKNOWN).any():
            for char in np.unique(chars[kind == _UNKNOWN]).tolist():
                self.classes[char] = self._class(chr(char))
            kind[inside] = self.classes[chars[inside]]
        begins = np.ones(len(chars), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BOUND)
        # a run of blanks before something else gives up its last one, which a single space then shares with what follows
        ends_blank = np.zeros(len(chars), bool)
        ends_blank[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != BOUND)
        begins |= ends_blank
        glued = np.zeros(len(chars), bool)
        glued[1:] = ends_blank[:-1] & (chars[:-1] == 32)
        # an apostrophe that begins a pre-token and has an ending after it
        marks = np.flatnonzero((chars == 39) & begins & ~glued)
        begins &= ~glued
        open_marks = np.ones(len(marks), bool)
        for ending in ENDINGS:
            fits = open_marks.copy()
            for k, letter in enumerate(ending, 1):
                at = np.minimum(marks + k, len(chars) - 1)
                fits &= (marks + k < len(chars)) & (chars[at] == ord(letter))
            at = marks[fits]
            begins[at + 1] = False
            after = at + len(ending) + 1
            begins[after[after < len(chars)]] = True
            open_marks &= ~fits
        return begins

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair of symbols, _NEVER where none is known."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NEVER)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of every word, all of which are merged together."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.zeros(len(raw), bool)
        first[np.cumsum([0, *map(len, words[:-1])])] = True
        word = np.cumsum(first) - 1
        first[1:] |= ~self.joined[raw[:-1], raw[1:]]
        symbols, left = self.of_byte[raw], np.zeros(len(words), np.int64)
        rank = np.full(len(raw), _NEVER, np.int64)  # of a symbol with the next one of its sequence
        rank[:-1] = np.where(first[1:], _NEVER, self.ranked(symbols[:-1], symbols[1:]))
        while len(symbols):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            going = least < _NEVER
            if not going.all():
                np.add.at(left, word[starts[~going]], sizes[~going])
                stay = np.repeat(going, sizes)
                symbols, rank, first, word = symbols[stay], rank[stay], first[stay], word[stay]
                sizes, least = sizes[going], least[going]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(least, sizes)
            # places side by side overlap (a pair of equal symbols): every other one counts, from the left
            beside = np.flatnonzero(chosen[1:] & chosen[:-1]) + 1
            if len(beside):
                run = np.cumsum(chosen)
                opens = chosen.copy()
                opens[1:] &= ~chosen[:-1]
                chosen &= (run - np.maximum.accumulate(np.where(opens, run, 0))) % 2 == 0
            at = np.flatnonzero(chosen)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, first, word, rank = symbols[keep], first[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # places move up by what went before them
            near = np.unique(np.concatenate([at, at[~first[at]] - 1]))
            last = np.ones(len(symbols), bool)
            last[:-1] = first[1:]
            rank[near] = _NEVER
            near = near[~last[near]]
            rank[near] = self.ranked(symbols[near], symbols[near + 1])
        return left

    def of_words(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = words
        if new:
            self.memo.update(zip(new, self.merged(new).tolist()))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def _counted(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of texts without special tokens, one array for all of them."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return np.zeros(len(texts), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that begin a character
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cuts = np.searchsorted(starts, np.cumsum(lengths)[:-1])
        padded = np.insert(chars, cuts, -1)
        inside = padded >= 0
        begins = starts[np.flatnonzero(self.bounds(padded)[inside])]
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        sizes = self.of_words(words.dictionary.to_pylist())[words.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.searchsorted(begins, np.cumsum(lengths))
        return np.diff(total[np.concatenate([[0], ends])])

    def _plain(self, raw: bytes) -> tuple[list[bytes], int]:
        """The stretches between special tokens, and how many of these there are."""
        stretches, found = [raw], 0
        for token in self.special:
            if token in raw:
                stretches = [x for s in stretches for x in s.split(token)]
                found = len(stretches) - 1
        return stretches, found

    def count(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of every text of utf8_batch's arrays."""
        out, held, owner, chars = np.zeros(len(bounds) - 1, np.int64), [], [], 0

        def release() -> None:
            if held:
                np.add.at(out, np.array(owner), self._counted(held))
            held.clear()
            owner.clear()

        for k, (begin, end) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            stretches, found = self._plain(raw[begin:end].tobytes())
            out[k] += found
            for s in stretches:
                if s:
                    if chars + len(s) > ARRAY_CHARS:
                        release()
                        chars = 0
                    held.append(s)
                    owner.append(k)
                    chars += len(s)
        release()
        return out


_loaded: dict[str, ByteCounts] = {}


def byte_counts(path: str) -> ByteCounts:
    """One instance for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteCounts(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = byte_counts(tokenizer)
        for batch in batches:
            raw, bounds = utf8_batch(batch.column(1))
            n = counts.count(raw, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
