"""Word-level byte-pair merging with a heap and a linked list, for vocabularies with word-end symbols.

The vocabulary file's own pipeline is followed exactly: special strings are cut out of the raw text
first, then NFC, lower-casing character by character, and splitting into contractions, letter runs,
single digits and runs of other marks; white space is dropped. None of these steps looks across white
space, so a text is handled as its white-space separated chunks, and equal chunks are merged once.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata

import regex

from .common import Memo

#: Characters that str.split() takes for white space though Unicode's White_Space does not.
_ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
_CHUNK = regex.compile(r"\P{White_Space}+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Merges of a vocabulary file, held once per Python worker (see :func:`load`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.inner = [vocab[x] for x in _byte_letters()]
        self.final = [vocab[x + end] for x in _byte_letters()]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # words are chunks of themselves, so one memo serves both
        self.counts = Memo(self._count_chunk)
        self.ids = Memo(self._ids_of_chunk, limit=64 << 20)

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuse a vocabulary whose own pipeline isn't the one that this class follows."""
        steps = lambda part, name: [x["type"] for x in (spec.get(part) or {}).get(name, [])]
        odd = [x["content"] for x in spec["added_tokens"] if "<|" not in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")]
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix") or odd:
            raise ValueError(f"the vocabulary is of another kind; special strings that differ: {odd[:3]}")
        if steps("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or steps("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
            raise ValueError("the vocabulary's normaliser or pre-tokeniser is another one")

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """Symbols left after all merges (-1 where one was merged away), and how many merges there were.

        The heap holds the ranks and places of adjacent pairs, a rank and a place in one integer; left
        and right neighbours are linked, so each merge is O(log n) however long the word is. Entries
        that other merges made stale are known by another pair's standing there.
        """
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        n, merges, ranks = len(symbols), 0, self.ranks
        heap = [rank << 40 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        if not heap:
            return symbols, 0
        heapq.heapify(heap)
        after, before, place = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & place, top >> 40
            j = after[i]
            if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            new = self.made[rank]
            symbols[i], symbols[j], merges = new, -1, merges + 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((new, symbols[k]))) is not None:
                    heapq.heappush(heap, rank << 40 | i)
            if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], new))) is not None:
                heapq.heappush(heap, rank << 40 | h)
        return symbols, merges

    def merge_short(self, word: bytes) -> list[int]:
        """The symbols that merge() leaves, by looking through the ranks of all pairs at each step: faster for a few dozen bytes."""
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        get, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            symbols[i] = new = made[rank]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, symbols[i + 1]), none)
        return symbols

    @staticmethod
    def _words(chunk: str) -> list[str]:
        """The pre-tokens of a chunk; most are a run of letters, or one with a mark after it."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return _PRETOKEN.findall(chunk)

    def _count_chunk(self, chunk: str) -> int:
        words = self._words(chunk)
        if words == [chunk]:
            raw = chunk.encode("utf-8", "replace")
            return len(raw) - self.merge(raw)[1]
        return sum(map(self.counts.__getitem__, words))

    def _ids_of_chunk(self, chunk: str) -> bytes:
        words = self._words(chunk)
        if words == [chunk]:
            raw = chunk.encode("utf-8", "replace")
            symbols = self.merge_short(raw) if len(raw) <= 48 else [s for s in self.merge(raw)[0] if s >= 0]
            return struct.pack(f"<{len(symbols)}I", *symbols)
        return b"".join(map(self.ids.__getitem__, words))

    def _sections(self, text: str):
        """(chunks, id of the special string that follows or None), in order."""
        parts = self._cut.split(text) if "<|" in text else [text]
        for i in range(0, len(parts), 2):
            # the final sigma is no special case: letters are lower-cased one by one
            part = unicodedata.normalize("NFC", parts[i]).replace("Σ", "σ").lower()
            chunks = _CHUNK.findall(part) if any(x in part for x in _ODD_SPACES) else part.split()
            yield chunks, self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def count(self, text: str | None) -> int:
        return sum(sum(map(self.counts.__getitem__, chunks)) + (after is not None) for chunks, after in self._sections(text or ""))

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit numbers."""
        return b"".join(b"".join(map(self.ids.__getitem__, chunks)) + (b"" if after is None else after.to_bytes(4, "little")) for chunks, after in self._sections(text or ""))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
