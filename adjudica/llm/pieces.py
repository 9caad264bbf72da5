"""Operator 3: exact merge-type encoding by backtracking, and decoding.

A sequence of tokens is what the merges give for a text exactly if each two neighbours are what the
merges give for their own joined text. So the encoder walks from left to right with the longest
token that starts at each place (all tokens come from one Aho-Corasick pass), keeps a token only if it is
compatible with the one before, falls back to shorter tokens, and steps back where none fits; a
bitfield remembers places from which the rest can't be reached, so each is tried once.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, records

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (4, at) if tag & 7 == 5 else (8, at) if tag & 7 == 1 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A merge-type model with byte fallback, a dummy prefix and no other normalisation."""

    UNKNOWN, CONTROL, BYTE = 2, 3, 6

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            message = f.read()
        self.pieces, self.kinds = [], []
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        for number, value in _fields(message):
            if number == 3:  # normaliser
                spec = dict(_fields(value))
                if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1):
                    raise ValueError("only models with a dummy prefix and no normalisation are supported")
            if number != 1:
                continue
            piece = dict(_fields(value))
            name, kind, i = piece.get(1, b"").decode(), piece.get(3, 1), len(self.pieces)
            self.pieces.append(name)
            self.kinds.append(kind)
            if kind == self.BYTE:
                self.byte_ids[int(name[3:5], 16)] = i
            elif kind not in (self.UNKNOWN, self.CONTROL):
                self.id_of[name] = i
                self.score[name] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        self.end = self.pieces.index("</s>")
        self.controls = {i for i, k in enumerate(self.kinds) if k == self.CONTROL}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.bytes_of = [b"" if k == self.CONTROL else bytes([self.byte_of[i]]) if k == self.BYTE else " ⁇ ".encode() if k == self.UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.matcher = ahocorasick.Automaton()
        for name, i in self.id_of.items():
            self.matcher.add_word(name, (len(name), i))
        self.matcher.make_automaton()
        self.joints = {x for name in self.id_of for x in zip(name, name[1:])}
        # no piece spans from another character to a mark for a space, nor over a line end
        if any(b == SPACE != a or "\n" in (a, b) for a, b in self.joints):
            self._chunk = re.compile(r"(?s).+")
        else:
            self._chunk = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
        self._fit = Memo(self._fits)
        self._segments = Memo(self._encode_segment, limit=32 << 20)
        self._chunks = Memo(self._encode_chunk)
        self._shown = Memo(self._show_chunk, limit=128 << 20, weigh=lambda x: 72 + sum(map(sys.getsizeof, x[1:])))

    def remerge(self, text: str) -> list[str]:
        """What merging alone gives: the best-scored pair first, of equals the leftmost."""
        symbols, n, score = [*text], len(text), self.score
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(-score[ab], i, ab) for i, ab in enumerate(map("".join, zip(text, text[1:]))) if ab in score]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not symbols[i] or (j := after[i]) >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (ab := joined + symbols[k]) in score:
                    heapq.heappush(heap, (-score[ab], i, ab))
            if (h := before[i]) >= 0 and (ab := symbols[h] + joined) in score:
                heapq.heappush(heap, (-score[ab], h, ab))
        return [s for s in symbols if s]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the second token may follow the first (-1: the text's start)."""
        a, b = pair
        names = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
        return self.remerge("".join(names)) == names

    def _encode_segment(self, text: str) -> list[int]:
        n = len(text)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, match in self.matcher.iter(text):
            starting[last + 1 - match[0]].append(match)  # shortest first, as ends come in order
        failed = bytearray(n // 8 + 1)
        tokens, places, fit = [-1], [0], self._fit
        untried = [len(starting[0])]  # of the tokens that start at each place on the path
        at, before = 0, -1
        while at < n:
            options, k = starting[at], untried[-1]
            while k:
                k -= 1
                size, i = options[k]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1 and fit[before, i]:
                    untried[-1] = k
                    tokens.append(i)
                    places.append(end)
                    untried.append(len(starting[end]))
                    at, before = end, i
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if before < 0:
                    raise ValueError("the model can't spell this text")
                tokens.pop(), places.pop(), untried.pop()
                at, before = places[-1], tokens[-1]
        return tokens[1:]

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Cut where no piece can span, then encode each segment; characters without a piece become bytes."""
        ids: list[int] = []
        joints, known, start = self.joints, self.id_of, 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or (chunk[i - 1], chunk[i]) not in joints:
                segment, start = chunk[start:i], i
                if len(segment) == 1 and segment not in known:
                    ids += [self.byte_ids[b] for b in segment.encode("utf-8", "replace")]
                else:
                    ids += self._segments[segment]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """All ids of the text and the end id."""
        ids: list[int] = []
        if text:  # a chunk: marks for spaces, then what isn't one
            for chunk in map(self._chunks.__getitem__, self._chunk.findall(SPACE + text.replace(" ", SPACE))):
                ids += chunk
        ids.append(self.end)
        return ids

    def _show_chunk(self, chunk: str) -> tuple[int, str, bytes]:
        """How many ids a chunk has, the ids as text, and the bytes that they decode to."""
        ids = self._chunks.compute(chunk)
        return len(ids), "".join(f"{i} " for i in ids), b"".join(self.bytes_of[i] for i in ids)

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text) without lists of ids: chunks encode and decode by themselves, as all bytes
        of a character are within one."""
        parts = [self._shown[c] for c in self._chunk.findall(SPACE + text.replace(" ", SPACE))] if text else []
        counts, said, raw = zip(*parts) if parts else ((), (), ())
        try:
            return sum(counts) + 1, "".join(said) + str(self.end), b"".join(raw)[bool(parts) :].decode("utf-8")
        except UnicodeDecodeError:  # can't be with whole characters; the general way, then
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Marks become spaces, but for the dummy prefix; in a run of byte pieces, what isn't UTF-8 becomes U+FFFD byte by byte."""
        kinds, names = self.kinds, self.bytes_of
        first = next((i for i in ids if kinds[i] != self.CONTROL), None)
        cut = first is not None and self.pieces[first].startswith(SPACE)
        if not any(i in self.controls for i in ids[:-1]):
            try:
                return b"".join([names[i] for i in ids])[cut:].decode("utf-8")
            except UnicodeDecodeError:
                pass
        runs = ((k, b"".join(names[i] for i in run)) for k, run in itertools.groupby(ids, lambda i: kinds[i]))
        return "".join(_lenient(raw) if k == self.BYTE else raw.decode("utf-8") for k, raw in runs)[cut:]


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_loaded: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep: bool = True) -> DataFrame:
    """One row per row of *docs*: key, n_tokens, ids_sha256, decoded_sha256, and with *keep* ids and decoded.

    Null and empty texts give the end id alone and an empty decoding. Whole texts are encoded in
    time linear in their length. Other columns are not read; repeated rows are encoded each; a null key
    stays null; an empty table gives an empty result.
    """
    result = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>,decoded:string" * keep + ">"
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if keep else {})

    @F.arrow_udf(result)
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, digest = load(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for texts in batches:
            rows = []
            for t in texts:
                n, said, back = model.round_trip(t.as_py())
                rows.append((n, digest(said), digest(back), *([model.encode(t.as_py()), back] if keep else [])))
            yield records(rows, **kinds)

    return docs.select(F.col(key), encoded(F.col(text)).alias("_e")).select(key, "_e.*")
