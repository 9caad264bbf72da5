"""Hypervectors as packed 64-bit words: bit 0 of a component stands for +1, bit 1 for -1."""

from __future__ import annotations

import bisect
import struct

import numpy as np

DIMENSIONS = (1024, 2048, 4096)
#: What seeds are tagged with, and the constants of FNV-1a and SplitMix64.
SEED_TAG = "pua-hv1"
ALGORITHM_TAG = "pua-hdc-v1;seed=pua-hv1;fnv1a64+splitmix64;bundle=i32,zero->+1;decode=l1-norm-dot;resonator<=16"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M = (1 << 64) - 1


def fnv1a(*parts: bytes) -> int:
    """FNV-1a over each part after its length."""
    h = FNV_OFFSET
    for byte in b"".join(struct.pack("<Q", len(p)) + p for p in parts):
        h = (h ^ byte) * FNV_PRIME & _M
    return h


def seed(namespace: str, symbol: str, version: int = 1) -> int:
    return fnv1a(SEED_TAG.encode(), namespace.encode(), symbol.encode(), struct.pack("<I", version))


def encode(seeds, dim: int = 1024) -> np.ndarray:
    """The SplitMix64 streams of *seeds* as rows of dim / 64 words."""
    if dim not in DIMENSIONS:
        raise ValueError(f"dimension {dim} is not one of {DIMENSIONS}")
    with np.errstate(over="ignore"):
        z = np.asarray(seeds, dtype=np.uint64).reshape(-1, 1) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        z = (z ^ z >> np.uint64(30)) * np.uint64(MIX_1)
        z = (z ^ z >> np.uint64(27)) * np.uint64(MIX_2)
        return z ^ z >> np.uint64(31)


def signs(words: np.ndarray) -> np.ndarray:
    """Components as +1 and -1, along the last axis."""
    bits = np.unpackbits(np.ascontiguousarray(words, dtype="<u8").view(np.uint8), axis=-1, bitorder="little")
    return 1 - 2 * bits.astype(np.int64)


def packed(sums: np.ndarray) -> np.ndarray:
    """The signs of sums, zero counting as +1, as words."""
    return np.packbits(np.asarray(sums) < 0, axis=-1, bitorder="little").view("<u8")


def permute(words: np.ndarray, shift: int) -> np.ndarray:
    """Component i moves to i + shift, around the end."""
    return packed(np.roll(signs(words), shift, axis=-1))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)


def toward_zero(a, b):
    """Integer division that truncates toward zero."""
    q = np.abs(a) // b
    return np.where(np.asarray(a) < 0, -q, q)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dim = a.shape[-1] * 64
    return toward_zero((dim - 2 * hamming(a, b)) * 1000, dim)


def accumulate(vectors: np.ndarray, weights=None) -> np.ndarray:
    """Weighted sums of components, held within 32 bits."""
    s = signs(vectors)
    total = (s * np.asarray(weights, dtype=np.int64)[:, None]).sum(axis=0) if weights is not None else s.sum(axis=0)
    return np.clip(total, -(2**31), 2**31 - 1)


def bundle(vectors: np.ndarray) -> np.ndarray:
    return packed(accumulate(vectors))


def nearest(q: np.ndarray, book: np.ndarray) -> tuple[int, int, int]:
    """(index, similarity, margin to the runner-up): the first of equals; without a runner-up, one of -1000 counts."""
    sims = similarity(book, q)
    order = np.lexsort((np.arange(len(sims)), -sims))
    second = int(sims[order[1]]) if len(sims) > 1 else -1000
    top = int(sims[order[0]])
    return int(order[0]), top, min(1000, top - second)


def nearest_of_each(asked: np.ndarray, book: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() of each row of *asked*: (indices, similarities, margins), by blocks of rows."""
    first, top, margin = (np.zeros(len(asked), np.int64) for _ in range(3))
    for s in range(0, len(asked), step):
        sims = similarity(asked[s : s + step, None, :], book[None, :, :])
        first[s : s + step] = best = sims.argmax(axis=1)  # the first of equals
        top[s : s + step] = highest = np.take_along_axis(sims, best[:, None], 1)[:, 0]
        np.put_along_axis(sims, best[:, None], -(10**6), 1)
        second = sims.max(axis=1) if sims.shape[1] > 1 else np.full(len(sims), -1000)
        margin[s : s + step] = np.minimum(1000, highest - second)
    return first, top, margin


def cleanup(q: np.ndarray, book: np.ndarray, floor: int) -> tuple[int, int, int] | None:
    found = nearest(q, book)
    return found if found[1] >= floor else None


def components(book: np.ndarray) -> np.ndarray:
    """Components of a codebook as floating-point numbers, for exact products by matrix multiplication."""
    return signs(book).astype(np.float64)


def decode(sums: np.ndarray, book: np.ndarray, k: int, floor: int, entries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Up to *k* entries, the best first: each is taken out of the sums before the next is looked for.

    *entries*: components(book), where many sums are decoded by one book. Sums hold 32 bits and vectors 4096 components, so products are whole numbers
    below 2**53, which floating-point numbers hold exactly.
    """
    sums, entries, out = np.asarray(sums, dtype=np.int64).copy(), components(book) if entries is None else entries, []
    free, dim = np.ones(len(book), dtype=bool), book.shape[1] * 64
    while len(out) < min(k, len(book)):
        dots = (entries @ sums.astype(np.float64)).astype(np.int64)
        scores = np.where(free, toward_zero(dots * 1000, max(1, int(np.abs(sums).sum()))), np.iinfo(np.int64).min)
        i = int(np.argmax(scores))
        if scores[i] < floor:
            break
        out.append((i, int(scores[i])))
        free[i] = False
        dot = int(dots[i])
        share = (2 * abs(dot) + dim) // (2 * dim)  # half away from zero
        sums = np.clip(sums - entries[i].astype(np.int64) * (share if dot >= 0 else -share), -(2**31), 2**31 - 1)
    return out


class CodebookError(ValueError):
    """kind: empty, empty_id or duplicate_id."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Codebook:
    """Entries in the byte order of their ids."""

    def __init__(self, entries: list[tuple[str, np.ndarray]]):
        if not entries:
            raise CodebookError("empty", "codebook is empty")
        for i, (name, _) in enumerate(entries):
            if not name:
                raise CodebookError("empty_id", f"codebook entry {i} has an empty id")
        held = sorted(entries, key=lambda e: e[0].encode())
        for (a, _), (b, _) in zip(held, held[1:]):
            if a == b:
                raise CodebookError("duplicate_id", f"codebook id {a!r} occurs twice")
        self.ids, self.vectors = [i for i, _ in held], np.array([v for _, v in held], dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.ids)

    def index_of(self, name: str) -> int | None:
        at = bisect.bisect_left(self.ids, name.encode(), key=str.encode)
        return at if at < len(self) and self.ids[at] == name else None


def resonate(q: np.ndarray, a_book: np.ndarray, b_book: np.ndarray, cap: int = 16) -> tuple[int, tuple | None, tuple | None]:
    """(iterations, nearest in a, nearest in b) of a fixed point, or Nones if there is none within *cap* (1 to 16)."""
    if not 1 <= cap <= 16:
        raise ValueError(f"iteration cap {cap} is not in 1..16")
    project = lambda target, book: packed(accumulate(book, similarity(book, target)))
    a, b = bundle(a_book), bundle(b_book)
    for turn in range(1, cap + 1):
        new_a = project(q ^ b, a_book)
        new_b = project(q ^ new_a, b_book)
        if (new_a == a).all() and (new_b == b).all():
            return turn, nearest(a, a_book), nearest(b, b_book)
        a, b = new_a, new_b
    return cap, None, None


def capacity(entries: int, dim: int, k: int, trials: int = 10) -> tuple[int, int]:
    """For bundles of *k* of a codebook's entries: thousandths of the members found again by decode, and by one look at the signs.

    Members are drawn by a xorshift stream that only depends on *entries* and *k*.
    """
    book, state = encode([seed("capacity", f"item{i:05}") for i in range(entries)], dim), GOLDEN ^ entries << 8 ^ k
    hits = signed = 0
    entries_of = components(book)
    for _ in range(trials):
        chosen: dict[int, None] = {}
        while len(chosen) < k:
            state ^= state << 13 & _M
            state ^= state >> 7
            state ^= state << 17 & _M
            chosen[state % entries] = None
        sums = accumulate(book[[*chosen]])
        hits += len({i for i, _ in decode(sums, book, k, -1000, entries_of)} & chosen.keys())
        best = np.lexsort((np.arange(entries), -similarity(book, packed(sums))))[:k]
        signed += len(set(best.tolist()) & chosen.keys())
    return 1000 * hits // (k * trials), 1000 * signed // (k * trials)
