"""Operator 4: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code. Bits 0-22 and 23-45 of a fingerprint are each held against
the perfect Golay code [23, 12], which has a codeword within 3 bits of any word; the remaining bits are
left open, so an anchor is a pair of codewords. If two fingerprints differ in 4 bits at most, some
point lies within 2 bits of both, and the anchor nearest to that point is within covering radius plus 2 bits, summed over the blocks,
of both. So each fingerprint is replicated to all
anchors with an excess over the radius of at most 2 (61 on average), where each pair meets, and compared there.

An anchor with too many fingerprints for one task is passed on, to be dealt with by a finer code
that adds the Hamming code [15, 11] on bits 46-60. What crowds an anchor of that too is dealt out by masks: 3 bits lie in 3 of the 16
groups of 4 bits at most, so linked fingerprints are equal under one of the 560 masks that leave 3 groups out, and no more than
4096 different fingerprints can be equal under a mask (of 4 bits: 1820 masks, 65,536 fingerprints). Comparing finds a spanning forest of each anchor's links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, scratch, staged
from .components import components

#: Seed of the shingle hash; (first bit, length, generator polynomial, radius) of each code.
SEED = 42
GOLAY_LOW, GOLAY_HIGH, HAMMING = (0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1)
COARSE, FINE = (GOLAY_LOW, GOLAY_HIGH), (GOLAY_LOW, GOLAY_HIGH, HAMMING)
#: What a fingerprint's anchors may be farther away than the covering radius, in bits over all blocks.
SLACK = 2
_WORDS_AT_ONCE = 1 << 16
MANY = 1 << 27


def fingerprint(text: str | None, width: int = 3, distinct: bool = False) -> int:
    """The 64-bit fingerprint, unsigned, of a text's shingles with repeats, or each counted once if *distinct*."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if distinct and width == 1:
        words = [*set(words)]
    elif distinct:
        raise ValueError("only single words are counted once")
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for start in range(0, max(1, len(words) - width + 1), _WORDS_AT_ONCE):
        part = words[start : start + _WORDS_AT_ONCE + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@dataclass(frozen=True)
class Rule:
    """Which texts are near-duplicates: those whose fingerprints of *width* words (of each word once, if *distinct*) differ in at most *most* bits and,
    with *beside* = (width, bits), whose fingerprints of that width differ in at most those bits. All links are found; *most* is 4 at most."""

    width: int = 3
    most: int = 3
    distinct: bool = False
    beside: tuple[int, int] | None = None

    def __post_init__(self):
        if not 0 <= self.most <= 2 * SLACK or (self.distinct and self.width > 1):
            raise ValueError(f"not a rule that anchors find all links of: {self}")

    @property
    def marks(self) -> list[str]:
        return ["fp", "fp2"] if self.beside else ["fp"]


#: Texts whose shingles of five words have a similarity of about 0.8 or more: changing a few words changes little of the words that occur, while
#: other texts of much the same words, or of the same words in another order, differ in the second fingerprint.
SIMILAR = Rule(width=1, most=4, distinct=True, beside=(5, 13))


def fingerprints(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) and, with rule.beside, fp2: fingerprints as signed longs.

    One function makes both: of two with iterators each would get the texts in a worker of its own.
    """
    kinds = [(rule.width, rule.distinct), *([(rule.beside[0], False)] if rule.beside else [])]

    @F.arrow_udf(f"struct<{','.join(f'{m}:bigint' for m in rule.marks)}>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = np.array([[fingerprint(t, *kind) for kind in kinds] for t in (x.as_py() for x in texts)], dtype=np.uint64).reshape(-1, len(kinds))
            yield pa.StructArray.from_arrays([pa.array(m) for m in made.view(np.int64).T.copy()], names=rule.marks)

    made = docs.select(F.col(key).alias("doc_id"), marked(F.col(text)).alias("_marks"))
    return made.select("doc_id", *(F.col(f"_marks.{m}").alias(m) for m in rule.marks))


@lru_cache
def _block(code: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a cyclic code: remainders of low and high halves of a word; by remainder, what leads from a word to each
    codeword within radius + SLACK and its excess over the radius (padded with excess 99)."""
    _, length, generator, radius = code
    degree = generator.bit_length() - 1

    def remainder(word: int) -> int:
        for bit in range(length - 1, degree - 1, -1):
            if word >> bit & 1:
                word ^= generator << (bit - degree)
        return word

    unit = [remainder(1 << i) for i in range(length)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for r in bits:
            out = np.concatenate([out, out ^ r])
        return out

    steps: list[list[tuple[int, int]]] = [[] for _ in range(1 << degree)]
    for weight in range(radius + SLACK + 1):
        for places in combinations(range(length), weight):
            to = 0
            for p in places:
                to ^= unit[p]
            steps[to].append((sum(1 << p for p in places), max(0, weight - radius)))
    most = max(map(len, steps))
    moves = np.zeros((1 << degree, most), dtype=np.int64)
    excess = np.full((1 << degree, most), 99, dtype=np.int8)
    for r, found in enumerate(steps):
        moves[r, : len(found)], excess[r, : len(found)] = zip(*found)
    return table(unit[:12]), table(unit[12:]), moves, excess


def anchors(fps: np.ndarray, code: tuple = COARSE, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(index into *fps*, anchor) for all anchors whose excess is at most *slack*."""
    at, anchor, spent = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int8)
    for part in code:
        low, high, moves, excess = _block(part)
        word = (fps[at].view(np.uint64) >> np.uint64(part[0])).astype(np.int64) & ((1 << part[1]) - 1)
        r = low[word & 0xFFF] ^ high[word >> 12]
        row, column = np.nonzero(spent[:, None] + excess[r] <= slack)
        spent = spent[row] + excess[r[row], column]
        anchor = anchor[row] | (word[row] ^ moves[r[row], column]) << part[0]
        at = at[row]
    return at, anchor


@lru_cache
def _masks(most: int) -> tuple[tuple[int, ...], ...]:
    """The groups of 4 bits that each mask keeps: all but *most* of 16."""
    return tuple(tuple(g for g in range(16) if g not in left_out) for left_out in combinations(range(16), most))


def masked(fps: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(index into *fps*, mask and what it keeps as one number) for all masks."""
    fps, keys = fps.view(np.uint64), []
    groups = [fps >> np.uint64(4 * g) & np.uint64(15) for g in range(16)]
    for number, kept in enumerate(_masks(most)):
        key = np.full(len(fps), number << 4 * (16 - most), dtype=np.uint64)
        for place, g in enumerate(kept):
            key |= groups[g] << np.uint64(4 * place)
        keys.append(key.view(np.int64))
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)


def _close(marks: np.ndarray, others: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Which columns of fingerprints differ within the limits; a row per kind."""
    out = np.bitwise_count(marks[0] ^ others[0]) <= limits[0]
    for a, b, limit in zip(marks[1:], others[1:], limits[1:]):
        out &= np.bitwise_count(a ^ b) <= limit
    return out


def forest(marks: np.ndarray, limits: tuple[int, ...]) -> list[tuple[int, int]]:
    """Links (as places in *marks*, a row per kind of fingerprint) that connect whatever is close, directly or over others.

    What a member reaches is taken out of the rest at once, so a dense group costs a few passes.
    """
    marks = marks.view(np.uint64)  # of signed numbers, numpy counts the bits of the absolute value
    links, rest, values = [], np.arange(marks.shape[1]), marks
    while len(rest):
        queue, rest, values = [rest[0]], rest[1:], values[:, 1:]
        while queue and len(rest):
            x = queue.pop()
            near = _close(values, marks[:, x], limits)
            if near.any():
                found = rest[near].tolist()
                links += [(x, y) for y in found]
                queue += found
                rest, values = rest[~near], values[:, ~near]
    return links


def _links_of(anchor: np.ndarray, ids: np.ndarray, marks: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the ids of rows sorted by anchor."""
    empty = np.zeros(0, dtype=np.int64)
    if len(anchor) < 2:
        return empty, empty
    marks = marks.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    run = np.repeat(np.arange(len(starts)), sizes)
    large = sizes > 24
    found: list[np.ndarray] = []
    for lag in range(1, int(min(24, sizes.max()))):
        i = np.flatnonzero((anchor[lag:] == anchor[:-lag]) & ~large[run[lag:]])
        if not len(i):
            break
        i = i[_close(marks[:, i], marks[:, i + lag], limits)]
        found.append(np.stack([i, i + lag]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    crowded = large | (np.bincount(run[pairs[0]], minlength=len(sizes)) >= sizes) & (sizes > 2)
    kept = [pairs[:, ~crowded[run[pairs[0]]]]]
    for r in np.flatnonzero(crowded):
        s = starts[r]
        if links := forest(marks[:, s : s + sizes[r]], limits):
            kept.append(np.array(links, dtype=np.int64).T + s)
    pairs = np.concatenate(kept, axis=1)
    ends = np.sort(ids[pairs], axis=0)
    ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
    return ends[1], ends[0]


def _compared(code: tuple | None, limit: int | None, rule: Rule):
    names, limits = ["anchor", "first", *rule.marks], (rule.most, *([rule.beside[1]] if rule.beside else []))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((f"passed_{m}", pa.int64()) for m in rule.marks)])

    def batch(a: np.ndarray, b: np.ndarray, marks: np.ndarray | None = None) -> pa.RecordBatch:
        passed = [pa.nulls(len(a), pa.int64())] * len(rule.marks) if marks is None else [pa.array(m) for m in marks]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *passed], schema=schema)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 2048 if code else 256
        for rows in batches:
            columns = [rows.column(c).to_numpy() for c in names[1:]]
            for s in range(0, len(rows), step):
                fps = columns[1][s : s + step]
                at, anchor = anchors(fps, code) if code else masked(fps, max(1, rule.most))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *(pa.array(c[s : s + step][at]) for c in columns)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), dtype=np.int64)
        hot = None
        for rows in batches:
            new = np.stack([rows.column(c).to_numpy() for c in names])
            if hot is not None:
                n = int(np.searchsorted(new[0], hot, "right"))
                yield batch(new[1, :n], new[1, :n], new[2:, :n])
                new = new[:, n:]
                if not new.shape[1]:
                    continue
                hot = None
            held = np.concatenate([held, new], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            yield batch(*_links_of(held[0, :last], held[1, :last], held[2:, :last], limits))
            held = held[:, last:]
            if limit is not None and held.shape[1] > limit:
                hot = held[0, -1]
                yield batch(held[1], held[1], held[2:])
                held = held[:, :0]
        yield batch(*_links_of(held[0], held[1], held[2:], limits))

    return post, compare


def _met(firsts: DataFrame, code: tuple | None, limit: int | None, rule: Rule, rows: int) -> DataFrame:
    post, compare = _compared(code, limit, rule)
    named = ["first", *rule.marks]
    posted = firsts.select(named).mapInArrow(post, ", ".join(f"{c} long" for c in ["anchor", *named]))
    compared = posted.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, ", ".join(f"{c} long" for c in ["a", "b", *(f"passed_{m}" for m in rule.marks)]))
    return staged(few(compared, 61 * rows, 200_000, 6), "met")[0]


def links(firsts: DataFrame, rule: Rule = Rule(), limit: int = 50_000) -> DataFrame:
    """(a, b): links between the ids *first* of distinct fingerprints that connect all that the rule links.

    An anchor's rows are held together up to *limit* of them (24 or 32 bytes each); fingerprints of anchors with more are done over by
    the finer code, and those that crowd its anchors too by masks, under which few can meet. The coarse code has 2**24
    anchors; beyond MANY fingerprints the finer one (2**35 anchors) is used from the start, so that anchors stay small. Any way
    finds the same links.
    """
    rest, rows, found = firsts, firsts.count(), None
    for code in (COARSE, FINE, None)[rows > MANY :]:
        met = _met(rest, code, limit if code else None, rule, rows)
        these = met.filter("passed_fp is null").select("a", "b")
        found = these if found is None else found.unionAll(these)
        rest = met.filter("passed_fp is not null").select(F.col("a").alias("first"), *(F.col(f"passed_{m}").alias(m) for m in rule.marks)).distinct()
        if code is None or rest.isEmpty():
            return found
        rest, _ = staged(few(rest, rows), "dense")
        rows = rest.count()
    return found


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of *docs*: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts that are null, empty or without a word have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id are one document. A row with a null doc_id gets its fingerprint
    and a null component_id and links nothing. Other columns are not read. Exact copies share a
    fingerprint and are compared once, whatever their number. An empty table gives no rows.
    """
    spark, kinds = docs.sparkSession, rule.marks
    marks, _ = staged(fingerprints(docs, rule, text, key), "marks")
    rows = marks.count()
    with scratch(spark) as made:
        named = marks.filter(F.col("doc_id").isNotNull())
        firsts, _ = staged(few(named.groupBy(*kinds).agg(F.min("doc_id").alias("first")), rows), "firsts")
        found = links(firsts, rule)
        several = named.groupBy("doc_id").agg(F.min(F.struct(*kinds)).alias("x"), F.max(F.struct(*kinds)).alias("y")).filter("x <> y").select("doc_id")
        same = named.join(several, "doc_id", "left_semi").join(firsts, kinds).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        reached = components(found.unionAll(same), rows)
        classes = firsts.join(reached, F.col("first") == F.col("node"), "left").select(*kinds, F.coalesce("component", "first").alias("component_id"))
        by_fp, kept = staged(few(classes, rows), "classes")
        made.remove(kept)  # the result reads this and the marks
    classed = marks.join(by_fp, kinds, "left")
    return classed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
