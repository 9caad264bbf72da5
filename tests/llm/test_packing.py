"""Packing: each piece's ids, gapless sequences, and as many sequences as one-by-one best fit gives."""

import random
import zlib

import pytest

from adjudica.llm import packing

P = pytest.importorskip("public_tokenizers")
WORD = P.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Best fit decreasing, a piece at a time: the remaining capacities."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(size - n)
    return sorted(left)


def test_plan_equals_one_by_one():
    draw = random.Random(6)
    for trial in range(60):
        size = draw.choice([7, 16, 64, 100])
        lengths = [draw.randint(1, size if trial % 2 else max(1, size // 3)) for _ in range(draw.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins = {}
        for length, start, end, first, offset, each in packing.plan(counts, size):
            for r in range(start, end):
                bins.setdefault(first + (r - start) // each, []).append((offset + (r - start) % each * length, length))
        left = []
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            left.append(size - at)
        assert sorted(left) == one_by_one(lengths, size)


def test_tightest():
    bins = packing.OpenBins(100)
    assert bins.tightest(1) is None
    for c in (3, 50, 100):
        bins.put(c, 0, 2)
    assert [bins.tightest(x) for x in (1, 3, 4, 50, 51, 100)] == [3, 3, 50, 50, 100, 100]
    assert bins.take(50, 5) == (0, 2) and bins.tightest(4) == 100


def check(rows, docs, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    expected, places = [], {}
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), size)):
            part = ids[s : s + size]
            expected.append((i is None, i, p, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id is None, *r[:5]) for r in rows) == sorted(expected)
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert len(places) == len(one_by_one([e[4] for e in expected], size))


def test_rows(spark):
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choices(["the", "cat", "x1", "ünder"], k=draw.randint(0, 40)))) for i in range(150)] + [(500, None), (None, "a b"), (None, "a b"), (3, "the " * 100)]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    check(packing.pack(table, WORD, size=32, shards=4).collect(), docs, 32)
    assert packing.pack(table.limit(0), WORD).count() == 0
    kept = packing.pack(table, WORD, size=32, keep=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)


def test_plan_starts_no_workers(spark):
    """The plan gets to the JVM as an Arrow table; as rows it went through Python workers of their own, which stayed in the executors."""
    leaves = packing.pack(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").coalesce(1), WORD)._jdf.queryExecution().analyzed().collectLeaves()
    held = [leaves.apply(i) for i in range(leaves.size())]
    assert len(held) == 3 and not any("PythonRDD" in x.rdd().toDebugString() for x in held if x.getClass().getSimpleName() == "LogicalRDD")


def test_whole_table(spark):
    from adjudica.llm.queries import op8_packing

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(op8_packing(spark, d).collect(), docs, 2048)
