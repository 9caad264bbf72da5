"""Near-duplicates against all pairs."""

import pathlib
import random
import re

import numpy as np
import pytest
import xxhash

from adjudica.llm import simhash
from adjudica.llm.components import components


def brute_fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=3, others=None, most_beside=64):
    """{key: smallest reachable key} over keys with fingerprints (and *others* beside them), all pairs."""
    keys, root = sorted(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values, beside = (np.array([x[k] for k in keys], dtype=np.uint64) for x in (fps, others or fps))
    for i, k in enumerate(keys):
        for j in np.flatnonzero((np.bitwise_count(values[i + 1 :] ^ values[i]) <= most) & (np.bitwise_count(beside[i + 1 :] ^ beside[i]) <= most_beside)):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_fingerprints():
    draw = random.Random(3)
    texts = ["", None, "one", "One two", "A b C d", "a\x0bb\x0cc d\r\ne", "É É é  x y z", "w " * 70000] + [" ".join(draw.choices(["a", "B", "ß", "c1"], k=draw.randint(0, 30))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_anchors_meet_and_are_few():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2**63, 4000, dtype=np.int64) * 2 + 1
    for code, most in ((simhash.COARSE, 80), (simhash.FINE, 200)):
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << draw.choice(64, 4, replace=False).astype(np.uint64)) for _ in x]).view(np.int64)
        (i, a), (j, b) = simhash.anchors(x, code), simhash.anchors(x ^ flips, code)
        assert len(a) < most * len(x)
        assert len(set(zip(i.tolist(), a.tolist()))) == len(a)
        met = set(zip(i.tolist(), a.tolist())) & set(zip(j.tolist(), b.tolist()))
        assert {k for k, _ in met} == set(range(len(x)))


def test_components(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(200, 260)] + [(5, x) for x in range(300, 340)] + [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit,most,beside,many", [(50_000, 3, None, 1 << 27), (8, 3, None, 1 << 27), (2, 3, None, 1 << 27), (50_000, 3, None, 10), (2, 4, (5, 20), 1 << 27), (50_000, 4, (5, 20), 1 << 27), (2, 4, None, 10)])
def test_links_against_all_pairs(spark, monkeypatch, limit, most, beside, many):
    """By the coarse code alone, with crowded anchors done over by the finer code and by masks, and by the finer code from the start."""
    monkeypatch.setattr(simhash, "MANY", many)
    draw = np.random.default_rng(7)
    centres = draw.integers(-(2**63), 2**63 - 1, 6, dtype=np.int64)
    fps = set(draw.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64).tolist())
    for c in centres.tolist():
        for _ in range(120):
            x = c
            for b in draw.choice(63, draw.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    by = {i: int(f) for i, f in enumerate(sorted(fps))}
    second = {i: int(x) for i, x in zip(by, draw.choice(centres[:3], len(by)) ^ (1 << draw.integers(0, 63, len(by))))}
    df = spark.createDataFrame([(f, i, second[i]) for i, f in by.items()], "fp long, first long, fp2 long")
    rule = simhash.Rule(width=1, most=most, beside=beside)
    got = {r.node: r.component for r in components(simhash.links(df, rule, limit)).collect()}
    expected = brute_components({i: f % 2**64 for i, f in by.items()}, most, {i: f % 2**64 for i, f in second.items()} if beside else None, beside[1] if beside else 64)
    assert {k: got.get(k, k) for k in by} == expected


def test_documents(spark):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [" ".join(draw.choices(vocabulary, k=150)) for _ in range(12)]
    rows = []
    for i in range(160):
        words = draw.choice(base).split()
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            words[draw.randrange(len(words))] = "x"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "Solo"), (904, "w1 " * 500), (905, "W1 " * 400)]
    docs = spark.createDataFrame([(i, t, "a", i) for i, t in rows] + [(1, rows[0][1], "b", 1), (None, rows[0][1], "b", 1)], "doc_id long, text string, fp string, component_id long")
    found = simhash.near_duplicates(docs).collect()
    expected = brute_components({i: brute_fingerprint(t) for i, t in rows})
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert r.component_id == expected[r.doc_id]
            assert r.fingerprint == f"{brute_fingerprint(dict(rows)[r.doc_id]):016x}"
        else:
            assert r.component_id is None and r.fingerprint == f"{brute_fingerprint(rows[0][1]):016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    from adjudica.llm.queries import op4_near_duplicates

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    expected = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in op4_near_duplicates(spark, d).collect()} == expected


def test_similar_texts_are_found(spark):
    """Of texts of a five-word similarity from 0.8 on most are linked; other texts, and the same words in another order, are not."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    shingles = lambda t: set(zip(*(t[i:] for i in range(5))))
    rows, wanted, kept_apart = [], [], []
    for i in range(300):
        words = draw.choices(vocabulary, k=200)
        near = list(words)
        for _ in range(draw.randint(1, 4)):
            near[draw.randrange(200)] = "changed"
        if (a := shingles(words)) and len(a & shingles(near)) >= 0.8 * len(a | shingles(near)):
            wanted.append((3 * i, 3 * i + 1))
        shuffled = draw.sample(words, 200)
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(shuffled))]
        kept_apart.append(3 * i + 2)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.SIMILAR).collect()}
    assert len(wanted) > 200 and sum(found[a] == found[b] for a, b in wanted) >= 0.85 * len(wanted)
    assert all(found[i] == i for i in kept_apart)
    assert {found[a] // 3 for a in found if a % 3 == 1} <= set(range(300)) and all(found[a] // 3 == a // 3 for a in found)
    with pytest.raises(ValueError):
        simhash.Rule(most=5)


def test_both_fingerprints_in_one_worker(spark):
    """Texts go to one Python worker a task, however many kinds of fingerprints a rule has."""
    docs = spark.createDataFrame([(1, "a B c d e f"), (2, None), (None, ""), (1, "x")], "doc_id long, text string")
    made = simhash.fingerprints(docs, simhash.SIMILAR)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    signed = lambda x: x - 2**64 if x >> 63 else x
    assert [tuple(r) for r in made.collect()] == [(r.doc_id, signed(simhash.fingerprint(r.text, 1, True)), signed(simhash.fingerprint(r.text, 5))) for r in docs.collect()]
    assert [tuple(r) for r in simhash.fingerprints(docs).collect()] == [(r.doc_id, signed(simhash.fingerprint(r.text))) for r in docs.collect()]


def test_small_tables_go_to_few_files(spark, monkeypatch):
    """However many shuffle partitions there are: for each file that it writes, Hadoop's local file system starts several processes."""
    from pyspark.sql import DataFrameWriter

    files, write = {}, DataFrameWriter.parquet

    def counted(self, path, *a, **b):
        write(self, path, *a, **b)
        files[re.sub(r"-\w+$", "", path.rsplit("/", 1)[1])] = len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*")))

    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choices(vocabulary, k=150) for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*base[i % 200][:-1], str(i // 200)])) for i in range(800)], "doc_id long, text string").repartition(4)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 800 and all(c % 200 == i % 200 for i, c in found.items()) and sum(i != c for i, c in found.items()) > 500
    assert {"adjudica-links", "adjudica-least", "adjudica-large", "adjudica-firsts", "adjudica-classes"} < set(files)
    assert all(n <= {"adjudica-marks": 4, "adjudica-met": 6}.get(name, 1) for name, n in files.items()), files
