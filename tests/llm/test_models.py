"""Language and quality on held-out rows, and their corner cases."""

import zlib

import numpy as np

from adjudica.llm import langid, quality
from adjudica.llm.queries import op6_language, op7_quality

D = "/root/testdata/sf0.01"


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = op6_language(spark, D).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) >= 0.97
    assert np.mean([r.reliable for r in tested]) >= 0.97


def test_language_corner_cases(spark):
    labelled = spark.createDataFrame([("the cat and the hat " * 20, "en"), ("der hund und die katze " * 20, "de"), (None, "fr"), ("x", None), ("", "fr")], "text string, lang string")
    dictionaries = langid.fit(labelled)
    assert sorted(dictionaries) == ["de", "en"]
    docs = spark.createDataFrame([(1, "und der hund", 1), (2, None, 1), (3, "", 1), (4, "123 !?", 1), (5, "the hat and the cat " * 5000, 1), (5, "the cat", 1), (None, "the cat", 1)], "doc_id long, text string, score int")
    found = {(r.doc_id, len(r.text or "")): r for r in langid.identified(docs, dictionaries).collect()}
    assert len(found) == 7 and found[1, 12].lang_pred == "de" and found[5, 100000].lang_pred == "en"
    for i in (2, 3, 4):
        r = next(r for k, r in found.items() if k[0] == i)
        assert (r.lang_pred, r.score, r.reliable) == ("und", 0.0, False)
    assert langid.fit(labelled.limit(0)) == {}
    assert langid.Identifier({}).identify("abc") == ("und", 0.0)


def test_quality_on_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = op7_quality(spark, D).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in tested]) >= 0.95


def test_tables_add_up():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)  # only a pair tells
    model = quality.train(x, y, pairs=2)
    assert any(p[:2] == (0, 1) for p in model.pairs)
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    one = model.base + sum(t[np.searchsorted(e, x[7, f])] for f, (e, t) in enumerate(zip(model.edges, model.tables))) + sum(t[np.searchsorted(a, x[7, f]), np.searchsorted(b, x[7, g])] for f, g, a, b, t in model.pairs)
    assert np.isclose(model.score(x)[7], 1 / (1 + np.exp(-one)))


def test_quality_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a" * 200_000, 1), (3, "b", 1), (None, "c d", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, text int")
    model = quality.fit(docs, labels)
    assert len(model.tables) == len(quality.FEATURES)
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).collect())
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, empty).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_copies_take_one_place_of_the_language_sample(spark):
    from adjudica.llm import langid

    texts = [f"text number {i} " * 20 for i in range(12)]
    copies = [(i, t, "en") for i, t in enumerate(t for t in texts for _ in range(30))]
    found = langid.fit(spark.createDataFrame(copies, "doc_id long, text string, lang string"), rows=12)
    assert sorted(found["en"].decode().split("\n")) == sorted(texts)


def test_language_equals_brute_force(spark):
    import xxhash
    import zstandard

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    sample = {}
    for r in docs:
        if r.lang is not None and r.text and not held(r.doc_id, 3, 1):
            h = xxhash.xxh64_intdigest(r.text.encode(), seed=42)
            sample.setdefault(r.lang, set()).add((not 200 <= len(r.text) <= 4096, h - 2**64 if h >= 2**63 else h, r.text[:4096]))
    content = {k: "\n".join(t for *_, t in reversed(sorted(v)[:96])).lower().encode()[-65536:] for k, v in sample.items()}
    search = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, **langid.Identifier.SEARCH)

    def size(lang, raw):
        held_by = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held_by.precompute_compress(compression_params=search)
        coder = zstandard.ZstdCompressor(compression_params=search, dict_data=held_by)
        if len(raw) < 256:
            return max(1, len(coder.compress(content[lang][-512:] + raw)) - len(coder.compress(content[lang][-512:])))
        return sum(len(coder.compress(raw[s : s + 1024])) for s in range(0, len(raw), 1024))

    made = {r.doc_id: r for r in op6_language(spark, d).collect()}
    assert len(made) == len(docs)
    for r in docs:
        if not any(c.isalpha() for c in r.text or ""):
            assert (made[r.doc_id].lang_pred, made[r.doc_id].score) == ("und", 0.0)
            continue
        (a, lang), (b, _) = sorted((size(k, r.text.lower().encode()), k) for k in content)[:2]
        m = (b - a) / a
        assert made[r.doc_id].lang_pred == lang and np.isclose(made[r.doc_id].score, m / (m + 0.02)) and made[r.doc_id].reliable == (made[r.doc_id].score >= 0.2)


def naive_features(text):
    """The features by their definitions, a character or word at a time."""
    import math

    import zstandard

    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, size, pairs, sentences = max(1, len(words)), max(1, len(raw)), [(a, b) for a, b in zip(words, words[1:])], text.split(".")
    marks = lambda f: sum(1 for b in raw if f(chr(b)) and b < 128) / size
    return [
        math.log(1 + len(text)), math.log(1 + len(words)), sum(len(w) for w in words) / n, len(set(words)) / n, max([words.count(w) for w in set(words)], default=0) / n, (len(set(pairs)) + 1) / n,
        marks(lambda c: "!" <= c <= "~" and not c.isalnum()), marks(str.isdigit), marks(str.isupper), text.count(",") / n, text.count(".") / n, math.log(len(lines)), max(1, len(text)) / len(lines), len(set(lines)) / len(lines), len(set(sentences)) / len(sentences), text.count("|") / n,
        sum(len(w) < 4 for w in words) / n, max([len(w) for w in words], default=0), len(zstandard.ZstdCompressor(level=1).compress(raw)) / size, marks(lambda c: c in "#*%&$@~^|<>{}[]\\=+_"),
    ]


def test_quality_equals_brute_force(spark):
    """Features by their definitions, and scores by looking tables up one at a time, for every row of the query."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    taught = sorted(i for i, y in labels.items() if i in docs and y in (0, 1) and not held(i, 4, 2))
    x = {i: naive_features(t or "") for i, t in docs.items()}
    model = quality.train(np.array([x[i] for i in taught]), np.array([labels[i] for i in taught], dtype=float))
    bin_of = lambda ends, v: sum(v > e for e in ends)
    made = {r.doc_id: r for r in op7_quality(spark, d).collect()}
    assert made.keys() == docs.keys()
    for i in docs:
        total = model.base + sum(t[bin_of(e, x[i][f])] for f, (e, t) in enumerate(zip(model.edges, model.tables))) + sum(t[bin_of(a, x[i][f]), bin_of(b, x[i][g])] for f, g, a, b, t in model.pairs)
        score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        assert np.isclose(made[i].score, score, atol=1e-9) and (made[i].predicted == (score >= 0.7) or np.isclose(score, 0.7))
