"""The pipeline, stage by stage, against plain Python over the same rows."""

import re

import numpy as np
from pyspark.sql import functions as F
from test_packing import check
from test_simhash import brute_components

import corpus_pipeline
from adjudica.llm import langid, quality, simhash
from adjudica.llm.queries import remainder

D = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["quality"](spark, docs, D).cache()
    assert kept.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet").filter(remainder(4) != 2))
    ids = sorted(before)
    scores = model.score(np.array([quality.features(before[i]) for i in ids]))
    assert {r.doc_id for r in kept.collect()} == {i for i, s in zip(ids, scores) if s >= 0.7}
    assert np.mean([(i in {r.doc_id for r in kept.collect()}) == y for i, y in labels.items()]) > 0.9

    told = stages["language"](spark, kept, D).cache()
    dictionaries = langid.fit(kept.filter(remainder(3) != 1))
    known = langid.Identifier(dictionaries)
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in kept.collect() if known.identify(r.text)[1] >= 0.2}

    once = stages["near_duplicates"](spark, told, D).cache()
    texts = {r.doc_id: r.text for r in told.collect()}
    mark = lambda t, width, distinct: simhash.fingerprint(t, width, distinct)
    rule = simhash.SIMILAR
    root = brute_components({i: mark(t, rule.width, rule.distinct) for i, t in texts.items()}, rule.most, {i: mark(t, rule.beside[0], False) for i, t in texts.items()}, rule.beside[1])
    assert sorted(r.doc_id for r in once.collect()) == sorted({root[i] for i in texts})

    clean = stages["secrets"](spark, once, D).cache()
    assert clean.columns == columns
    for r in clean.collect():
        assert not re.search(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) and r.n_chars == len(r.text)
        assert "[secret]" in r.text or r.text == texts[r.doc_id]
    check(stages["packing"](spark, clean, D).collect(), [(r.doc_id, r.text) for r in clean.collect()], 2048)


def test_first_stages_on_corner_cases(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables in the two stages that learn from the table."""
    prose = spark.read.parquet(f"{D}/documents.parquet").filter("n_chars between 200 and 4000").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, "the cat and the hat. " * 20, "en", None, 5), (90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "12 34", None, "s", 5), (90004, "le chat est dans la maison. " * 20_000, None, "s", 1)]
    docs = prose.unionAll(spark.createDataFrame(odd + odd[-1:], prose.schema)).withColumns({"score": F.lit("x"), "predicted": F.lit(1.5), "lang_pred": F.lit(None).cast("string"), "quality": F.lit(7)})
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_language):
        kept = stage(spark, docs, D)
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), D).count() == 0
        rows = kept.collect()
        assert {r.score for r in rows} == {"x"} and sum(r.doc_id == 90004 for r in rows) in (0, 2)
        if stage is corpus_pipeline.keep_language:
            ids = {r.doc_id for r in rows}
            assert not ids & {90001, 90002, 90003} and 90004 in ids


def test_corner_cases(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", None), (None, "the cat and the hat. " * 20, "en", None, 5), (3, "the cat and the hat. " * 20, "en", "s", 1), (3, "the cat and the hat. " * 20, "en", "s", 1), (4, "der hund und die katze. " * 3000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[2:]:
            out = stage(spark, out, D)
        pieces = out.collect()
        assert bool(pieces) == (table is docs)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, D).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, None)]


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())


def test_language_stage_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(i, "the cat and the hat. " * 20, None) for i in range(9)], "doc_id long, text string, lang string")
    assert corpus_pipeline.keep_language(spark, docs, D).count() == 9
