"""Every registered query of the engine runs; those with DuckDB equivalents give the same rows. Table forms equal the kernels."""

import hashlib
import json

import pyarrow as pa
import pytest
from compare import compare
from pyspark.sql import functions as F

from adjudica.functions import decisions as fd
from adjudica.functions import text as ft
from adjudica.kernels import decide as kd
from adjudica.kernels import graph as kg
from adjudica.kernels import hdc
from adjudica.kernels.lexicon import Entry, Lexicon, overlap
from adjudica.kernels.rules import Rule, RuleClass, RuleSet, repairs_of
from adjudica.kernels.text import normalize
from adjudica.operators import decide, graphs, hypervectors, lexicon, rules, tokens
from adjudica.plans import delivery, registry
from adjudica.sources import confusables, journal
from adjudica.streaming.decide import counts_by_window, decide_stream

D = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    count, same, why = compare(spark, D, name, registry.queries()[name], ORACLES.get(name))
    assert count > 0 and same in (True, None), why


def test_gate_equals_kernel(spark):
    rows = [[a, b, c] for a in (0, 649, 650, 749, 750, 850, 1000) for b in (0, 600, 650, 750) for c in (0, 650)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, scores array<int>")
    for profile in ("fast", "standard", "deep"):
        for r in decide.decide(df, profile).collect():
            expected = kd.decide(rows[r.k], profile)
            assert r.answer.answer == expected["answer"] and [[x.option, x.confidence] for x in r.answer.ranked] == kd.ranked(rows[r.k])
            if r.answer.answer == "abstain":
                assert (r.answer.why.kind, r.answer.why.value) == (expected["why"]["kind"], expected["why"].get("top", expected["why"].get("margin")))


def test_arbitration_equals_kernel(spark):
    levels, weights = [800, 950, 300], [[1000, 200, 0], [300, 800, 400], [0, 0, 800]]
    rows = [([900, 950, 400], None), ([1000, 950, 400], 0), ([1000, 0, 1000], 2), ([0, 0, 0], 1)]
    df = spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(rows)], "k int, scores array<int>, held int")
    for r in decide.arbitrate(df, levels, weights, "held").collect():
        e = kd.arbitrate(rows[r.k][0], levels, weights, rows[r.k][1])
        assert (r.urges, r.dominant, r.persisted, r.bonus, r.winner_drive) == (e["urges"], e["dominant"], e["persisted"], e["bonus"], e["winner_drive"])


def test_arbitration_refuses_what_does_not_fit(spark):
    rows = spark.createDataFrame([([900, 100], 0)], "scores array<int>, held int")
    with pytest.raises(kd.ArbitrationError):
        decide.arbitrate(rows, [800, 900], [[1000, 200]])
    with pytest.raises(kd.ArbitrationError):
        decide.arbitrate(rows, [800, 900], [[1000, 200], [1, 2]], drives=["a", "a"])
    with pytest.raises(Exception, match="question mismatch"):
        decide.arbitrate(rows, [800], [[1000, 200, 5]]).collect()
    with pytest.raises(Exception, match="option out of range: 7"):
        decide.arbitrate(rows.withColumn("held", F.lit(7)), [800], [[1000, 200]], "held").collect()


def test_options(spark):
    with pytest.raises(Exception, match="duplicate candidate"):
        decide.candidate_options(spark.createDataFrame([("q", "a"), ("q", "a")], "q string, candidate string"), ["q"]).collect()
    with pytest.raises(Exception, match="out of range"):
        decide.dense(spark.createDataFrame([("q", 3, 1)], "q string, option int, c int"), ["q"], 3).collect()
    labels = spark.createDataFrame([("a",), (" a",), ("",), ("x" * 257,)], "l string")
    assert [r[0] for r in labels.select(fd.label_fault(F.col("l"))).collect()] == [None, "untrimmed", "empty", "too long"]
    one = spark.createDataFrame([("aé b", 1, 3)], "t string, s int, e int")
    assert one.select(fd.span_slice(F.col("t"), F.col("s"), F.col("e"))).first()[0] == "é"


def test_lexicon_tables(spark):
    texts = ["never `x` mind then", "stop the build. then never mind", "never. mind stop", "stpo canecl then", "kill it and cancel then", "never never mind", None, "", "st\u03bfp then"]
    terms = ["stop", "never mind", "never", "then", "cancel", "kill it and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lx = Lexicon([Entry(t, "x") for t in terms], ["step"], 100)
    got = sorted((r.doc, r.start, r.end, r.term, r.kind, r.edits, r.penalty) for r in lexicon.hits(docs, "id", "text", lx).collect())
    assert got == sorted((i, h.start, h.end, lx.entries[h.entry].term, h.kind, h.edits, h.penalty) for i, t in enumerate(texts) for h in lx.lookup(normalize(t or "")).hits)
    assert [(r.doc, r.term, r.kind) for r in lexicon.flags(docs, "id", "text", lx).collect()] == [(8, "stop", "MixedScript")]
    words = spark.createDataFrame([("stpo",), ("canecl",), ("step",), ("zzzzz",), ("stop",), ("stpo",), (None,), ("",)], "word string")
    assert {r.word: r.term for r in lexicon.repairs(words, lx).collect()} == {w: lx.entries[r[0]].term for w in ("stpo", "canecl", "step", "zzzzz") if (r := lx.repair(w))}
    pair = spark.createDataFrame([("The red fox", "red fox den"), ("a", "of it"), (None, "of it"), ("x", None)], "a string, b string")
    assert [r[0] for r in pair.select(ft.text_overlap(F.col("a"), F.col("b"))).collect()] == [overlap(normalize(a), normalize(b)) for a, b in (("The red fox", "red fox den"), ("a", "of it"), ("", "of it"), ("x", ""))]
    free = tokens.tokens(docs, "id", "text").filter("doc = 0").orderBy("pos").collect()
    assert [(r.pos, r.word) for r in free] == [(0, "never"), (2, "mind"), (3, "then")]


def test_overlaps_lose_no_pair(spark):
    import random

    draw = random.Random(3)
    letters = [f"w{i}" for i in range(40)]
    docs, items = ([(k, sorted({draw.choice(letters[: 5 + k % 36]) for _ in range(draw.randint(0, 12))})) for k in range(n)] for n in (60, 40))
    q, c = spark.createDataFrame(docs, "doc int, words array<string>"), spark.createDataFrame(items, "candidate int, words array<string>")
    for least in (1, 400, 550, 1000):
        expected = {(a, b): 1000 * len(set(x) & set(y)) // len(y) for a, x in docs for b, y in items if y and 1000 * len(set(x) & set(y)) // len(y) >= least}
        assert {(r.doc, r.candidate): r.c for r in lexicon.overlaps(q, c, least).collect()} == expected
    assert lexicon.overlaps(q.limit(0), c).count() == lexicon.overlaps(q, c.limit(0)).count() == 0


def test_rule_tables_equal_kernel(spark):
    c = delivery.classifier()
    texts = ["stop the build", "do not stop", "stop using it and cancel then", "wait no then stop", "stop it?", "stpo? yes", "no `a` kill it", None, "", "also and add rather"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = rules.matches(docs, "id", "text", c.rules, c.lexicon)
    got = {(r.doc, r.option): r.c for r in rules.class_scores(found, c.rules).collect()}
    scored = {r.doc: r.scores for r in rules.scored(docs, "id", "text", c.rules, c.lexicon).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert i not in scored
            continue
        n = normalize(t, c.config)
        assert scored[i] == c.rules.score(n, repairs_of(c.lexicon, c.lexicon.lookup(n))).scores == [got.get((i, k), 0) for k in range(3)]
    heavy = RuleSet([RuleClass("a"), RuleClass("b")], [Rule("r", "a", "stop", 800)])
    assert rules.scored(docs.filter("id = 4"), "id", "text", heavy).first().scores == [400, 0]
    assert rules.decisions(docs.filter("id = 0"), "id", "text", heavy).first().answer.option == 0


def test_no_shuffle_between_texts_and_matches(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for made in (lexicon.hits(docs, "doc_id", "text", registry.corpus_lexicon()), rules.matches(docs, "doc_id", "text", registry.corpus_rules()), tokens.tokens(docs, "doc_id", "text")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_token_digests_make_tokens_once_and_where_texts_lie(spark):
    # tokens of 10,000 texts at a time, made twice and gathered by text, took an executor's memory on 0.1 GB of documents
    for name in ("tokens_documents", "tokens_messages"):
        plan = registry.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Generate" not in plan and "Aggregate" not in plan
    words = pa.array(["a" * 10] * 7 + [None, "", "b" * 1000, "c", "d"])
    parts = list(ft._slices(words, 30))
    assert pa.concat_arrays(parts).equals(words) and [len(p) for p in parts] == [3, 3, 3, 1, 2]
    assert list(ft._slices(words[:0])) == []


def test_token_digests_of_repeated_keys(spark):
    texts = [(1, "a b. c"), (1, "d e"), (2, "f `g`"), (None, "h"), (None, "i"), (3, ""), (4, None), (5, "...")]
    rows = registry._token_digests(spark.createDataFrame(texts, "doc_id long, text string"), {}, "doc_id").collect()
    said = {1: ["0 a 0 1 0 - - -", "0 d 0 1 0 - - -", "1 b 2 3 0 - - -", "1 e 2 3 0 - - -", "2 c 5 6 1 - - -"], 2: ["0 f 0 1 0 - - -", "1 g 3 4 inline_code - -"], None: ["0 h 0 1 0 - - -", "0 i 0 1 0 - - -"]}
    digest = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    assert {r.doc: (r.n, r.zoned, r.confusable, r.tokens_sha256) for r in rows} == {k: (len(v), sum("code" in x for x in v), 0, digest(v)) for k, v in said.items()}
    assert len(rows) == 3


def test_null_inputs(spark):
    one = spark.createDataFrame([(None, 1), ("a b", None), ("a b", 2)], "t string, s int")
    assert [r[0] for r in one.select(ft.to_original(F.col("t"), F.col("s"), F.col("s"))).collect()][:2] == [None, None]
    v = one.select(hypervectors.seed(F.col("t"), "n").alias("s"), hypervectors.encode(F.col("t"), "n").alias("v")).withColumn("p", hypervectors.permute(F.col("v"), 3)).collect()
    assert (v[0].s, v[0].v, v[0].p) == (None, None, None) and len(v[1].p) == 16 and v[1].v == v[2].v
    assert [r[0] is None for r in one.select(graphs.label_of(F.col("t"))).collect()] == [True, False, False]
    assert journal.lines(one.withColumn("d", F.lit(None).cast("string")), F.col("t"), F.col("t"), F.col("d")).count() == 0
    assert one.select(ft.normalized(F.col("t"))["canonical"]).collect()[0][0] is None


def test_hypervectors_equal_kernel(spark):
    df = spark.createDataFrame([("k", f"s{i}", i % 3 - 1) for i in range(20)], "k string, s string, w int").withColumn("vector", hypervectors.encode(F.col("s"), "t"))
    book = hdc.encode([hdc.seed("t", f"s{i}") for i in range(20)])
    assert hypervectors.sums(df, ["k"], weight="w").first().sums == hdc.accumulate(book, [i % 3 - 1 for i in range(20)]).tolist()
    assert hypervectors.bundle(df, ["k"]).first().vector == hdc.bundle(book).view("i8").tolist()
    near = hypervectors.nearest(df.select("s", "vector"), df.select(F.col("s").alias("id"), "vector").filter("id < 's15'"), "s").collect()
    ids = sorted(f"s{i}" for i in range(20) if f"s{i}" < "s15")
    for r in near:
        i, sim, margin = hdc.nearest(book[int(r.s[1:])], book[[int(x[1:]) for x in ids]])
        assert (r.id, r.similarity, r.margin) == (ids[i], sim, margin)
    hypervectors.BLOCK = 4
    again = hypervectors.nearest(df.select("s", "vector"), df.select(F.col("s").alias("id"), "vector").filter("id < 's15'"), "s").collect()
    hypervectors.BLOCK = 4096
    assert sorted(near) == sorted(again)
    assert df.select(hypervectors.permute(F.col("vector"), 70).alias("p")).first().p == hdc.permute(book[0], 70).view("i8").tolist()
    assert df.select(fd.component(F.col("vector"), 5, 1024)).first()[0] == hdc.signs(book[0])[5]


def test_codebooks(spark):
    book = spark.createDataFrame([("b", "x"), ("a", "y")], "id string, s string").withColumn("vector", hypervectors.encode(F.col("s"), "t"))
    assert [(r.idx, r.id) for r in hypervectors.codebook(book).orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(hdc.CodebookError):
        hypervectors.codebook(book.limit(0))
    with pytest.raises(Exception, match="duplicate codebook id a"):
        hypervectors.codebook(book.unionAll(book.filter("id = 'a'"))).collect()
    with pytest.raises(Exception, match="empty codebook id"):
        hypervectors.codebook(book.withColumn("id", F.lit(""))).collect()
    assert hypervectors.nearest(book.select("id", "vector"), book.limit(0).select("id", "vector"), "id").count() == 0


def test_a_long_path_is_refined_to_the_end(spark):
    n = 150  # classes only stop splitting after half as many rounds
    nodes = spark.range(n).select(F.col("id").alias("v"), F.lit(0).alias("label"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(None).cast("long").alias("label"), F.lit(False).alias("directed"))
    colours = graphs.refine(nodes.coalesce(1), graphs.adjacency(edges).coalesce(1), None)
    assert colours.select("colour").distinct().count() == n // 2
    print_of = graphs.fingerprint(colours).first()
    assert (print_of.classes, print_of.nodes) == (n // 2, n)
    moved = graphs.refine(nodes.withColumn("v", n - F.col("v")), graphs.adjacency(edges.withColumn("a", n - F.col("a")).withColumn("b", n - F.col("b"))), 3)
    assert graphs.fingerprint(moved).first() == graphs.fingerprint(graphs.refine(nodes, graphs.adjacency(edges), 3)).first()


def test_graph_partition_equals_kernel(spark):
    edges = [(0, 1, None, False), (1, 2, None, False), (2, 3, 7, True), (3, 4, None, False), (5, 5, None, False), (4, 0, None, True)]
    graph = kg.Graph()
    for v in range(8):
        graph.add_node(v % 2)
    for e in edges:
        graph.add_edge(*e)
    nodes, table = spark.createDataFrame([(v, v % 2) for v in range(8)], "v long, label long"), spark.createDataFrame(edges, "a long, b long, label long, directed boolean")
    for rounds in (1, 3, None):
        colours = kg.wl_refine(graph, rounds).colours
        expected = {v: colours.index(c) for v, c in enumerate(colours)}
        assert {r.v: r["class"] for r in graphs.partition(graphs.refine(nodes, graphs.adjacency(table), rounds)).collect()} == expected
    each = graphs.refine_each(nodes.withColumn("g", F.lit(1)), table.withColumn("g", F.lit(1)), hash="blake3").first()
    assert each.fingerprint == kg.wl_refine(graph).fingerprint()


def test_journal(spark, tmp_path):
    c = delivery.classifier()
    messages = spark.createDataFrame([("stop the build", "standard"), ("héllo \"x\"", "fast"), ("stpo", "deep")], "message string, profile string")
    made = messages.withColumn("d", ft.classified(F.col("message"), c, F.col("profile")))
    journal.write(journal.lines(made, F.col("message"), F.col("profile"), F.col("d.json")), str(tmp_path / "j"))
    read = journal.read(spark, str(tmp_path / "j"))
    assert all(r.error is None and r.check.same for r in journal.check(read, c).collect())
    changed = delivery.classifier("ignore")
    assert all(not r.check.same and r.check.data_version and not r.check.answer for r in journal.check(read, changed).collect())
    assert "counted interrupt" in "".join(r[0] for r in read.select(journal.trail_text(F.col("decision"))).collect())
    bad = spark.createDataFrame([("{",)], "value string")
    assert journal.parsed(bad).first().error == "deserialize"
    assert json.loads(made.first().d.json)["answer"]["option"] == 2


def test_look_alikes_from_the_jvm(spark):
    table = confusables.skeletons(spark)
    assert table["ѕ"] == "s" and table["m"] == "rn"
    assert delivery.classifier(skeletons=table).decide("ѕtop the build")["answer"]["why"]["kind"] == "confusable"


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("stop the build", "2026-01-01 00:01:00"), ("stop it", "2026-01-01 00:02:00"), ("hello", "2026-01-01 00:07:00"), ("stop", "2026-01-01 01:00:00")]
    spark.createDataFrame(rows, "text string, at string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, at timestamp").json(str(tmp_path / "in"))
    counted = counts_by_window(decide_stream(stream, delivery.classifier()), "at")
    q = counted.writeStream.format("memory").outputMode("append").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    # the last window is still open: the watermark is ten minutes behind
    assert sorted((str(r.window.start), r.label, r.n) for r in spark.table("windows").collect()) == [("2026-01-01 00:00:00", "interrupt", 2), ("2026-01-01 00:05:00", None, 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("stop the build",), ("hello",)], "text string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    stream = decide_stream(spark.readStream.schema("text string").json(str(tmp_path / "in")), delivery.classifier()).select("text", "decision.label")
    q = stream.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.text: r.label for r in spark.table("decided").collect()} == {"stop the build": "interrupt", "hello": None}


def test_specification_files(spark, tmp_path):
    from adjudica.sources.specs import load_classifier

    entries = "".join(f'[[entries]]\nterm = "{t}"\ntag = "{tag}"\n' for tag, ts in delivery.TERMS.items() for t in ts)
    (tmp_path / "l.toml").write_text(f'guards = {json.dumps(delivery.GUARDS)}\nrepair = {{ mode = "typos", penalty_per_edit = 150 }}\n{entries}')
    cues = [{"id": i, "class": c, "pattern": p, "weight_millis": w, "forbids": ["negation"], "version": 1} for i, c, p, w in delivery.CUES]
    (tmp_path / "r.json").write_text(json.dumps({"negators": delivery.NEGATORS, "negation_window": 3, "classes": [{"name": c, "scorer": "max"} for c in ("queue", "steer", "interrupt")], "rules": cues}))
    assert (delivery.rules_file()["rules"], delivery.rules_file()["negators"]) == (cues, delivery.NEGATORS)
    made = load_classifier(spark, str(tmp_path / "l.toml"), str(tmp_path / "r.json"), "pua-steer/1", "delivery", delivery.classifier().config)
    assert made.data_version == delivery.classifier().data_version


def test_registered_queries_know_all_look_alikes(spark, tmp_path):
    texts = ["also add tests, sto\u03c1", "stop the build"]
    spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = {r.id: r for r in registry.queries()["classifier_decide"](spark, str(tmp_path)).collect()}
    assert made[0].why == "confusable" and made[100].why != "confusable"
    assert {r.id: r.flags.count(":") for r in registry.queries()["lexicon_lookup"](spark, str(tmp_path)).collect()} == {0: 3, 100: 0}
    assert {(r.error, r.same) for r in registry.queries()["journal_round_trip"](spark, str(tmp_path)).collect()} == {(None, True), ("schema_mismatch", None)}
