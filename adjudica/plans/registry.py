"""The registered queries, each over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..functions import text as t
from ..kernels import hdc
from ..kernels.classifier import rules_spec
from ..kernels.decide import RECORDED_UNICODE, profile_table
from ..kernels.lexicon import Entry, Lexicon
from ..kernels.rules import Rule, RuleClass, RuleSet
from ..kernels.text import MAX_INPUT_BYTES, Config
from ..operators import decide, graphs, hypervectors, lexicon, rules, tokens
from ..sources import confusables, journal
from ..sources.staging import dealt, staged
from . import delivery, oracles, recorded, structure_oracles, text_oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EVENT_TYPES = 5


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- gate -------------------------------------------------------------------------------------------------------------


def _event_evidence(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    """(user_id, option, c): how often each event type, in byte order, occurs to a user, in thousandths of the most frequent or of all."""
    events = table(spark, sf_dir, "events")
    # a question's options are few: they are numbered in one task
    options = decide.candidate_options(events.select("event_type").distinct(), [], "event_type")
    n = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("user_id").agg((F.max("n") if of == "max" else F.sum("n")).alias("whole"))
    return n.join(whole, "user_id").join(F.broadcast(options), "event_type").select("user_id", "option", F.expr("cast(1000 * n div whole as int)").alias("c"))


def _gate(spark: SparkSession, sf_dir: str, profile: str, of: str = "max") -> DataFrame:
    scored = decide.dense(decide.score(_event_evidence(spark, sf_dir, of), ["user_id"]), ["user_id"], EVENT_TYPES)
    return decide.flat(decide.decide(scored, profile))


@query
def gate_fast(spark, sf_dir):
    return _gate(spark, sf_dir, "fast")


@query
def gate_standard(spark, sf_dir):
    return _gate(spark, sf_dir, "standard")


@query
def gate_deep(spark, sf_dir):
    return _gate(spark, sf_dir, "deep")


@query
def gate_low_confidence(spark, sf_dir):
    return _gate(spark, sf_dir, "deep", "sum")


@query
def noul_gate(spark, sf_dir):
    """Yes or no per customer: is most of what they ordered urgent?"""
    orders = table(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    n = orders.groupBy("o_custkey").agg(F.sum(urgent).alias("yes"), F.count("*").alias("n"))
    scored = n.select("o_custkey", F.array(F.expr("cast(1000 * (n - yes) div n as int)"), F.expr("cast(1000 * yes div n as int)")).alias("scores"))
    return decide.flat(decide.decide(scored, "deep", "noul"))


@query
def score_gate(spark, sf_dir):
    """A priority level per customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("option"))
    n = orders.groupBy("o_custkey", "option").agg(F.count("*").alias("n"))
    most = n.groupBy("o_custkey").agg(F.max("n").alias("most"))
    scored = n.join(most, "o_custkey").select("o_custkey", "option", F.expr("cast(1000 * n div most as int)").alias("c"))
    return decide.flat(decide.decide(decide.dense(scored, ["o_custkey"], 5), "standard", "score"))


@query
def sum_scorer(spark, sf_dir):
    """Saturating sums of evidence, less a penalty for each error event."""
    events = table(spark, sf_dir, "events")
    evidence = events.select("user_id", F.pmod("event_id", F.lit(4)).cast("int").alias("option"), F.lit(40).alias("c"))
    summed = decide.score(evidence, ["user_id"], scorer="sum")
    off = events.filter("event_id % 10 = 0").select("user_id", F.pmod("event_id", F.lit(4)).cast("int").alias("option"), F.lit(25).alias("c"))
    return decide.subtract(summed, off, ["user_id"])


@query
def raise_to(spark, sf_dir):
    """The strongest evidence per user and option."""
    events = table(spark, sf_dir, "events")
    evidence = events.select("user_id", F.pmod("event_id", F.lit(4)).cast("int").alias("option"), F.floor(F.col("value")).cast("int").alias("c"))
    return decide.score(evidence, ["user_id"])


@query
def candidate_chosen(spark, sf_dir):
    """For each customer, the order status that stands out among all of theirs."""
    orders = table(spark, sf_dir, "orders")
    n = orders.groupBy("o_custkey", F.col("o_orderstatus").alias("candidate")).agg(F.count("*").alias("n"))
    most = n.groupBy("o_custkey").agg(F.max("n").alias("most"))
    return decide.choose(n.join(most, "o_custkey").select("o_custkey", "candidate", F.expr("cast(1000 * n div most as int)").alias("c")), ["o_custkey"])


# --- arbitration ------------------------------------------------------------------------------------------------------

LEVELS, WEIGHTS = [800, 1000, 300], [[1000, 200, 0, 500, 100], [100, 950, 1000, 300, 0], [0, 0, 900, 1000, 1000]]


def _arbitrated(spark, sf_dir, incumbent):
    scored = decide.dense(_event_evidence(spark, sf_dir, "max"), ["user_id"], EVENT_TYPES)
    if incumbent:
        scored = scored.withColumn("incumbent", F.pmod("user_id", F.lit(EVENT_TYPES)).cast("int"))
    out = decide.arbitrate(scored, LEVELS, WEIGHTS, "incumbent" if incumbent else None)
    a = F.col("answer")
    return out.select("user_id", F.array_join("urges", ",").alias("urges"), F.array_join("dominant", ",", "-").alias("dominant"), "persisted", "bonus", a["answer"].alias("answer"), a["option"].alias("option"), a["confidence"].alias("confidence"), "winner_drive")


@query
def arbitrate(spark, sf_dir):
    return _arbitrated(spark, sf_dir, False)


@query
def arbitrate_incumbent(spark, sf_dir):
    return _arbitrated(spark, sf_dir, True)


DRIVES = ["haste", "care", "thrift"]


@query
def arbitration_trail(spark, sf_dir):
    """What the records of each user's arbitration say."""
    scored = decide.dense(_event_evidence(spark, sf_dir, "max"), ["user_id"], EVENT_TYPES).withColumn("incumbent", F.pmod("user_id", F.lit(EVENT_TYPES)).cast("int"))
    made = decide.arbitrate(scored, LEVELS, WEIGHTS, "incumbent", drives=DRIVES)
    return decide.arbitration_trail(made, ["user_id"], [f"option {i}" for i in range(EVENT_TYPES)], DRIVES)


# --- values -----------------------------------------------------------------------------------------------------------


@query
def bounded_values(spark, sf_dir):
    """Similarities and confidences of numbers within and beyond their bounds."""
    x = (F.pmod("event_id", F.lit(4001)) - 2000).cast("int")
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    c = d.confidence(F.col("x"))
    return e.select("event_id", d.millis(F.col("x")).alias("millis"), c.alias("confidence"), d.halved(c).alias("halved"), d.confidence(c + 700).alias("added"), d.confidence(c - 700).alias("taken"), d.valid_confidence(F.col("x")).alias("valid"), d.quotient(F.col("x"), F.lit(7)).alias("seventh"))


@query
def span_values(spark, sf_dir):
    """Spans of bytes, whether they are proper, and how they lie to one another."""
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", span(k % 11, k % 17).alias("a"), span(k % 7, k % 7 + k % 5).alias("b"))
    fault = d.span_fault(F.col("a.start"), F.col("a.end"))
    cut = d.span_slice(F.regexp_replace("text", "[^\\x00-\\x7f]", "~"), F.col("b.start"), F.col("b.end"))
    return docs.select("doc_id", fault.alias("fault"), d.span_text(F.col("b")).alias("shown"), cut.alias("cut"), d.spans_overlap(F.col("a"), F.col("b")).alias("overlap"), d.span_contains(F.col("a"), F.col("b")).alias("contains"), d.span_text(d.span_cover(F.col("a"), F.col("b"))).alias("cover"))


@query
def label_values(spark, sf_dir):
    """Labels of parts, some of them empty, untrimmed or too long, and why those are refused."""
    k, name = F.col("p_partkey"), F.col("p_name")
    label = F.when(k % 7 == 0, F.concat(name, F.lit(" "))).when(k % 7 == 1, F.lit("  ")).when(k % 7 == 2, F.repeat(name, 20)).when(k % 7 == 3, F.lit(None).cast("string")).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", d.label_fault(label).alias("fault"))


@query
def profile_thresholds(spark, sf_dir):
    """Each profile's thresholds, as the expressions have them."""
    names = spark.createDataFrame([(n,) for n in ("fast", "standard", "deep")], "profile string")
    return names.select("profile", d.least_confidence(F.col("profile")).alias("least"), d.least_margin(F.col("profile")).alias("margin"))


@query
def option_numbers(spark, sf_dir):
    """Each customer's order statuses as numbered options."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("candidate")).distinct()
    return decide.candidate_options(orders, ["o_custkey"])


@query
def abstentions(spark, sf_dir):
    """What each user's answer is, whether it abstains, and why, in words."""
    made = decide.decide(decide.dense(_event_evidence(spark, sf_dir, "max"), ["user_id"], EVENT_TYPES), "standard")
    a = F.col("answer")
    return made.select("user_id", d.is_abstain(a).alias("abstains"), d.chosen(a).alias("chosen"), d.reason_text(a["why"]).alias("reason"), F.size(a["ranked"]).alias("options"))


# --- text -------------------------------------------------------------------------------------------------------------

#: What is put before conversations' texts, so that messages have cues, typos, questions, negations, spans and look-alikes.
CUES = [
    "Stop the build.", "stpo now, please!!", "do not stop.", "stop using it and cancel then", "should I stop?", "never mind, also add tests.", 'run "stop" then', "use `cancel` instead?", "st\u03bfp the build", "see https://a.b/c?x=stop, rather.",
    "change to v1.2.3 after that!", "no need to kill ./src/stop.py, aborrt it", "canecl teh job. halt? no", "e\u0301tat: stop", "wait no... actually switch to rust", "collateral afterwads  (then)", "when you're done, and add", "\u201cstop\u201d forget it", "```\nstop\n``` next", "don't c\u0430ncel, halt", "ratehr instaed; nevr mind?", "Is it next? Then halt!",
]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): conversations' turns, each after a cue."""
    turns = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    cue = F.element_at(F.array(*map(F.lit, CUES)), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(CUES))) + 1).cast("int"))
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(cue, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _digest(rows, order: str = "pos"):
    """SHA-256 of a document's rows, given as text, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, rows.alias("row")))), lambda x: x["row"]), "\n"), 256)


@query
def canonical_turns(spark, sf_dir):
    return dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", t.canonical(F.col("text")).alias("canonical"))


def _summarised(docs: DataFrame, key: str, collapse: bool) -> DataFrame:
    n = dealt(docs).select(key, t.summary(F.col("text"), Config(punct="collapse" if collapse else "keep")).alias("n"))
    kinds = F.array_join(F.transform("n.protected", lambda p: F.concat_ws(":", p["kind"], p["span"]["start"], p["span"]["end"])), ",")
    return n.select(key, F.sha2("n.canonical", 256).alias("canonical_sha256"), "n.n_tokens", "n.sentences", kinds.alias("protected"))


@query
def canonical_documents(spark, sf_dir):
    """Canonical texts with runs of marks as one, and what they hold."""
    return _summarised(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", True)


@query
def canonical_messages(spark, sf_dir):
    """As canonical_documents, of texts with all kinds of protected spans, runs of marks kept."""
    return _summarised(messages(spark, sf_dir), "id", False)


@query
def canonical_decomposed(spark, sf_dir):
    """Texts whose accented letters are written as two characters: their canonical form has one, and its spans lead to both."""
    split = F.lower("text")
    for whole, parts in DECOMPOSED:
        split = F.replace(split, F.lit(whole), F.lit(parts))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", split.alias("text"))
    made = turns.select("conv_id", "turn", "text", t.normalized(F.col("text")).alias("n"))
    letters = F.array_join(F.transform("n.tokens", lambda x: d.span_slice(F.col("text"), x["span"]["start"], x["span"]["end"])), " ")
    return made.select("conv_id", "turn", "n.canonical", F.sha2(letters, 256).alias("originals_sha256"))


#: Letters of the test texts, as one character and as two.
DECOMPOSED = [(c, unicodedata.normalize("NFD", c)) for c in "\u00e9\u00e8\u00ea\u00e7\u00e4\u00fc\u00f6\u00f3\u00f1\u00ed"]


@query
def to_original_turns(spark, sf_dir):
    """The original bytes of the canonical bytes from 10 to 40 of each turn; ends within a character move outward."""
    turns = table(spark, sf_dir, "conversations").filter(F.length("text") > 60)
    span = t.to_original(F.col("text"), F.lit(10), F.lit(40))
    return turns.select("conv_id", "turn", span.alias("s")).select("conv_id", "turn", F.col("s.start").alias("first"), F.col("s.end").alias("last"))


@query
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.sentence_count(t.canonical(F.col("text"))).alias("sentences"))


@query
def protected_urls(spark, sf_dir):
    n = table(spark, sf_dir, "pages").select("page_id", t.normalized(F.col("url")).alias("n"))
    return n.select("page_id", F.transform("n.protected", lambda p: p["kind"])[0].alias("kind"), F.size("n.protected").alias("n"))


def _token_row(x) -> Column:
    marks = (F.coalesce(x[c], F.lit("-")) for c in ("zone", "confusable", "skeleton"))
    return F.concat_ws(" ", x["pos"], x["text"], x["span"]["start"], x["span"]["end"], F.when(x["zone"].isNull(), x["sentence"]), *marks)


def _token_digests(docs: DataFrame, skeletons: dict[str, str], key: str) -> DataFrame:
    """A row's tokens are put together where its text lies; only rows whose key repeats are gathered by it."""
    config = Config(punct="collapse")
    repeated = docs.groupBy(F.col(key).alias("again")).count().filter("count > 1").select("again")
    some = not repeated.isEmpty()
    again = F.col(key).eqNullSafe(F.col("again"))
    single = docs.join(repeated, again, "left_anti") if some else docs
    made = tokens.token_lists(dealt(single), key, "text", config, skeletons).filter(F.size("tokens") > 0)
    known = lambda c: F.size(F.filter("tokens", lambda x: x[c].isNotNull())).cast("long").alias(c)
    digest = F.sha2(F.array_join(F.transform("tokens", _token_row), "\n"), 256)
    found = made.select("doc", F.size("tokens").cast("long").alias("n"), known("zone").alias("zoned"), known("confusable"), digest.alias("tokens_sha256"))
    if not some:
        return found
    t = tokens.token_lists(docs.join(repeated, again, "left_semi"), key, "text", config, skeletons).select("doc", F.explode("tokens").alias("t")).select("doc", "t.*", _token_row(F.col("t")).alias("said"))
    return found.unionByName(t.groupBy("doc").agg(F.count("*").alias("n"), F.count("zone").alias("zoned"), F.count("confusable").alias("confusable"), _digest(F.col("said")).alias("tokens_sha256")))


@query
def tokens_documents(spark, sf_dir):
    """Every token of every document: word, bytes of the original, sentence, zone."""
    return _token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), confusables.skeletons(spark), "doc_id")


@query
def tokens_messages(spark, sf_dir):
    """The same of messages, with look-alikes and their skeletons."""
    return _token_digests(messages(spark, sf_dir), confusables.skeletons(spark), "id")


@query
def refused_inputs(spark, sf_dir):
    """Texts around 16 MiB: those beyond are refused whole, and decided as such."""
    sized = table(spark, sf_dir, "region").select("r_regionkey", F.repeat(F.lit("x"), (F.lit(MAX_INPUT_BYTES - 2) + F.col("r_regionkey")).cast("int")).alias("text")).withColumn("refused", t.refused(F.col("text")))
    answer = t.classified(F.when(F.col("refused"), F.col("text")).otherwise(""), delivery.classifier(), F.lit("fast"))
    return sized.select("r_regionkey", F.octet_length("text").alias("bytes"), "refused", answer.alias("d")).select("r_regionkey", "bytes", "refused", F.col("d.answer").alias("answer"), F.col("d.why.kind").alias("why"))


# --- lexicon ----------------------------------------------------------------------------------------------------------

PHRASES = ["the", "of the", "in the", "then", "no", "and the", "on the a"]
PARTS = ["tionan", "ering", "there", "ungen", "mente"]


def corpus_lexicon() -> Lexicon:
    """Terms that occur in the test documents: phrases, parts of words, and words that others are typos of."""
    entries = [Entry(x, "phrase") for x in PHRASES] + [Entry(x, "part", True) for x in PARTS]
    return Lexicon(entries + [Entry(x, "word") for x in ("hearing", "stan", "einheit", "theory", "reading")], ["thean", "ereading"], 200)


def _corpus_hits(spark, sf_dir):
    return lexicon.hits(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", corpus_lexicon(), confusables.skeletons(spark))


@query
def lexicon_phrases(spark, sf_dir):
    """How often the scan finds each term, and in which way."""
    return _corpus_hits(spark, sf_dir).groupBy("doc", "term", "kind").agg(F.count("*").alias("n"), F.sum("penalty").alias("penalty"))


@query
def lexicon_greedy(spark, sf_dir):
    """Every hit of every document by place: left to right, none within another."""
    row = F.concat_ws(" ", "start", "end", "span.start", "span.end", "term", "tag", "kind", "edits", "penalty")
    return _corpus_hits(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"), _digest(row, "start").alias("hits_sha256"))


@query
def lexicon_substrings(spark, sf_dir):
    """Words in which a part is found."""
    hits = lexicon.hits(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", Lexicon([Entry(x, "part", True) for x in PARTS]))
    return hits.filter("kind = 'substring'").groupBy("doc", "term").agg(F.count("*").alias("n"))


@query
def lexicon_repairs(spark, sf_dir):
    """Distinct words of documents and the terms they are typos of."""
    words = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.explode(t.free_words(F.col("text"), skeletons=confusables.skeletons(spark), plain=True)).alias("word"))
    return lexicon.repairs(words, corpus_lexicon())


@query
def lexicon_lookup(spark, sf_dir):
    """The whole scan over messages, with repairs, look-alikes and guards."""
    found = messages(spark, sf_dir).select("id", t.lexicon_lookup(F.col("text"), delivery.classifier().lexicon, confusables.skeletons(spark)).alias("f"))
    hits = F.array_join(F.transform("f.hits", lambda h: F.concat_ws(":", h["term"], h["tag"], h["kind"], h["edits"], h["penalty"], h["span"]["start"], h["span"]["end"])), ",")
    return found.select("id", hits.alias("hits"), F.array_join(F.transform("f.flags", lambda x: F.concat_ws(":", x["term"], x["kind"], x["span"]["start"], x["span"]["end"])), ",").alias("flags"))


def _overlap_sides(spark, sf_dir):
    shown = confusables.skeletons(spark)
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc"), t.free_words(F.col("text"), skeletons=shown, least=3, plain=True).alias("words")).filter("words is not null")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("candidate"), t.free_words(F.col("text"), skeletons=shown, least=3).alias("words"))
    return docs, items


@query
def overlap_candidates(spark, sf_dir):
    """The benchmark items of whose words a document has at least 55 per cent."""
    docs, items = _overlap_sides(spark, sf_dir)
    docs, _ = staged(docs, "words")
    return lexicon.overlaps(docs, items, 550)


@query
def overlap_texts(spark, sf_dir):
    """How much of the next turn's words a turn has, text by text."""
    turns = messages(spark, sf_dir).withColumn("next", F.lead("text").over(Window.partitionBy((F.col("id") / 100).cast("long")).orderBy("id"))).filter("next is not null")
    return turns.select("id", t.text_overlap(F.col("text"), F.col("next")).alias("c"))


# --- rules ------------------------------------------------------------------------------------------------------------

CLASSES = [RuleClass("article", "sum"), RuleClass("action", "max")]
RULES = [
    Rule("a.the", "article", "the", 300), Rule("a.of_the", "article", "of the", 400), Rule("a.the_word_of", "article", "the {word} of", 450), Rule("b.gerund", "action", "the {gerund}", 700), Rule("b.ing", "action", "{gerund} of", 650, forbids=("negation",)),
    Rule("b.and", "action", "and", 500, forbids=("negation",)), Rule("b.is", "action", "is", 350, requires=("negation",)),
]
RULE_NEGATORS = ["no", "in the"]
ASKING = [
    Rule("q.stop", "stop", "stop", 800), Rule("q.asked", "ask", "i stop", 700, requires=("question",)), Rule("q.told", "ask", "halt", 600, forbids=("question",)), Rule("q.never", "stop", "not stop", 500, requires=("negation",)), Rule("q.cancel", "stop", "cancel", 750, forbids=("negation", "question")),
    Rule("q.use", "ask", "use {word} instead", 400), Rule("q.add", "ask", "and add", 900), Rule("q.build", "stop", "stop the {word}", 650),
]


def corpus_rules() -> RuleSet:
    return RuleSet(CLASSES, RULES, RULE_NEGATORS, 3)


def asking_rules() -> RuleSet:
    """Rules that require or forbid questions and negation, with summed classes."""
    return RuleSet([RuleClass("stop", "sum"), RuleClass("ask", "max")], ASKING, ["do", "don't", "no need to"], 2, Config(punct="collapse"))


def _corpus_matches(spark, sf_dir):
    return rules.matches(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", corpus_rules(), None, confusables.skeletons(spark))


@query
def rule_matches(spark, sf_dir):
    return _corpus_matches(spark, sf_dir).groupBy("doc", "rule", "status").agg(F.count("*").alias("n"), F.sum("effective").cast("long").alias("effective"))


@query
def rule_class_scores(spark, sf_dir):
    return rules.class_scores(_corpus_matches(spark, sf_dir), corpus_rules())


@query
def rule_decisions(spark, sf_dir):
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decide.flat(rules.decisions(docs, "doc_id", "text", corpus_rules(), None, "deep", confusables.skeletons(spark)))


@query
def rule_questions(spark, sf_dir):
    """All matches over messages in their order, with questions, negation, repaired words and penalties."""
    found = rules.matches(messages(spark, sf_dir), "id", "text", asking_rules(), delivery.classifier().lexicon, confusables.skeletons(spark))
    return found.select("doc", "pos", "rule", "class", "start", "end", F.col("span.start").alias("first"), F.col("span.end").alias("last"), "status", "question", "penalty", "effective")


@query
def rule_question_scores(spark, sf_dir):
    """The class scores that the kernel gives the same messages."""
    found = rules.scored(messages(spark, sf_dir), "id", "text", asking_rules(), delivery.classifier().lexicon, confusables.skeletons(spark))
    return found.select("doc", F.array_join("scores", ",").alias("scores"))


# --- classifier -------------------------------------------------------------------------------------------------------


def _classified(spark, sf_dir, profile: str, on_confusable: str = "abstain"):
    c = delivery.classifier(on_confusable, confusables.skeletons(spark), RECORDED_UNICODE)
    return messages(spark, sf_dir).select("id", t.classified(F.col("text"), c, F.lit(profile)).alias("d"))


def _decisions(made: DataFrame) -> DataFrame:
    return made.select("id", "d.answer", "d.option", "d.label", "d.confidence", F.col("d.why.kind").alias("why"), F.col("d.why.value").alias("why_value"), d.reason_text(F.col("d.why")).alias("reason"), d.ranked_text(F.col("d.ranked")).alias("ranked"), "d.profile", "d.data_version", F.size("d.trail").alias("steps"))


@query
def classifier_decide(spark, sf_dir):
    """The flagship: each message's decision by the compiled classifier."""
    return _decisions(_classified(spark, sf_dir, "standard"))


@query
def classifier_ignore(spark, sf_dir):
    """The same where look-alikes of terms are passed over."""
    return _decisions(_classified(spark, sf_dir, "deep", "ignore"))


@query
def classifier_trails(spark, sf_dir):
    """Each decision's trail, as text."""
    return _classified(spark, sf_dir, "standard").select("id", journal.trail_text(F.col("d.json")).alias("trail"))


@query
def classifier_records(spark, sf_dir):
    """Each step of each trail, as a row."""
    made = _classified(spark, sf_dir, "standard").select("id", F.inline("d.trail"))
    return made.select("id", "step", "stage", "rule_id", "scorer", F.col("span.start").alias("first"), F.col("span.end").alias("last"), "millis", "text")


@query
def data_versions(spark, sf_dir):
    """Fingerprints of the worked specification and the version of data that they make, for recorded journals."""
    c = delivery.classifier(unicode=RECORDED_UNICODE)
    parts = [("config", c.config.fingerprint().encode()), ("lexicon", c.lexicon.fingerprint()), ("rules", c.rules.fingerprint()), ("profiles", profile_table())]
    rows = [(name, hashlib.sha256(data).hexdigest()) for name, data in parts] + [("data_version", c.data_version)]
    return spark.createDataFrame(rows, "part string, digest string")


@query
def specification(spark, sf_dir):
    """The worked specification's rules, as read back from the file format."""
    held = rules_spec(json.dumps(delivery.rules_file()), "json")
    return spark.createDataFrame([(i, r.id, r.rule_class, r.pattern, r.weight, ",".join(r.forbids), r.version) for i, r in enumerate(held["rules"])], "n int, rule string, class string, pattern string, weight int, forbids string, version int")


# --- journal ----------------------------------------------------------------------------------------------------------


@query
def journal_round_trip(spark, sf_dir):
    """Decide, write as journal lines, damage some in each of three ways, parse, replay: each damage is told, and all other records come out the same."""
    c = delivery.classifier(skeletons=confusables.skeletons(spark))
    made = messages(spark, sf_dir).withColumn("d", t.classified(F.col("text"), c, F.lit("deep")))
    lines = journal.lines(made, F.col("text"), F.lit("deep"), F.col("d.json"), ["id"])
    kind, value = F.pmod("id", F.lit(7)), F.col("value")
    damaged = F.when(kind == 1, F.substring("value", 1, 40)).when(kind == 2, F.replace(value, F.lit('"schema":1'), F.lit('"schema":2'))).when(kind == 3, F.replace(value, F.lit('"message":"'), F.lit('"message":" '))).otherwise(value)
    entries = journal.parsed(lines.withColumn("value", damaged))
    return journal.check(entries, c).groupBy("error", "check.same").agg(F.count("*").alias("n"))


@query
def journal_lines(spark, sf_dir):
    """Journal lines, but for the hash of the input, which SQL can't compute."""
    made = _classified(spark, sf_dir, "standard").join(messages(spark, sf_dir), "id")
    lines = journal.lines(made, F.col("text"), F.lit("standard"), F.col("d.json"), ["id"])
    return lines.select("id", F.sha2(F.regexp_replace("value", '"input_hash":"[0-9a-f]{64}"', '"input_hash":""'), 256).alias("line_sha256"))


@query
def recorded_journal(spark, sf_dir):
    """The recorded messages decided anew: their journal lines must be the recorded bytes."""
    c = delivery.classifier(skeletons=confusables.skeletons(spark), unicode=RECORDED_UNICODE)
    made = spark.createDataFrame([r[:2] for r in recorded.JOURNAL], "message string, profile string").withColumn("d", t.classified(F.col("message"), c, F.col("profile")))
    read = journal.parsed(journal.lines(made, F.col("message"), F.col("profile"), F.col("d.json")))
    return journal.check(read, c).filter("check.same").select("message", "profile", "input_hash", F.sha2("value", 256).alias("line_sha256"))


@query
def node_labels(spark, sf_dir):
    """64-bit labels of nodes, made of their kind and name."""
    return table(spark, sf_dir, "nation").select("n_nationkey", graphs.label_of(F.lit("nation"), F.col("n_name")).alias("label"))


@query
def replay_other_version(spark, sf_dir):
    """Records replayed under a specification that passes look-alikes over: what changes in each."""
    c = delivery.classifier(skeletons=confusables.skeletons(spark))
    made = messages(spark, sf_dir).withColumn("d", t.classified(F.col("text"), c, F.lit("standard")))
    entries = journal.parsed(journal.lines(made, F.col("text"), F.lit("standard"), F.col("d.json"), ["id"]), ["id"])
    other = delivery.classifier("ignore", confusables.skeletons(spark))
    return journal.check(entries, other).select("id", "check.same", "check.data_version", "check.profile", "check.answer", "check.trail")


@query
def decision_diff(spark, sf_dir):
    return journal.difference(_gate(spark, sf_dir, "standard"), _gate(spark, sf_dir, "deep"), "user_id", ["answer", "chosen", "why"])


# --- hypervectors -----------------------------------------------------------------------------------------------------

NAMESPACE = "parts"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").withColumn("vector", hypervectors.encode(F.col("p_name"), NAMESPACE))


@query
def hdc_seed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hypervectors.seed(F.col("p_name"), NAMESPACE).alias("seed"))


@query
def hdc_encode(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.col("vector")[0].alias("first_word"), F.col("vector")[15].alias("last_word"), F.aggregate("vector", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))


@query
def hdc_nearest(spark, sf_dir):
    """The brand whose hypervector is most like a part's name's."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct().withColumn("vector", hypervectors.encode(F.col("id"), NAMESPACE))
    return hypervectors.nearest(_parts(spark, sf_dir).select("p_partkey", "vector"), brands, "p_partkey")


@query
def hdc_bind(spark, sf_dir):
    """A name bound with its brand: as far from either as chance has it, and freed again by binding once more."""
    p = _parts(spark, sf_dir).withColumn("brand", hypervectors.encode(F.col("p_brand"), NAMESPACE)).withColumn("bound", d.bind(F.col("vector"), F.col("brand")))
    return p.select("p_partkey", d.similarity(F.col("bound"), F.col("vector"), 1024).alias("to_name"), d.hamming(d.bind(F.col("bound"), F.col("brand")), F.col("vector")).alias("left_over"), d.similarity(d.negate(F.col("vector")), F.col("vector"), 1024).alias("to_negative"))


@query
def hdc_bundle(spark, sf_dir):
    """Each brand's bundle of names, and how like the bundle its names are on the whole."""
    p = _parts(spark, sf_dir)
    bundles = hypervectors.bundle(p, ["p_brand"]).withColumnRenamed("vector", "bundle")
    return p.join(bundles, "p_brand").groupBy("p_brand").agg(F.sum(d.similarity(F.col("vector"), F.col("bundle"), 1024)).cast("long").alias("similarity"), F.count("*").alias("n"))


@query
def hdc_permute(spark, sf_dir):
    """Components of permuted names, by place."""
    moved = _parts(spark, sf_dir).withColumn("moved", hypervectors.permute(F.col("vector"), 70))
    places = [0, 1, 63, 69, 70, 71, 500, 1023, 1030]
    return moved.select("p_partkey", F.array_join(F.array(*(d.component(F.col("moved"), i, 1024) for i in places)), ",").alias("components"), d.hamming(F.col("moved"), F.col("vector")).cast("long").alias("apart"))


@query
def hdc_dimensions(spark, sf_dir):
    """Names in 2048 and 4096 dimensions."""
    p = table(spark, sf_dir, "part").select("p_partkey", hypervectors.encode(F.col("p_name"), NAMESPACE, 2048).alias("a"), hypervectors.encode(F.col("p_name"), NAMESPACE, 4096).alias("b"))
    ones = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + F.bit_count(x))
    return p.select("p_partkey", ones("a").alias("ones_a"), ones("b").alias("ones_b"), F.col("a")[31].alias("last_a"), F.col("b")[63].alias("last_b"))


@query
def hdc_cleanup(spark, sf_dir):
    """As hdc_nearest, of names that are like a brand to a certain degree."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct().withColumn("vector", hypervectors.encode(F.col("id"), NAMESPACE))
    return hypervectors.nearest(_parts(spark, sf_dir).select("p_partkey", "vector"), brands, "p_partkey", floor=60)


@query
def hdc_codebook(spark, sf_dir):
    """Brands as a codebook, numbered in the order of their ids."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct().withColumn("vector", hypervectors.encode(F.col("id"), NAMESPACE))
    return hypervectors.codebook(brands).select("idx", "id", F.col("vector")[0].alias("first_word"))


@query
def hdc_weighted(spark, sf_dir):
    """Each brand's weighted sums of components: how large they are, and their signs."""
    total = hypervectors.sums(_parts(spark, sf_dir).withColumn("w", F.pmod("p_partkey", F.lit(5)) - 2), ["p_brand"], weight="w").withColumn("signs", hypervectors.signs(F.col("sums")))
    return total.select("p_brand", F.aggregate("sums", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)).alias("l1"), F.array_max("sums").alias("top"), F.array_min("sums").alias("bottom"), F.col("sums")[77].alias("one"), F.aggregate("signs", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("negative"))


@query
def hdc_decode(spark, sf_dir):
    """What event types a user's weighted sum is made of."""
    events = table(spark, sf_dir, "events")
    ids = sorted(r[0] for r in events.select("event_type").distinct().collect())  # options: a handful
    weights = events.groupBy("user_id", "event_type").agg(F.count("*").alias("w")).withColumn("vector", hypervectors.encode(F.col("event_type"), "events"))
    total = hypervectors.sums(weights, ["user_id"], weight="w")
    return hypervectors.decode(total, ids, hdc.encode([hdc.seed("events", i) for i in ids]), "user_id", 3, 100)


@query
def hdc_resonate(spark, sf_dir):
    """Each pair of a region's and a nation's name, recovered from their binding."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions, nations = sorted(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()), sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect())
    book = lambda ids: (ids, hdc.encode([hdc.seed("geo", i) for i in ids]))
    bound = both.withColumn("vector", d.bind(hypervectors.encode(F.col("r_name"), "geo"), hypervectors.encode(F.col("n_name"), "geo")))
    return hypervectors.resonate(bound, book(regions), book(nations), "n_nationkey").select("n_nationkey", "converged", "a", "b")


@query
def hdc_capacity(spark, sf_dir):
    """How much of a bundle is found again, by codebook, dimension and size of the bundle."""
    cells = [(n, dim, k) for dim in hdc.DIMENSIONS for n in (64, 256, 1024) for k in (1, 5, 15, 50, 100, 200) if k <= n]
    return hypervectors.capacity(spark.createDataFrame(cells, "entries int, dim int, k int").repartition(len(cells), "entries", "dim", "k"))


# --- graphs -----------------------------------------------------------------------------------------------------------


def _trade(spark, sf_dir):
    """Nations, their customers and suppliers, and orders; nodes are numbered by kind."""
    number = lambda kind, c: (F.col(c).cast("long") * 4 + kind).alias("v")
    nation, customer, supplier, orders = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier", "orders"))
    nodes = nation.select(number(0, "n_nationkey"), F.lit(0).alias("label")).unionAll(customer.select(number(1, "c_custkey"), F.lit(1))).unionAll(supplier.select(number(2, "s_suppkey"), F.lit(2))).unionAll(orders.select(number(3, "o_orderkey"), F.lit(3)))
    edge = lambda df, k, a, m, b, directed: df.select(number(k, a).alias("a"), number(m, b).alias("b"), F.lit(None).cast("long").alias("label"), F.lit(directed).alias("directed"))
    edges = edge(customer, 1, "c_custkey", 0, "c_nationkey", False).unionAll(edge(supplier, 2, "s_suppkey", 0, "s_nationkey", False)).unionAll(edge(orders, 3, "o_orderkey", 1, "o_custkey", True))
    return nodes, edges


@query
def wl_colours(spark, sf_dir):
    """The partition of the trade graph after two rounds."""
    nodes, edges = _trade(spark, sf_dir)
    return graphs.partition(graphs.refine(nodes, graphs.adjacency(edges), 2))


@query
def wl_stable_classes(spark, sf_dir):
    """Sizes of the classes that no further round splits."""
    nodes, edges = _trade(spark, sf_dir)
    stable = graphs.partition(graphs.refine(nodes, graphs.adjacency(edges), None))
    return stable.groupBy("class").agg(F.count("*").alias("n"))


def _chains(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("v"), F.when(F.col("role") == "user", 1).otherwise(2).cast("long").alias("label"))
    edges = turns.select("g", "v").distinct().select("g", F.col("v").alias("a"), F.lead("v").over(Window.partitionBy("g").orderBy("v")).alias("b"), F.lit(None).cast("long").alias("label"), F.lit(True).alias("directed")).filter("b is not null")
    # of turns that repeat a number, that of the least label counts
    return turns.groupBy("g", "v").agg(F.min("label").alias("label")), edges


@query
def wl_fingerprints(spark, sf_dir):
    """A fingerprint per conversation's chain of turns; equal ones have the same shape."""
    return graphs.refine_each(*_chains(spark, sf_dir))


@query
def graph_fingerprint(spark, sf_dir):
    """The fingerprint of the whole trade graph after two rounds."""
    nodes, edges = _trade(spark, sf_dir)
    return graphs.fingerprint(graphs.refine(nodes, graphs.adjacency(edges), 2))


@query
def spd_wl_fingerprints(spark, sf_dir):
    return graphs.refine_each(*_chains(spark, sf_dir), mode="spd")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier_decide(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.sql(LEVELS, WEIGHTS) | structure_oracles.sql(LEVELS, WEIGHTS, DRIVES) | text_oracles.sql()
