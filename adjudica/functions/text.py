"""Arrow UDFs over the text kernels. Each worker compiles its specification once, and results are put together by column.

A null text has null results, unless a function says otherwise. Texts of more than 16 MiB are refused, never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import text as kernel
from ..kernels.classifier import Classifier
from ..kernels.lexicon import Lexicon, overlap
from ..kernels.rules import RuleSet, repairs_of

SPAN = "struct<start:int,end:int>"
TOKEN = f"struct<pos:int,text:string,start:int,end:int,span:{SPAN},zone:string,sentence:int,confusable:string,skeleton:string>"
PROTECTED = f"array<struct<kind:string,start:int,end:int,span:{SPAN}>>"
SUMMARY = f"struct<refused:boolean,canonical:string,sentences:int,n_tokens:int,protected:{PROTECTED}>"
NORMALIZED = f"struct<refused:boolean,canonical:string,sentences:int,protected:{PROTECTED},tokens:array<{TOKEN}>>"

_INT, _STR, _BOOL = pa.int32(), pa.string(), pa.bool_()
_SPAN_TYPE = pa.struct([("start", _INT), ("end", _INT)])


def _spans(spans: list) -> pa.Array:
    starts, ends = [None if s is None else s[0] for s in spans], [None if s is None else s[1] for s in spans]
    return pa.StructArray.from_arrays([pa.array(starts, _INT), pa.array(ends, _INT)], fields=[*_SPAN_TYPE], mask=pa.array([s is None for s in spans], _BOOL))


class _Lists:
    """One list of structs a row, held as a column per field; *kinds* gives the fields, a span being a pair."""

    def __init__(self, **kinds):
        self.kinds, self.rows = kinds, []
        self.counts: list[int | None] = []

    def add(self, rows: Iterable[tuple] | None) -> None:
        before = len(self.rows)
        self.rows.extend(rows or ())
        self.counts.append(None if rows is None else len(self.rows) - before)

    def array(self) -> pa.Array:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.kinds)
        made = [_spans(c) if k is _SPAN_TYPE else pa.array(c, k) for c, k in zip(columns, self.kinds.values())]
        items = pa.StructArray.from_arrays(made, fields=[pa.field(n, k) for n, k in self.kinds.items()])
        offsets, total = [], 0
        for n in self.counts:
            offsets.append(None if n is None else total)
            total += n or 0
        return pa.ListArray.from_arrays(pa.array([*offsets, total], _INT), items)


def _struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([*columns.values()], names=[*columns])


def _normalized(texts: Iterable[str | None], config: kernel.Config, skeletons: dict[str, str]) -> Iterator[tuple[bool | None, kernel.Normalized | None]]:
    """(refused, normalized or None) of each text."""
    for t in texts:
        try:
            yield (None, None) if t is None else (False, kernel.normalize(t, config, skeletons))
        except kernel.TooLong:
            yield True, None


def _protected(n: kernel.Normalized, at) -> list[tuple]:
    return [(k, at[a], at[b], s) for k, a, b, s in n.protected]


def _slices(texts: pa.Array, most: int = 1 << 18) -> Iterator[pa.Array]:
    """Neighbouring texts of about *most* bytes together, or one longer text: a batch has up to 10,000 texts, whose tokens would take hundreds of
    times the memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield texts.slice(first, stop - first)
        first = stop


def _numbered(n: kernel.Normalized | None, numbers: list[np.ndarray]) -> tuple[list, ...]:
    """Words, zones and look-alikes of a text; its numbers go to *numbers*."""
    if n is None:
        return ()
    made, *rest = kernel.token_columns(n)
    numbers.append(made)
    return tuple(rest)


def normalized(text: Column, config: kernel.Config = kernel.Config(), skeletons: dict[str, str] = kernel.BASIC_SKELETONS) -> Column:
    """Canonical text with protected spans and tokens; offsets are canonical bytes, spans bytes of the original."""

    @F.arrow_udf(NORMALIZED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (x for batch in batches for x in _slices(batch)):
            whole: list[tuple] = []
            spans = _Lists(kind=_STR, start=_INT, end=_INT, span=_SPAN_TYPE)
            tokens = _Lists(pos=_INT, text=_STR, start=_INT, end=_INT, span=_SPAN_TYPE, zone=_STR, sentence=_INT, confusable=_STR, skeleton=_STR)
            for refused, n in _normalized(texts.to_pylist(), config, skeletons):
                whole.append((refused, n and n.canonical, n and n.sentences))
                at = kernel.byte_offsets(n.canonical) if n else ()
                spans.add(n and _protected(n, at))
                tokens.add(n and [(i, x.text, at[x.start], at[x.end], x.span, x.zone, x.sentence, x.confusable, x.skeleton) for i, x in enumerate(n.tokens)])
            refused, canonical, sentences = zip(*whole) if whole else ((), (), ())
            yield _struct(refused=pa.array(refused, _BOOL), canonical=pa.array(canonical, _STR), sentences=pa.array(sentences, _INT), protected=spans.array(), tokens=tokens.array())

    return run(text)


def tokenized(text: Column, config: kernel.Config = kernel.Config(), skeletons: dict[str, str] = kernel.BASIC_SKELETONS) -> Column:
    """Only the tokens of :func:`normalized`; null where the text is refused."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (x for batch in batches for x in _slices(batch)):
            numbers, offsets, words, zones, alike = [np.zeros((6, 0), dtype=np.int64)], [], [], [], []
            for _, n in _normalized(texts.to_pylist(), config, skeletons):
                offsets.append(None if n is None else len(words))
                for held, more in zip((words, zones, alike), _numbered(n, numbers)):
                    held.extend(more)
            pos, start, end, first, last, sentence = (pa.array(c, _INT) for c in np.concatenate(numbers, axis=1).astype(np.int32))
            span = pa.StructArray.from_arrays([first, last], fields=[*_SPAN_TYPE])
            confusable, skeleton = (pa.array([x[i] for x in alike], _STR) for i in (0, 1))
            items = _struct(pos=pos, text=pa.array(words, _STR), start=start, end=end, span=span, zone=pa.array(zones, _STR), sentence=sentence, confusable=confusable, skeleton=skeleton)
            yield pa.ListArray.from_arrays(pa.array([*offsets, len(words)], _INT), items)

    # else a filter on the tokens, such as explode brings along, has them made twice
    return run.asNondeterministic()(text)


def summary(text: Column, config: kernel.Config = kernel.Config()) -> Column:
    """Canonical text, protected spans, and how many sentences and tokens there are: no token is made."""

    @F.arrow_udf(SUMMARY)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            whole: list[tuple] = []
            spans = _Lists(kind=_STR, start=_INT, end=_INT, span=_SPAN_TYPE)
            for refused, n in _normalized(texts.to_pylist(), config, {}):
                whole.append((refused, n and n.canonical, n and n.sentences, n and len(kernel.word_places(n.canonical))))
                spans.add(n and _protected(n, kernel.byte_offsets(n.canonical) if n.protected else ()))
            refused, canonical, sentences, count = zip(*whole) if whole else ((), (), (), ())
            yield _struct(refused=pa.array(refused, _BOOL), canonical=pa.array(canonical, _STR), sentences=pa.array(sentences, _INT), n_tokens=pa.array(count, _INT), protected=spans.array())

    return run(text)


def refused(text: Column) -> Column:
    """Whether a text is too long for the engine, by an expression; null for null."""
    return F.octet_length(text) > kernel.MAX_INPUT_BYTES


def canonical(text: Column, config: kernel.Config = kernel.Config()) -> Column:
    """Only the canonical text; null where it is refused."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([n and n.canonical for _, n in _normalized(texts.to_pylist(), config, {})], _STR)

    return run(text)


def to_original(text: Column, start: Column, end: Column, config: kernel.Config = kernel.Config()) -> Column:
    """The original bytes of a range of canonical bytes; null where any of the three is null or the text is refused."""

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        both = zip(_normalized(texts.to_pylist(), config, {}), starts.to_pylist(), ends.to_pylist())
        return _spans([None if n is None or a is None or b is None else n.to_original(a, b) for (_, n), a, b in both])

    return run(text, start, end)


def repaired(word: Column, lexicon: Lexicon) -> Column:
    """What the lexicon repairs a word to: the term and the edits, or null."""

    @F.arrow_udf("struct<term:string,edits:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            found = [None if w is None or lexicon.find(w) is not None else lexicon.repair(w) for w in words.to_pylist()]
            parts = [pa.array([f and lexicon.entries[f[0]].term for f in found], _STR), pa.array([f and f[1] for f in found], _INT)]
            yield pa.StructArray.from_arrays(parts, names=["term", "edits"], mask=parts[0].is_null())

    return run(word)


HIT = f"struct<term:string,tag:string,start:int,end:int,span:{SPAN},kind:string,edits:int,penalty:int>"
FLAG = f"struct<term:string,token:int,span:{SPAN},kind:string>"


def _hits() -> _Lists:
    return _Lists(term=_STR, tag=_STR, start=_INT, end=_INT, span=_SPAN_TYPE, kind=_STR, edits=_INT, penalty=_INT)


def lexicon_lookup(text: Column, lexicon: Lexicon, skeletons: dict[str, str] = kernel.BASIC_SKELETONS) -> Column:
    """Hits and flags of a lexicon, from left to right."""

    @F.arrow_udf(f"struct<hits:array<{HIT}>,flags:array<{FLAG}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        entries = lexicon.entries
        for texts in batches:
            hits, flags = _hits(), _Lists(term=_STR, token=_INT, span=_SPAN_TYPE, kind=_STR)
            for _, n in _normalized(texts.to_pylist(), lexicon.config, skeletons):
                found = n and lexicon.lookup(n)
                hits.add(found and [(entries[h.entry].term, entries[h.entry].tag, h.start, h.end, h.span, h.kind, h.edits, h.penalty) for h in found.hits])
                flags.add(found and [(entries[f.entry].term, f.token, f.span, f.kind) for f in found.flags])
            yield _struct(hits=hits.array(), flags=flags.array())

    return run(text)


def text_overlap(query: Column, candidate: Column, config: kernel.Config = kernel.Config()) -> Column:
    """Thousandths of the candidate's words that the query has; a null or refused text counts as empty."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        none = kernel.normalize("", config)
        both = zip(_normalized(a.to_pylist(), config, {}), _normalized(b.to_pylist(), config, {}))
        return pa.array([overlap(x or none, y or none) for (_, x), (_, y) in both], _INT)

    return run(query, candidate)


def free_words(text: Column, config: kernel.Config = kernel.Config(), skeletons: dict[str, str] = kernel.BASIC_SKELETONS, least: int = 1, plain: bool = False) -> Column:
    """The distinct free words of *least* characters or more, in byte order; with *plain* without look-alikes."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = _normalized(texts.to_pylist(), config, skeletons)
            yield pa.array([n and sorted({t.text for t in n.tokens if t.free and len(t.text) >= least and not (plain and t.confusable)}, key=str.encode) for _, n in found], pa.list_(_STR))

    return run(text)


MATCH = f"struct<rule:string,class:string,start:int,end:int,span:{SPAN},status:string,question:boolean,penalty:int,effective:int>"


def rule_scores(text: Column, rules: RuleSet, lexicon: Lexicon | None = None, skeletons: dict[str, str] = kernel.BASIC_SKELETONS) -> Column:
    """Class scores, in the order of the classes, and matches, by (start, rule, end); words are read as the lexicon repairs them."""

    @F.arrow_udf(f"struct<scores:array<int>,matches:array<{MATCH}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores: list[list[int] | None] = []
            matches = _Lists(rule=_STR, **{"class": _STR}, start=_INT, end=_INT, span=_SPAN_TYPE, status=_STR, question=_BOOL, penalty=_INT, effective=_INT)
            for _, n in _normalized(texts.to_pylist(), rules.config, skeletons):
                s = n and rules.score(n, repairs_of(lexicon, lexicon.lookup(n)) if lexicon else {})
                scores.append(s and s.scores)
                matches.add(s and [(m.rule, m.rule_class, m.start, m.end, m.span, m.status, m.question, m.penalty, m.effective) for m in s.matches])
            yield _struct(scores=pa.array(scores, pa.list_(_INT)), matches=matches.array())

    return run(text)


TRAIL = f"array<struct<step:int,stage:string,rule_id:string,scorer:string,span:{SPAN},millis:int,text:string>>"
DECISION = f"struct<answer:string,option:int,label:string,confidence:int,why:struct<kind:string,value:int,min:int>,ranked:array<struct<option:int,confidence:int>>,profile:string,data_version:string,trail:{TRAIL},json:string>"


def classified(text: Column, classifier: Classifier, profile: Column) -> Column:
    """A decision per text: the answer, its trail, and both as canonical JSON (as it goes into a journal). A null text counts as empty."""
    from ..kernels.classifier import canonical_json

    @F.arrow_udf(DECISION)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, profiles in batches:
            whole: list[tuple] = []
            why: list[tuple] = []
            ranked = _Lists(option=_INT, confidence=_INT)
            trail = _Lists(step=_INT, stage=_STR, rule_id=_STR, scorer=_STR, span=_SPAN_TYPE, millis=_INT, text=_STR)
            for t, p in zip(texts.to_pylist(), profiles.to_pylist()):
                made = classifier.decide(t or "", p)
                a, option = made["answer"], made["answer"].get("option")
                whole.append((a["answer"], option, None if option is None else classifier.labels[option], a.get("confidence"), p, made["data_version"], canonical_json(made)))
                w = a.get("why") or {}
                why.append((w.get("kind"), w.get("top", w.get("margin")), w.get("min")))
                ranked.add(map(tuple, a["ranked"]))
                trail.add((r["step"], r["stage"], r.get("rule_id"), r.get("scorer"), (s["start"], s["end"]) if (s := r.get("span")) else None, r["millis"], r["text"]) for r in made["trail"])
            kinds = (_STR, _INT, _STR, _INT, _STR, _STR, _STR)
            answer, option, label, confidence, named, version, line = (pa.array(c, k) for c, k in zip(zip(*whole) if whole else [()] * 7, kinds))
            reason = [pa.array(c, k) for c, k in zip(zip(*why) if why else [()] * 3, (_STR, _INT, _INT))]
            reasons = pa.StructArray.from_arrays(reason, names=["kind", "value", "min"], mask=reason[0].is_null())
            yield _struct(answer=answer, option=option, label=label, confidence=confidence, why=reasons, ranked=ranked.array(), profile=named, data_version=version, trail=trail.array(), json=line)

    return run(text, profile)
