"""Cue rules over token sequences: literals and slots, negation, questions, specificity, class scores."""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field

from .lexicon import Lexicon, Lookup, SpecError, canonical_words, framed
from .text import Config, Normalized

#: Fixed value of fingerprints.
FINGERPRINT_TAG = b"pua-rules-v1"
MAX_ITEMS, MAX_NEGATOR_TOKENS, MAX_WINDOW, MIN_GERUND_CHARS = 6, 3, 8, 5
SLOTS = ("{word}", "{gerund}")
CONTEXTS = ("negation", "question")


@dataclass(frozen=True)
class RuleClass:
    name: str
    scorer: str = "max"  # or sum


@dataclass(frozen=True)
class Rule:
    id: str
    rule_class: str
    pattern: str
    weight: int
    requires: tuple[str, ...] = ()
    forbids: tuple[str, ...] = ()
    version: int = 1


@dataclass(frozen=True)
class Match:
    rule: str
    rule_class: str
    start: int
    end: int
    span: tuple[int, int]
    status: str  # suppressed, negated, context_unmet or counted
    question: bool
    penalty: int
    effective: int


@dataclass
class Scored:
    scores: list[int] = field(default_factory=list)
    matches: list[Match] = field(default_factory=list)


def _items(rule: Rule, config: Config) -> list[str]:
    if not rule.pattern:
        raise SpecError("EmptyPattern", id=rule.id)
    items = rule.pattern.split(" ")
    if len(items) > MAX_ITEMS:
        raise SpecError("PatternTooLong", id=rule.id, items=len(items))
    for w in items:
        if w in SLOTS:
            continue
        if w.startswith("{") or w.endswith("}"):
            raise SpecError("UnknownSlot", id=rule.id, slot=w)
        if canonical_words(w, config) != [w]:
            raise SpecError("NonCanonicalLiteral", id=rule.id, literal=w)
    if all(w in SLOTS for w in items):
        raise SpecError("NoLiteral", id=rule.id)
    return items


def _check_contexts(rule: Rule) -> None:
    for names in (rule.requires, rule.forbids):
        for i, c in enumerate(names):
            if c not in CONTEXTS:
                raise SpecError("UnknownContext", id=rule.id, context=c)
            if c in names[:i]:
                raise SpecError("DuplicateContext", id=rule.id, context=c)
    for c in CONTEXTS:
        if c in rule.requires and c in rule.forbids:
            raise SpecError("ContextConflict", id=rule.id, context=c)


class RuleSet:
    """Validated rules in the order of their ids, indexed by their first literal."""

    def __init__(self, classes: list[RuleClass], rules: list[Rule], negators: list[str] = (), window: int = 3, config: Config = Config()):
        if not classes:
            raise SpecError("NoClasses")
        names: list[str] = []
        for i, c in enumerate(classes):
            if not c.name:
                raise SpecError("EmptyClassName", index=i)
            if c.name in names:
                raise SpecError("DuplicateClass", name=c.name)
            names.append(c.name)
        phrases: list[tuple[str, ...]] = []
        for i, n in enumerate(negators):
            w = canonical_words(n, config)
            if w is None or len(w) > MAX_NEGATOR_TOKENS or " ".join(w) != n:
                raise SpecError("NonCanonicalNegator", index=i)
            if tuple(w) in phrases:
                raise SpecError("DuplicateNegator", index=i)
            phrases.append(tuple(w))
        if not 1 <= window <= MAX_WINDOW:
            raise SpecError("NegationWindowOutOfRange", window=window)
        if not rules:
            raise SpecError("NoRules")
        self.items: dict[str, list[str]] = {}
        for i, r in enumerate(rules):
            if not r.id:
                raise SpecError("EmptyRuleId", index=i)
            if r.id in self.items:
                raise SpecError("DuplicateRuleId", id=r.id)
            if r.rule_class not in names:
                raise SpecError("UnknownClass", id=r.id, **{"class": r.rule_class})
            if not 1 <= r.weight <= 1000:
                raise SpecError("WeightOutOfRange", id=r.id, weight=r.weight)
            if r.version < 1:
                raise SpecError("ZeroVersion", id=r.id)
            self.items[r.id] = _items(r, config)
            _check_contexts(r)
        self.config, self.classes, self.window = config, list(classes), window
        self.negators = sorted(phrases, key=lambda p: [w.encode() for w in p])
        self.rules = sorted(rules, key=lambda r: r.id.encode())
        self.by_literal: dict[str, list[tuple[int, int]]] = {}
        for i, r in enumerate(self.rules):
            first = next(k for k, w in enumerate(self.items[r.id]) if w not in SLOTS)
            self.by_literal.setdefault(self.items[r.id][first], []).append((i, first))

    def fingerprint(self) -> bytes:
        parts = [FINGERPRINT_TAG, self.config.fingerprint().encode()]
        for c in self.classes:
            parts += [c.name.encode(), c.scorer.encode()]
        parts += [b"negators", *(" ".join(n).encode() for n in self.negators), bytes([self.window])]
        for r in self.rules:
            flags = bytes(c in names for names in (r.requires, r.forbids) for c in CONTEXTS)
            parts += [r.id.encode(), r.rule_class.encode(), *map(str.encode, self.items[r.id]), struct.pack("<h", r.weight), flags, struct.pack("<I", r.version)]
        return framed(*parts)

    def _fits(self, items: list[str], at: int, tokens, words) -> bool:
        if at < 0 or at + len(items) > len(tokens):
            return False
        sentence = tokens[at].sentence
        for k, item in enumerate(items, at):
            t, w = tokens[k], words[k]
            if not t.free or t.sentence != sentence:
                return False
            if item == "{gerund}":
                if w is None or len(w) < MIN_GERUND_CHARS or not w.endswith("ing"):
                    return False
            elif item != "{word}" and w != item:
                return False
        return True

    def _negated(self, at: int, tokens) -> bool:
        """Whether a negator, as written, lies wholly among the window's tokens before *at* in its sentence."""
        first = max(0, at - self.window)
        before = [t.text if t.free else None for t in tokens[first:at] if t.sentence == tokens[at].sentence]
        return any(tuple(before[i : i + len(n)]) == n for n in self.negators for i in range(len(before) - len(n) + 1))

    def score(self, text: Normalized, repaired: dict[int, tuple[str, int]] = {}) -> Scored:
        """All matches by (start, rule, end) and each class's score. *repaired*: for tokens, the term they are read as and its penalty."""
        if text.config != self.config:
            raise SpecError("ConfigMismatch")
        tokens = text.tokens
        words = [(repaired[i][0] if i in repaired else t.text) if t.free and not t.confusable else None for i, t in enumerate(tokens)]
        asked = question_sentences(text)
        found = sorted((s, i, s + len(self.items[self.rules[i].id])) for k, w in enumerate(words) if w is not None for i, first in self.by_literal.get(w, ()) for s in [k - first] if self._fits(self.items[self.rules[i].id], s, tokens, words))
        out = Scored([0] * len(self.classes))
        order = {c.name: k for k, c in enumerate(self.classes)}
        for s, i, e in found:
            r = self.rules[i]
            # whatever contains a match starts at most a pattern's length before it
            near = found[bisect_left(found, (s - MAX_ITEMS,)) : bisect_left(found, (s + 1,))]
            question, negated = asked[tokens[s].sentence], self._negated(s, tokens)
            if any(e <= b and (a, b) != (s, e) for a, _, b in near):
                status = "suppressed"
            elif negated and "negation" in r.forbids:
                status = "negated"
            elif ("negation" in r.requires and not negated) or ("question" in r.requires and not question) or ("question" in r.forbids and question):
                status = "context_unmet"
            else:
                status = "counted"
            penalty = min(1000, sum(repaired[k][1] for k in range(s, e) if k in repaired))
            effective = max(0, (r.weight // 2 if question and "question" not in r.requires else r.weight) - penalty) if status == "counted" else 0
            k = order[r.rule_class]
            out.scores[k] = max(out.scores[k], effective) if self.classes[k].scorer == "max" else min(1000, out.scores[k] + effective)
            out.matches.append(Match(r.id, r.rule_class, s, e, (tokens[s].span[0], max(t.span[1] for t in tokens[s:e])), status, question, penalty, effective))
        return out


def question_sentences(text: Normalized) -> list[bool]:
    """By sentence: whether a question mark outside protected spans follows its last token, before the next one."""
    out, tokens = [False] * max(1, text.sentences), text.tokens
    if "?" not in text.canonical:
        return out
    for t, after in zip(tokens, [*tokens[1:], None]):
        if after is None or after.sentence != t.sentence:
            end = len(text.canonical) if after is None else after.start
            out[t.sentence] = any(text.canonical[i] == "?" and not any(a <= i < b for _, a, b, _ in text.protected) for i in range(t.end, end))
    return out


def repairs_of(lexicon: Lexicon, found: Lookup) -> dict[int, tuple[str, int]]:
    return {h.start: (lexicon.entries[h.entry].term, h.penalty) for h in found.hits if h.kind == "repaired" and h.end == h.start + 1}
