"""Closed vocabularies: exact, substring and typo-repaired matches, and word overlap."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from itertools import combinations

from .text import Config, Normalized, normalize

#: Fixed value of fingerprints.
FINGERPRINT_TAG = b"pua-lexicon-v1"
MEMO = 50_000  # words of up to the longest term's length and two
MAX_TERM_TOKENS, MIN_SUBSTRING_CHARS, MIN_REPAIR_CHARS, MIN_OVERLAP_CHARS = 3, 5, 4, 3


class SpecError(ValueError):
    """kind names the first rule that a specification breaks; detail says where."""

    def __init__(self, kind: str, **detail):
        super().__init__(f"{kind}: " + ", ".join(f"{k}={v!r}" for k, v in detail.items()) if detail else kind)
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class Entry:
    term: str
    tag: str
    substring: bool = False


@dataclass(frozen=True)
class Hit:
    entry: int
    start: int  # tokens
    end: int
    span: tuple[int, int]
    kind: str  # exact, substring or repaired
    edits: int = 0
    penalty: int = 0


@dataclass(frozen=True)
class Flag:
    entry: int
    token: int
    span: tuple[int, int]
    kind: str


@dataclass
class Lookup:
    hits: list[Hit] = field(default_factory=list)
    flags: list[Flag] = field(default_factory=list)


def canonical_words(text: str, config: Config) -> list[str] | None:
    """The words of a phrase, if all its tokens are free, none a look-alike, in one sentence."""
    n = normalize(text, config)
    if not n.tokens or any(not t.free or t.confusable for t in n.tokens) or len({t.sentence for t in n.tokens}) > 1:
        return None
    return [t.text for t in n.tokens]


def framed(*parts: bytes) -> bytes:
    """Each part after its length as 8 little-endian bytes."""
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


# --- typo repair ------------------------------------------------------------------------------------------------------

_KEY = {c: (row, column) for row, keys in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for column, c in enumerate(keys)}


def adjacent_keys(a: str, b: str) -> bool:
    """Neighbours in a row, or a key and the two it touches in the row below (which is half a key to the right)."""
    if a not in _KEY or b not in _KEY:
        return False
    (r, c), (s, d) = sorted((_KEY[a], _KEY[b]))
    return abs(c - d) == 1 if r == s else s == r + 1 and d in (c, c - 1)


def repair_cost(word: str, term: str, most: int) -> tuple[int, int, int] | None:
    """Least (edits, edits that no neighbouring key explains, edits that are no transposition) of an optimal string
    alignment, or None beyond *most* edits."""
    if abs(len(word) - len(term)) > most:
        return None
    plus = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    edit, swap, near, none = (1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 0, 0)
    older: list = []
    row = [(j, j, j) for j in range(len(term) + 1)]
    for i, x in enumerate(word, 1):
        new = [(i, i, i)]
        for j, y in enumerate(term, 1):
            options = [plus(row[j - 1], none if x == y else near if adjacent_keys(x, y) else edit), plus(row[j], edit), plus(new[-1], edit)]
            if i > 1 and j > 1 and x != y and x == term[j - 2] and word[i - 2] == y:
                options.append(plus(older[j - 2], swap))
            new.append(min(options))
        older, row = row, new
    return row[-1] if row[-1][0] <= most else None


def deletes(word: str, most: int) -> set[str]:
    """All that is left of *word* without up to *most* of its characters."""
    n = len(word)
    return {"".join(word[i] for i in kept) for k in range(min(most, n) + 1) for kept in combinations(range(n), n - k)}


def edits_allowed(length: int) -> int:
    return 1 if length <= 4 else 2


# --- the lexicon ------------------------------------------------------------------------------------------------------


class Lexicon:
    """Validated and indexed entries, in the order of their terms' bytes.

    *penalty*: of a repair, per edit; None turns repairs off.
    """

    def __init__(self, entries: list[Entry], guards: list[str] = (), penalty: int | None = None, config: Config = Config()):
        if not entries:
            raise SpecError("NoEntries")
        seen: set[str] = set()
        words: dict[str, list[str]] = {}
        for i, e in enumerate(entries):
            if not e.term:
                raise SpecError("EmptyTerm", index=i)
            if not e.tag:
                raise SpecError("EmptyTag", index=i)
            w = canonical_words(e.term, config)
            if w is None:
                raise SpecError("UnmatchableTerm", index=i)
            if " ".join(w) != e.term:
                raise SpecError("NonCanonicalTerm", index=i, expected=" ".join(w))
            if len(w) > MAX_TERM_TOKENS:
                raise SpecError("TooManyTokens", index=i, tokens=len(w))
            if e.substring and len(w) > 1:
                raise SpecError("SubstringMultiToken", index=i)
            if e.substring and len(e.term) < MIN_SUBSTRING_CHARS:
                raise SpecError("SubstringTooShort", index=i)
            if e.term in seen:
                raise SpecError("DuplicateTerm", index=i, term=e.term)
            seen.add(e.term)
            words[e.term] = w
        known: set[str] = set()
        for i, g in enumerate(guards):
            if canonical_words(g, config) != [g]:
                raise SpecError("NonCanonicalGuard", index=i)
            if g in seen:
                raise SpecError("GuardIsTerm", index=i)
            if g in known:
                raise SpecError("DuplicateGuard", index=i)
            known.add(g)
        self.config, self.guards, self.penalty = config, sorted(known, key=str.encode), penalty
        self.entries = sorted(entries, key=lambda e: e.term.encode())
        self.index = {e.term: i for i, e in enumerate(self.entries)}
        self.widest = max(len(w) for w in words.values())
        # longest first, then in order
        self.parts = sorted((i for i, e in enumerate(self.entries) if e.substring), key=lambda i: (-len(self.entries[i].term.encode()), i))
        single = [i for i, e in enumerate(self.entries) if len(words[e.term]) == 1] if penalty is not None else []
        self.longest = max((len(self.entries[i].term) for i in single), default=0)
        self.by_delete: dict[str, list[int]] = {}
        for i in single:
            for d in deletes(self.entries[i].term, edits_allowed(len(self.entries[i].term))):
                self.by_delete.setdefault(d, []).append(i)

        self._repaired: dict[str, tuple[int, int] | None] = {}

    def __len__(self) -> int:
        return len(self.entries)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_repaired": {}}

    def find(self, term: str) -> int | None:
        return self.index.get(term)

    def fingerprint(self) -> bytes:
        parts = [FINGERPRINT_TAG, self.config.fingerprint().encode()]
        for e in self.entries:
            parts += [e.term.encode(), e.tag.encode(), b"sub" if e.substring else b"tok"]
        repair = "repair=off" if self.penalty is None else f"repair=typos;penalty={self.penalty}"
        return framed(*parts, b"guards", *map(str.encode, self.guards), repair.encode())

    def repair(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the cheapest term that is not the word itself; of words met before, from a memo of bounded size."""
        if len(word) < MIN_REPAIR_CHARS or len(word) - 2 > self.longest:
            return None
        if word not in self._repaired:
            if len(self._repaired) >= MEMO:
                self._repaired.clear()
            self._repaired[word] = self._repair(word)
        return self._repaired[word]

    def _repair(self, word: str) -> tuple[int, int] | None:
        if self.penalty is None or word in self.guards or len(word) < MIN_REPAIR_CHARS or len(word) - 2 > self.longest:
            return None
        near = {i for d in deletes(word, 2) for i in self.by_delete.get(d, ())}
        costs = [(c, i) for i in near if (c := repair_cost(word, self.entries[i].term, edits_allowed(len(self.entries[i].term)))) and c[0]]
        return (min(costs)[1], min(costs)[0][0]) if costs else None

    def lookup(self, text: Normalized) -> Lookup:
        """From left to right, each free token starts at most one hit: the longest exact term, else a substring, else a repair.
        A look-alike never hits; it is flagged if its skeleton is a term."""
        if text.config != self.config:
            raise SpecError("ConfigMismatch")
        found, tokens, i = Lookup(), text.tokens, 0
        while i < len(tokens):
            t, width = tokens[i], 1
            if t.free and t.confusable:
                if (e := self.index.get(t.skeleton or "")) is not None:
                    found.flags.append(Flag(e, i, t.span, t.confusable))
            elif t.free:
                phrase, best = [], None
                for u in tokens[i : i + self.widest]:
                    if not u.free or u.confusable or u.sentence != t.sentence:
                        break
                    phrase.append(u.text)
                    if (e := self.index.get(" ".join(phrase))) is not None:
                        best, width = e, len(phrase)
                if best is not None:
                    found.hits.append(Hit(best, i, i + width, (t.span[0], tokens[i + width - 1].span[1]), "exact"))
                elif (e := next((k for k in self.parts if len(t.text.encode()) > len(self.entries[k].term.encode()) and self.entries[k].term in t.text), None)) is not None:
                    found.hits.append(Hit(e, i, i + 1, t.span, "substring"))
                elif r := self.repair(t.text):
                    found.hits.append(Hit(r[0], i, i + 1, t.span, "repaired", r[1], min(1000, r[1] * self.penalty)))
            i += width
        return found


def overlap(query: Normalized, candidate: Normalized) -> int:
    """Thousandths of the candidate's distinct free words of three characters or more that the query has too."""
    if query.config != candidate.config:
        raise SpecError("ConfigMismatch")
    wanted = {t.text for t in candidate.tokens if t.free and len(t.text) >= MIN_OVERLAP_CHARS}
    have = {t.text for t in query.tokens if t.free and not t.confusable}
    return 1000 * len(wanted & have) // len(wanted) if wanted else 0
