"""Text canonicalisation with a map back to the bytes of the original, protected spans, tokens and sentences.

Everything is kept per character: each canonical character knows the byte range of the original that it stands for.
A character that only was lower-cased to one of the same bytes, or not changed, stands for its own bytes; what came of a
recomposed sequence stands for the whole sequence; the space for a run of white space for the run; a mark for the
run of marks it was collapsed from.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import regex

MAX_INPUT_BYTES = 16 * 1024 * 1024
#: Fixed value: names the algorithm and Unicode data in data versions.
ALGORITHM_TAG = "pua-text-v1;unicode-normalization=0.1.25;unicode-segmentation=1.13.3;unicode-security=0.1.2"
KINDS = ("fenced_code", "inline_code", "url", "path", "quoted", "number")

#: The characters of White_Space, for the quicker of the two pattern libraries.
_WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]")
_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{N}]")
_BOUND = regex.compile(r"(?V1w)\b")
#: Where a text holds nothing but ASCII and the letters up to U+024F (all of script Latin), words are found by one pattern: letters that a
#: mark of middle position may join, digits that another may, and low lines, one after another.
_BEYOND = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ“”–—…€«»¿¡]")
_SIMPLE_WORD = re.compile("(?:[A-Za-zÀ-ÖØ-öø-ɏ](?:['.:]?[A-Za-zÀ-ÖØ-öø-ɏ])*|[0-9](?:['.,;]?[0-9])*|_+)+")
_ASCII_MARK = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class TooLong(ValueError):
    def __init__(self, size: int):
        super().__init__(f"input is {size} bytes (max {MAX_INPUT_BYTES})")
        self.size = size


@dataclass(frozen=True)
class Config:
    """fold: unicode_lower or ascii_lower; punct: keep, or collapse runs of one repeated ASCII mark."""

    fold: str = "unicode_lower"
    punct: str = "keep"

    def __post_init__(self):
        if self.fold not in ("unicode_lower", "ascii_lower") or self.punct not in ("keep", "collapse"):
            raise ValueError(f"unknown configuration {self}")

    def fingerprint(self) -> str:
        return f"{ALGORITHM_TAG};fold={self.fold};punct={self.punct}"


@dataclass(slots=True)
class Token:
    text: str
    start: int  # canonical characters
    end: int
    span: tuple[int, int]  # original bytes
    zone: str | None  # kind of the protected span it overlaps
    sentence: int
    confusable: str | None = None  # MixedScript or Homoglyph
    skeleton: str | None = None

    @property
    def free(self) -> bool:
        return self.zone is None


@dataclass
class Normalized:
    original: str
    config: Config
    canonical: str = ""
    protected: list[tuple[str, int, int, tuple[int, int]]] = field(default_factory=list)  # kind, canonical start and end, original bytes
    sentences: int = 1
    skeletons: dict[str, str] = field(default_factory=dict)
    #: Per canonical character: first byte, end byte, and whether interior offsets are exact.
    lows: list[int] = field(default_factory=list)
    highs: list[int] = field(default_factory=list)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Original bytes of canonical characters start..end; of none, a point."""
        if not self.lows:
            return 0, 0
        if start >= end:
            if start < len(self.lows):
                return self.lows[start], self.lows[start]
            last = self.highs[-1] if self.exact_end else self.lows[-1]
            return last, last
        return self.lows[start], self.highs[end - 1]

    exact_end: bool = True

    @cached_property
    def tokens(self) -> list[Token]:
        """Found when they are first asked for."""
        return _tokens(self)

    def to_original(self, start: int, end: int) -> tuple[int, int]:
        """As span, for canonical byte offsets; those within a character move outward."""
        offsets = byte_offsets(self.canonical)
        start = min(max(start, 0), offsets[-1])
        end = max(start, min(end, offsets[-1]))
        if start == end:
            k = bisect.bisect_left(offsets, start)
            return self.span(k, k)
        return self.span(bisect.bisect_right(offsets, start) - 1, bisect.bisect_left(offsets, end))


@lru_cache
def _composing() -> frozenset[str]:
    """Characters that may compose with one before them (NFC_Quick_Check = Maybe)."""
    found = set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3)))
    for code in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(code))
        if parts and parts[0] != "<" and len(pair := parts.split()) == 2 and unicodedata.is_normalized("NFC", chr(code)):
            found.add(chr(int(pair[1], 16)))
    return frozenset(found)


@lru_cache(1 << 16)
def _starts_chunk(c: str) -> bool:
    if c < "\x80":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _composing() and unicodedata.is_normalized("NFC", first)


def byte_offsets(text: str) -> list[int]:
    """The first byte of each character in UTF-8, and the number of all."""
    if text.isascii():
        return list(range(len(text) + 1))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return [0, *(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)).cumsum().tolist()]


def _composed(text: str) -> tuple[str, Sequence[int], Sequence[int], list[bool]]:
    """NFC, with the byte range of the original for each of its characters, and whether it was left as it was."""
    if text.isascii():
        return text, range(len(text)), range(1, len(text) + 1), [True] * len(text)
    at = byte_offsets(text)
    if unicodedata.is_normalized("NFC", text):
        return text, at[:-1], at[1:], [True] * len(text)
    out, lows, highs, same = [], [], [], []
    starts = [i for i, c in enumerate(text) if i == 0 or _starts_chunk(c)]
    for s, e in zip(starts, [*starts[1:], len(text)]):
        chunk = text[s:e]
        made = unicodedata.normalize("NFC", chunk)
        out.append(made)
        if made == chunk:
            lows += at[s:e]
            highs += at[s + 1 : e + 1]
            same += [True] * (e - s)
        else:
            lows += [at[s]] * len(made)
            highs += [at[e]] * len(made)
            same += [False] * len(made)
    return "".join(out), lows, highs, same


# --- protected spans --------------------------------------------------------------------------------------------------

_URL = regex.compile(r"(?i:https?|ftp|file)://|(?i:www)\.")
_PATH = regex.compile(r"~/|\.\.?/")
_NUMBER = regex.compile(r"[vV]?[0-9]+(?:\.[0-9]+)+")
_NOTABLE = re.compile(r"[/\\]|[wW]{3}\.|[0-9]\.[0-9]")  # in every URL, path and number
_TRAILING, _LEADING = ".,;:!?)]}'\">", "([<{"


def token_kind(token: str) -> str | None:
    """url, path or number, of a white-space delimited token without the marks around it."""
    if _URL.match(token) or "://" in token:
        return "url"
    if _PATH.match(token) or (("/" in token or "\\" in token) and _WORDLIKE.search(token)):
        return "path"
    return "number" if _NUMBER.fullmatch(token) else None


def protected_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters, by place. What was found first wins over what overlaps it: fenced code, inline code,
    straight quotes, curly quotes, then URLs, paths and numbers."""
    taken: list[tuple[int, int, str]] = []  # sorted; none overlaps another

    def clash(s: int, e: int) -> bool:
        k = bisect.bisect_left(taken, (e,))
        return k > 0 and taken[k - 1][1] > s

    for opening, closing, kind in (("```", "```", "fenced_code"), ("`", "`", "inline_code"), ('"', '"', "quoted"), ("“", "”", "quoted")):
        at = 0
        while (s := text.find(opening, at)) >= 0:
            at = s + len(opening)
            if clash(s, s + 1):
                continue
            e = text.find(closing, at)
            if e < 0:
                if kind == "fenced_code":  # an open fence runs to the end
                    bisect.insort(taken, (s, len(text), kind))
                break
            e += len(closing)
            if not clash(s, e):
                bisect.insort(taken, (s, e, kind))
                at = e
    at = 0  # only what white space delimits around a notable place can be a URL, path or number
    while m := _NOTABLE.search(text, at):
        first, at = m.start(), _SPACE.search(text, m.end() - 1)
        at = at.start() if at else len(text)
        while first and not _SPACE.match(text[first - 1]):
            first -= 1
        raw = text[first:at]
        end = first + len(raw.rstrip(_TRAILING))
        start = at - len(raw.lstrip(_LEADING))
        if start < end and (kind := token_kind(text[start:end])) and not clash(start, end):
            bisect.insort(taken, (start, end, kind))
    return taken


# --- look-alikes ------------------------------------------------------------------------------------------------------

#: Scripts that are told apart; others count as one.
_SCRIPTS = (
    "Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar "
    "Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian Hiragana Katakana Bopomofo Han Yi Gothic Coptic Glagolitic Nko Vai Lisu Tifinagh Deseret Osage Adlam"
).split()
_TOGETHER = (("Han", "Bopomofo"), ("Han", "Hiragana", "Katakana"), ("Han", "Hangul"))


@lru_cache
def _script_tests() -> list[regex.Pattern]:
    groups = [(s,) for s in _SCRIPTS] + list(_TOGETHER)
    tests = [regex.compile("(?:" + "|".join(rf"\p{{scx={s}}}" for s in (*g, "Common", "Inherited")) + ")*") for g in groups]
    others = "".join(rf"\p{{scx={s}}}" for s in _SCRIPTS)
    return [*tests, regex.compile(f"[^{others}]*")]


def single_script(word: str) -> bool:
    return any(t.fullmatch(word) for t in _script_tests())


#: Look-alikes of ASCII letters that need no outside table; a full table is taken from the JVM (see sources.confusables).
BASIC_SKELETONS: dict[str, str] = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "ο": "o", "ν": "v", "α": "a", "ﬂ": "fl", "ﬁ": "fi", "m": "rn",
}


def skeleton(word: str, table: dict[str, str]) -> str:
    return unicodedata.normalize("NFD", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", word)))


#: Accented Latin letters keep their accents in a skeleton and are Latin: no word of these alone with ASCII looks like another.
_LATIN = frozenset(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1 and c not in "ŀĿŉ") | frozenset(map(chr, range(0x21, 0x7F)))


def look_alike(word: str, table: dict[str, str]) -> tuple[str | None, str | None]:
    """(MixedScript or Homoglyph or None, ASCII skeleton or None)."""
    if word.isascii():
        return None, None
    if all(c in _LATIN for c in word):
        return None, None
    s = skeleton(word, table)
    plain = s if s.isascii() and s != word else None
    if not single_script(word):
        return "MixedScript", plain
    return ("Homoglyph", plain) if plain is not None else (None, None)


_RUN = re.compile(f"(?P<space>[{_WHITE}]+)|(?P<word>[^{_WHITE}]+)")
_WIDE = re.compile(f"[{_WHITE}]{{2,}}")
_OTHER_SPACE = re.compile(f"(?! )[{_WHITE}]")
_DOUBLED = re.compile(r"([!-/:-@\[-`{-~])\1")


def _one_to_one(text: str) -> bool:
    """Whether lower() makes one character of each, whatever stands around it."""
    return text.isascii() or "Σ" not in text and all(len(c.lower()) == 1 for c in set(text))


# --- the whole --------------------------------------------------------------------------------------------------------


def lower(c: str, fold: str) -> str:
    """Lower-case one character, without regard to those around it."""
    if fold == "ascii_lower":
        return c.lower() if c < "\x80" else c
    return "σ" if c == "Σ" else c.lower()


_SENTENCE_END = re.compile("[.!?] ")


def sentence_starts(canonical: str) -> list[int]:
    """A sentence starts at 0 and after each of . ! ? that a space follows, in protected spans too."""
    return [0] + [m.end() for m in _SENTENCE_END.finditer(canonical)]


def normalize(text: str, config: Config = Config(), skeletons: dict[str, str] = BASIC_SKELETONS) -> Normalized:
    size = len(text.encode("utf-8", "surrogatepass"))
    if size > MAX_INPUT_BYTES:
        raise TooLong(size)
    nfc, lows, highs, same = _composed(text)
    n = Normalized(text, config, skeletons=skeletons)
    out: list[str] = []  # pieces
    length, verbatim = 0, True  # characters so far; whether the last one is as it was

    def put(chars: str, first: int, last: int) -> None:
        """One canonical piece that stands for NFC characters first..last as a whole."""
        nonlocal length
        out.append(chars)
        length += len(chars)
        n.lows.extend([lows[first]] * len(chars))
        n.highs.extend([highs[last]] * len(chars))

    def copy(chars: str, first: int) -> None:
        """Characters that stand for one NFC character each."""
        nonlocal length
        out.append(chars)
        length += len(chars)
        n.lows.extend(lows[first : first + len(chars)])
        n.highs.extend(highs[first : first + len(chars)])

    gap: tuple[int, int] | None = None

    def close_gap() -> None:
        nonlocal gap
        if gap and length:
            put(" ", *gap)
        gap = None

    def free(start: int, end: int) -> None:
        """Text outside spans: stretches without wide gaps at once where each character becomes one, else word by word."""
        nonlocal gap, verbatim
        while start < end:
            wide = _WIDE.search(nfc, start, end)
            stop = wide.start() if wide else end
            s, e = start, stop
            while s < e and _SPACE.match(nfc[s]):
                s += 1
            while s < e and _SPACE.match(nfc[e - 1]):
                e -= 1
            core = nfc[s:e]
            if core and (config.fold == "unicode_lower" or core.isascii()) and (config.punct == "keep" or not _DOUBLED.search(core)) and _one_to_one(core):
                low = core.lower()
                words(start, s)
                close_gap()
                copy(_OTHER_SPACE.sub(" ", low), s)
                verbatim = low[-1] == core[-1] and same[e - 1]
                words(e, stop)
            else:
                words(start, stop)
            start = wide.end() if wide else end
            if wide:
                words(wide.start(), start)

    def words(start: int, end: int) -> None:
        nonlocal gap, verbatim
        for m in _RUN.finditer(nfc, start, end):
            s, e = m.span()
            if m.lastgroup == "space":
                gap = (gap[0] if gap else s, e - 1)
                continue
            close_gap()
            word = m[0]
            low = word.lower() if config.fold == "unicode_lower" or word.isascii() else "".join(lower(c, config.fold) for c in word)
            if (config.punct == "keep" or not _DOUBLED.search(word)) and (config.fold == "unicode_lower" or word.isascii()) and _one_to_one(word):
                copy(low, s)
                verbatim = low[-1] == word[-1] and same[e - 1]
                continue
            mark = None
            for i, c in enumerate(word, s):
                if config.punct == "collapse" and c == mark:
                    n.highs[-1], verbatim = highs[i], False
                    continue
                mark = c if c in _ASCII_MARK else None
                made = lower(c, config.fold)
                put(made, i, i)
                verbatim = made == c and same[i]

    at = 0
    for start, end, kind in protected_spans(nfc):
        free(at, start)
        close_gap()
        first = length
        copy(nfc[start:end], start)
        n.protected.append((kind, first, length, n.span(first, length)))
        at, verbatim = end, same[end - 1]
    free(at, len(nfc))
    n.canonical = "".join(out)
    n.exact_end = verbatim
    n.sentences = len(_SENTENCE_END.findall(n.canonical)) + 1
    return n


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words by UAX 29 that hold a letter or digit."""
    if not _BEYOND.search(text):
        return [m.span() for m in _SIMPLE_WORD.finditer(text) if m[0][0] != "_" or m[0].strip("_")]
    bounds = [m.start() for m in _BOUND.finditer(text)]
    if bounds[:1] != [0]:
        bounds.insert(0, 0)
    if bounds[-1] != len(text):
        bounds.append(len(text))
    # the library lets an apostrophe begin a word before a vowel, which the standard does not
    return [(s + (text[s] in "'\u2019"), e) for s, e in zip(bounds, bounds[1:]) if text[s:e].isalnum() or _WORDLIKE.search(text, s, e)]


def _tokens(n: Normalized) -> list[Token]:
    starts, out = sentence_starts(n.canonical), []
    ends = [p[2] for p in n.protected]
    sentence, upcoming, lows, highs = 0, 1, n.lows, n.highs
    if not ends and len(starts) == 1 and n.canonical.isascii():
        return [Token(m[0], s, e, (lows[s], highs[e - 1]), None, 0) for m in _SIMPLE_WORD.finditer(n.canonical) for s, e in [m.span()] if m[0].strip("_")]
    for s, e in word_places(n.canonical):
        word = n.canonical[s:e]
        while upcoming < len(starts) and starts[upcoming] <= s:
            sentence, upcoming = upcoming, upcoming + 1
        zone = None
        if ends:
            k = bisect.bisect_right(ends, s)
            zone = n.protected[k][0] if k < len(ends) and n.protected[k][1] < e else None
        out.append(Token(word, s, e, (lows[s], highs[e - 1]), zone, sentence, *((None, None) if word.isascii() else look_alike(word, n.skeletons))))
    return out


def _bytes_before(text: str, places: np.ndarray) -> np.ndarray:
    """byte_offsets of some places."""
    if text.isascii():
        return places
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.r_[0, (1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)).cumsum()][places]


def token_columns(n: Normalized) -> tuple[np.ndarray, list[str], list[str | None], list[tuple[str | None, str | None]]]:
    """The tokens by column, without an object for each: rows of numbers (place, start, end in canonical bytes, first, end in original bytes,
    sentence), words, zones, and look-alikes with skeletons."""
    places = word_places(n.canonical)
    if not places:
        return np.zeros((6, 0), dtype=np.int64), [], [], []
    text, first, last = n.canonical, [p[0] for p in places], [p[1] for p in places]
    starts, ends = np.array(first), np.array(last)
    words = [text[s:e] for s, e in places]
    spans = [n.lows[s] for s in first], [n.highs[e - 1] for e in last]
    sentences = np.searchsorted(sentence_starts(text), starts, side="right") - 1
    zones: list[str | None] = [None] * len(words)
    if n.protected:
        k = np.searchsorted([p[2] for p in n.protected], starts, side="right")
        for i in np.flatnonzero(k < len(n.protected)).tolist():
            kind, begin, *_ = n.protected[k[i]]
            if begin < last[i]:
                zones[i] = kind
    plain = (None, None)
    alike = [plain] * len(words) if text.isascii() else [plain if w.isascii() else look_alike(w, n.skeletons) for w in words]
    return np.stack([np.arange(len(words)), _bytes_before(text, starts), _bytes_before(text, ends), *map(np.array, spans), sentences]), words, zones, alike
