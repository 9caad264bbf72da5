"""The small values that decisions are made of, each valid by construction."""

from __future__ import annotations

from dataclasses import dataclass, field

from .decide import ARBITRATION_STAGE

MAX_LABEL_BYTES, MAX_OPTIONS = 256, 65535


def _whole(value: int, low: int, high: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{what} {value!r} is not in {low}..{high}")
    return value


class Millis(int):
    """A similarity in thousandths, -1000 to 1000."""

    LOW, HIGH = -1000, 1000

    def __new__(cls, value: int):
        return super().__new__(cls, _whole(value, cls.LOW, cls.HIGH, cls.__name__))

    @classmethod
    def saturating(cls, value: int):
        return cls(max(cls.LOW, min(cls.HIGH, value)))

    def to_confidence(self) -> Confidence:
        return Confidence(max(0, int(self)))


class Confidence(Millis):
    """0 to 1000."""

    LOW = 0

    def plus(self, other: int) -> Confidence:
        return Confidence.saturating(int(self) + int(other))

    def minus(self, other: int) -> Confidence:
        return Confidence.saturating(int(self) - int(other))

    def halved(self) -> Confidence:
        return Confidence(int(self) // 2)


def label(text: str) -> str:
    if not text or text != text.strip() or len(text.encode()) > MAX_LABEL_BYTES:
        raise ValueError(f"label {text!r} is empty, untrimmed or longer than {MAX_LABEL_BYTES} bytes")
    return text


@dataclass(frozen=True, order=True)
class Span:
    """Bytes start..end of an original text."""

    start: int
    end: int

    def __post_init__(self):
        if not 0 <= self.start <= self.end < 2**32:
            raise ValueError(f"span {self.start}..{self.end}")

    def __len__(self) -> int:
        return self.end - self.start

    def __str__(self) -> str:
        return f"{self.start}..{self.end}"

    def __contains__(self, position: int) -> bool:
        return self.start <= position < self.end

    def slice(self, text: str) -> str:
        return text.encode()[self.start : self.end].decode()

    def overlaps(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end

    def cover(self, other: Span) -> Span:
        return Span(min(self.start, other.start), max(self.end, other.end))


@dataclass(frozen=True)
class Question:
    """noul: no (0) or yes (1); choice and score: two or more distinct labels, of which the first is the safe default."""

    shape: str
    name: str
    options: tuple[str, ...] = ()

    def __post_init__(self):
        label(self.name)
        if self.shape not in ("noul", "choice", "score"):
            raise ValueError(f"unknown shape {self.shape!r}")
        if self.shape == "noul":
            if self.options:
                raise ValueError("a yes-or-no question has no options of its own")
            return
        for o in self.options:
            label(o)
        if not 2 <= len(self.options) <= MAX_OPTIONS:
            raise ValueError(f"{len(self.options)} options")
        if len(set(self.options)) < len(self.options):
            raise ValueError("duplicate option")

    @property
    def arity(self) -> int:
        return 2 if self.shape == "noul" else len(self.options)

    def labels(self) -> tuple[str, ...]:
        return ("no", "yes") if self.shape == "noul" else self.options

    def index_of(self, option: str) -> int | None:
        return self.labels().index(option) if option in self.labels() else None


class Scores:
    """One confidence per option of a question."""

    def __init__(self, question: Question, values: list[int] | None = None):
        self.question, self.values = question, [Confidence(v) for v in (values if values is not None else [0] * question.arity)]
        if len(self.values) != question.arity:
            raise ValueError(f"{len(self.values)} scores for {question.arity} options")

    def _at(self, option: int) -> int:
        return _whole(option, 0, self.question.arity - 1, "option")

    def set(self, option: int, value: int) -> None:
        self.values[self._at(option)] = Confidence(value)

    def raise_to(self, option: int, value: int) -> None:
        self.values[self._at(option)] = max(self.values[option], Confidence(value))

    def add(self, option: int, value: int) -> None:
        self.values[self._at(option)] = self.values[option].plus(value)

    def sub(self, option: int, value: int) -> None:
        self.values[self._at(option)] = self.values[option].minus(value)


def check_ranked(order: list[list[int]]) -> list[list[int]]:
    """[option, confidence] pairs, best first, ties to the lower option, each option once, at least one."""
    for _, c in order:
        Confidence(c)
    if not order or len({i for i, _ in order}) < len(order) or order != sorted(order, key=lambda x: (-x[1], x[0])):
        raise ValueError("not a ranking")
    return order


#: The stages that journals know.
STAGES = ("normalize", "lexicon", "rules", "graph", "hdc", ARBITRATION_STAGE, "decide", "escalation")


@dataclass
class Trail:
    """Records in the order they were made, numbered from 1."""

    records: list[dict] = field(default_factory=list)

    def push(self, stage: str, text: str, rule_id: str | None = None, scorer: str | None = None, span: Span | None = None, millis: int = 0) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        record = {"step": len(self.records) + 1, "stage": stage, "rule_id": rule_id, "scorer": scorer, "span": span and {"start": span.start, "end": span.end}, "millis": int(Millis(millis)), "text": text}
        self.records.append({k: v for k, v in record.items() if v is not None})


def candidate_question(name: str, ids: list[str]) -> Question:
    """A choice among candidates: the i-th id in byte order is option i; repeated ids are refused."""
    if len(set(ids)) < len(ids):
        raise ValueError("duplicate candidate")
    return Question("choice", name, tuple(sorted(ids, key=str.encode)))
