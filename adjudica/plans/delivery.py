"""A worked specification: how a message that arrives during work is to be delivered (queue, steer or interrupt)."""

from __future__ import annotations

from ..kernels.classifier import Classifier
from ..kernels.decide import UNICODE_VERSION
from ..kernels.lexicon import Entry, Lexicon
from ..kernels.rules import Rule, RuleClass, RuleSet
from ..kernels.text import Config

#: Fixed values, which the recorded decisions' data version is computed over.
GUARDS = ["top", "op", "can", "halted"]
PENALTY_PER_EDIT = 150
NEGATORS, NEGATION_WINDOW = ["don't", "do not", "no need to", "no"], 3
TERMS = {
    "interrupt": ["stop", "cancel", "kill", "abort", "halt", "never mind", "forget it"],
    "steer": ["instead", "actually", "wait no", "rather", "change to", "switch to"],
    "queue": ["also", "after that", "afterwards", "next", "then", "and add", "when you're done"],
}
CUES = [
    ("interrupt.stop.v1", "interrupt", "stop", 900), ("interrupt.cancel.v1", "interrupt", "cancel", 900), ("interrupt.kill.v1", "interrupt", "kill", 850), ("interrupt.abort.v1", "interrupt", "abort", 850), ("interrupt.halt.v1", "interrupt", "halt", 850),
    ("interrupt.never_mind.v1", "interrupt", "never mind", 800), ("interrupt.forget_it.v1", "interrupt", "forget it", 800), ("steer.stop_using.v1", "steer", "stop {gerund}", 850), ("steer.instead.v1", "steer", "instead", 800),
    ("steer.actually.v1", "steer", "actually", 750), ("steer.wait_no.v1", "steer", "wait no", 800), ("steer.rather.v1", "steer", "rather", 750), ("steer.change_to.v1", "steer", "change to", 800), ("steer.switch_to.v1", "steer", "switch to", 800),
    ("queue.also.v1", "queue", "also", 800), ("queue.after_that.v1", "queue", "after that", 800), ("queue.afterwards.v1", "queue", "afterwards", 800), ("queue.next.v1", "queue", "next", 750), ("queue.then.v1", "queue", "then", 700),
    ("queue.and_add.v1", "queue", "and add", 800), ("queue.when_done.v1", "queue", "when you're done", 800),
]


def classifier(on_confusable: str = "abstain", skeletons: dict[str, str] | None = None, unicode: tuple[int, int, int] = UNICODE_VERSION) -> Classifier:
    """*unicode*: RECORDED_UNICODE to replay recorded journals."""
    config = Config("unicode_lower", "collapse")
    entries = [Entry(term, tag) for tag, terms in TERMS.items() for term in terms]
    rules = [Rule(i, c, p, w, forbids=("negation",)) for i, c, p, w in CUES]
    classes = [RuleClass(c, "max") for c in ("queue", "steer", "interrupt")]
    return Classifier("pua-steer/1", "delivery", Lexicon(entries, GUARDS, PENALTY_PER_EDIT, config), RuleSet(classes, rules, NEGATORS, NEGATION_WINDOW, config), config, on_confusable, skeletons, unicode)


def rules_file() -> dict:
    """The rules in the form of a specification file."""
    cues = [{"id": i, "class": c, "pattern": p, "weight_millis": w, "forbids": ["negation"], "version": 1} for i, c, p, w in CUES]
    return {"negators": NEGATORS, "negation_window": NEGATION_WINDOW, "classes": [{"name": c, "scorer": "max"} for c in ("queue", "steer", "interrupt")], "rules": cues}
