import pytest

from adjudica.kernels.model import Confidence, Millis, Question, Scores, Span, Trail, candidate_question, check_ranked, label


def test_numbers():
    assert Millis(-1000) == -1000 and Millis.saturating(5000) == 1000 and Millis(-3).to_confidence() == 0
    assert Confidence(900).plus(200) == 1000 and Confidence(5).minus(9) == 0 and Confidence(451).halved() == 225
    for make, bad in ((Millis, 1001), (Millis, -1001), (Confidence, -1), (Confidence, 1001), (Confidence, True)):
        with pytest.raises(ValueError):
            make(bad)


def test_spans_and_labels():
    a = Span(1, 4)
    assert str(a) == "1..4" and len(a) == 3 and 3 in a and 4 not in a and a.overlaps(Span(3, 9)) and not a.overlaps(Span(4, 9)) and a.cover(Span(7, 9)) == Span(1, 9) and Span(1, 3).slice("aé") == "é"
    for bad in ("", " a", "x" * 257):
        with pytest.raises(ValueError):
            label(bad)
    with pytest.raises(ValueError):
        Span(3, 2)


def test_questions_and_scores():
    q = Question("choice", "q", ("a", "b"))
    assert q.arity == 2 and q.index_of("b") == 1 and q.index_of("z") is None and Question("noul", "n").labels() == ("no", "yes")
    for bad in (("choice", "q", ("a",)), ("choice", "q", ("a", "a")), ("choice", "", ("a", "b")), ("noul", "n", ("a", "b")), ("x", "q", ("a", "b"))):
        with pytest.raises(ValueError):
            Question(*bad)
    s = Scores(q)
    s.set(0, 500)
    s.raise_to(0, 400)
    s.add(1, 900)
    s.add(1, 900)
    s.sub(0, 100)
    assert s.values == [400, 1000]
    with pytest.raises(ValueError):
        s.set(2, 1)
    assert candidate_question("c", ["b", "a"]).options == ("a", "b")
    with pytest.raises(ValueError):
        candidate_question("c", ["a", "a"])
    assert check_ranked([[1, 9], [0, 5], [2, 5]])
    for bad in ([], [[0, 1], [1, 2]], [[0, 1], [0, 1]], [[1, 5], [0, 5]]):
        with pytest.raises(ValueError):
            check_ranked(bad)
    t = Trail()
    t.push("rules", "x", span=Span(0, 1), millis=5)
    assert t.records == [{"step": 1, "stage": "rules", "span": {"start": 0, "end": 1}, "millis": 5, "text": "x"}]
