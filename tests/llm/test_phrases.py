"""op7_toxicity: texts are scored on the terms that training sees: phrases too, and each term once."""

from __future__ import annotations

import numpy as np

from streamlens.llm import toxicity


def test_phrases_are_scored():
    plain = toxicity.fit([])
    assert plain.score("I really HATE YOU all") > 0.7 > plain.score("you all") and plain.score("so shut up.") > 0.7
    rows = [({"fine", f"w{k}"}, set(), 0) for k in range(60)] + [({"fine", f"x{k}", "hate you"}, set(), 1) for k in range(20)]
    learned = toxicity.fit(rows)
    assert learned.score("fine x1 hate you") > 0.7 > learned.score("fine x1")


def test_a_term_counts_once():
    one = toxicity.Detector({"idio*": 3.0, "idiot": 1.0}, -4.0)
    for text in ("idiot", "idiot idiot.", "Idiot, idiots idiot!"):
        assert np.isclose(one.score(text), 0.5)
