"""op3_best_fit_packing: a run tells how far its result is from the lower bound."""

from __future__ import annotations

import logging

import pytest

from streamlens.llm import packing


@pytest.mark.parametrize(("lengths", "told"), [({6: 2, 4: 2}, "2 sequences, lower bound 2, 0 over it"), ({4: 3, 3: 3}, "3 sequences")])
def test_bound_is_logged(caplog, lengths, told):
    with caplog.at_level(logging.INFO, logger=packing.__name__):
        packing.bin_completion(lengths, 10)
    assert told in caplog.text and "lower bound" in caplog.text
