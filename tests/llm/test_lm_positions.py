"""Positions that the language model learns from."""

import numpy as np

from segue.llm import lm_score


def test_every_position_is_a_target_once(monkeypatch):
    seen = np.zeros(lm_score.OUTPUTS, np.int64)
    monkeypatch.setattr(lm_score.Model, "step", lambda self, one, two, target, noise, log_noise: np.add.at(seen, target, 1))
    streams, at = [], 1
    for size in (1, 1, 1, 1, 2, 3, 40, 300):  # every output stands once
        streams.append(np.arange(at, at + size, dtype="<u2"))
        at += size
    model = lm_score.Model.fresh(np.ones(lm_score.OUTPUTS))
    log_noise = np.full(lm_score.OUTPUTS, -np.log(lm_score.OUTPUTS))
    used = [lm_score.train_local(model, streams, turn, lm_score.ROUNDS, 0, log_noise)[1] for turn in range(lm_score.ROUNDS)]
    assert sum(used) == at - 1 and (seen[1:at] == 1).all() and seen.sum() == at - 1
