"""Rows of a chunk are decoded in step, with the paths that each has by itself."""

import numpy as np

from quillspan.operators import model


def test_rows_in_step_have_their_own_paths():
    w, g = model.random_weights(1), np.random.default_rng(0)
    for k in range(40):
        n = g.integers(1, 9)
        lengths = g.integers(1, 12, n)
        e = g.standard_normal((n, lengths.max(), model.N)).astype(np.float32) * 3
        e = np.round(e) if k % 2 else e  # ties
        assert model.viterbi_rows(e, lengths, w) == [model.viterbi(e[r, : lengths[r]], w) for r in range(n)]


def test_no_row_is_decoded_alone(monkeypatch):
    monkeypatch.setattr(model, "viterbi", None)
    got = model.parse_batch(["1, ROAD, Berlin", None, "a"], model.random_weights(2), True)
    assert [r["status"] for r in got] == ["unassessed", "unsupported", "unassessed"]
    assert model.encode("é\ud800") is None and model.encode("é") is not None
