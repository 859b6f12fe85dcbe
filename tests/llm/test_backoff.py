"""Parts of the language model by themselves: packed numbers and the traversal in stretches."""

import numpy as np

from ledgerloom.llm import backoff


def test_planes_hold_numbers_of_any_width():
    for x in (np.zeros(0, np.int64), np.zeros(5, np.int64), np.array([0, 255, 256, 2**40], np.int64), np.array([0, 2**64 - 1, 3], np.uint64), np.array([70000], np.uint32)):
        got = backoff.unplanes(backoff.planes(x), x.dtype.type)
        assert got.dtype == x.dtype and (got == x).all()
    assert len(backoff.unpack(backoff.planes(np.arange(1000, dtype=np.int64)), np.uint8)) == 2001  # before: 8 bytes a number


def test_a_long_document_takes_few_steps(monkeypatch):
    """Stretches are traversed together and give what one traversal gives (before: a step for each token of the longest)."""
    rng = np.random.default_rng(4)
    words, n = 40, np.array([5000, 3, 700, 256, 257, 1])
    begins, place = np.cumsum(n) - n, rng.integers(1, 40, n.sum())
    place[begins + n - 1] = 0
    word, last = (x.reshape(-1) for x in np.meshgrid(np.arange(words), np.arange(words), indexing="ij"))
    kept = (rng.random(len(word)) < 0.5) & (word + last > 0)
    history = np.repeat(np.flatnonzero(kept & (last != 0)), 3)
    pair = last[history] * words + np.tile([0, 7, 19], len(history) // 3)
    history, pair = history[kept[pair]], pair[kept[pair]]
    share = [rng.uniform(0.01, 1, k) for k in (words, words, len(word), len(word), len(history))]
    model = backoff.Automaton(*share[:3], word, last, kept, share[3], history, pair, np.ones(len(history), bool), share[4])
    walk, taken, step = model.walker(), [], backoff.Automaton.step
    monkeypatch.setattr(backoff.Automaton, "step", lambda self, *x: (taken.append(1), step(self, *x))[1])
    monkeypatch.setattr(backoff, "WIDE", 0)
    assert np.allclose(model.score(place, begins, n), [walk(place[a:a + k].tolist(), 1, 0.0) for a, k in zip(begins, n, strict=True)], rtol=1e-12)
    assert len(taken) <= backoff.STRETCH + backoff.AHEAD
