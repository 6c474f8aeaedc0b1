"""The fit of the CRF stays small on the driver, and cutting a chain changes nothing."""

import tracemalloc

import numpy as np

from folio.llm import toxicity


def test_fit_takes_few_bytes_a_word(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    monkeypatch.setattr(toxicity, "STEPS_AT_ONCE", 1 << 14, raising=False)
    rng = np.random.default_rng(1)
    names = [f"word{k}" for k in range(500)]
    texts = [" ".join([*rng.choice(names, 500), *["vile"] * (k % 2)]) for k in range(400)]
    tracemalloc.start()
    model = toxicity.fit(texts, [k % 2 for k in range(400)], 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.fitted
    assert peak < 130 * 400 * 500


def test_chains_in_parts_are_the_same_chains(monkeypatch):
    rng = np.random.default_rng(2)
    first, last = toxicity._ends(rng.integers(0, 90, 60))
    e = rng.normal(size=len(first)) * 3
    whole = toxicity.ratios(e, first, last, (0.1, -0.4, 0.3, 0.8), -0.5)
    monkeypatch.setattr(toxicity, "STEPS_AT_ONCE", 100)
    parts = toxicity.ratios(e, first, last, (0.1, -0.4, 0.3, 0.8), -0.5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    x, trans, r = np.exp(np.clip(e, -30, 30)), np.exp([0.1, -0.4, 0.3, 0.8]), None
    for k in range(len(e)):
        r = x[k] * np.exp(-0.5) if first[k] else x[k] * (trans[1] + trans[3] * r) / (trans[0] + trans[2] * r)
        assert np.isclose(r, parts[0][k])
