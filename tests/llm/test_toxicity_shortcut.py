"""Tokens of letters that cannot be an indicator are not decoded; the weights are those of decoding all."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwright.llm import toxicity
from stepwright.llm.toxicity import indicators_of, readings

_RNG = np.random.default_rng(1)
_MODEL = toxicity.language_model(_RNG.integers(1, 50, toxicity.SYMBOLS**3))
_SCORER = toxicity.Scorer(_MODEL, {"idiot": (3.0, 0.9), "bal*": (2.0, 0.0), "ass": (2.5, 0.8), "lol": (1.6, 0.0), "élan": (1.7, 0.0)})


def plainly(token: str) -> tuple[float, float]:
    found = [_SCORER.weights[x] for w in readings(token, _SCORER.restorer) for x in indicators_of(w) if x in _SCORER.weights]
    return (max(w for w, _ in found), max(p for _, p in found)) if found else (0.0, 0.0)


@given(st.text(alphabet="idotbalsé$!1.,'- ", max_size=10))
@settings(max_examples=600, deadline=None)
def test_weights_of_any_token(token):
    assert _SCORER._weight(token) == plainly(token)


def test_weights_of_stretched_words():
    rng = random.Random(3)
    for word in ("idiot", "ballon", "ass", "lol", "élan", "other", "bbal", "oidiot") * 60:
        token = "".join(c * rng.choice([1, 1, 2, 3]) for c in word) + rng.choice(["", ",", "!", "$"])
        assert _SCORER._weight(token) == plainly(token)
