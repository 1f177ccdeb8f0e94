"""Functions that walk a text in pieces give what they give for the whole text, however small the pieces; the fits against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import langid, minhash, repeats, toxicity

R = random.Random(11)
SPACES = [" ", "  ", "\n", " - ", "\t", ", "]
WORDS = ["a", "é", "ab", "straße", "नमस्ते", "12", "ΑΒΓ", "x" * 90, "don't", "\U0001f600"]


def text(n):
    return "".join(R.choice(WORDS) + R.choice(SPACES) for _ in range(n))


TEXTS = ["", " ", "a", "ab", "   a", "a   ", "one two three four five", "x" * 500, " " * 500, *(text(n) for n in (1, 2, 3, 5, 8, 40, 400))]


def counted(arrays):
    return Counter(x for a in arrays for x in a.tolist())


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_trigrams(monkeypatch, step):
    """Counted, so none is lost, none is made and none comes twice."""
    whole = [counted(langid.grams(t)) for t in TEXTS]
    monkeypatch.setattr(langid, "STEP", step)
    assert [counted(langid.grams(t)) for t in TEXTS] == whole


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_grams(monkeypatch, step):
    """A set: those in the overlap of two pieces may come twice."""
    whole = [set(counted(toxicity.buckets(t))) for t in TEXTS]
    monkeypatch.setattr(toxicity, "STEP", step)
    assert [set(counted(toxicity.buckets(t))) for t in TEXTS] == whole


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_letters(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    assert [langid.has_letter(t) for t in TEXTS] == [any(c.isalpha() for c in t) for t in TEXTS]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_shingles(monkeypatch, step):
    whole = [minhash.shingles(t) for t in TEXTS]
    for t, s in zip(TEXTS, whole, strict=True):
        w = t.encode().lower().split()
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w)))
    monkeypatch.setattr(minhash, "STEP", step)
    for t, s in zip(TEXTS, whole, strict=True):
        assert b"".join(minhash.pieces(t.encode())) == t.encode()
        assert np.array_equal(minhash.shingles(t), s)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_windows(monkeypatch, step):
    """Every string of 20 bytes starts in one piece, once, and is whole there."""
    monkeypatch.setattr(repeats, "STEP", step)
    for t in TEXTS:
        raw = t.encode()
        got = [(k + i, x[i : i + 20].tobytes()) for k, x in repeats.pieces(t, 20) for i in range(len(x) - 19)]
        assert got == [(i, raw[i : i + 20]) for i in range(len(raw) - 19)]
