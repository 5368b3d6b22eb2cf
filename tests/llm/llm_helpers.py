"""Helpers of these tests."""

import pytest


def vocabulary(name):
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path(name))


def prose(rng, n, vocab=None):
    vocab = vocab or ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "light", "paper", "green", "walks", "under", "seven", "hills", "quiet", "ocean"]
    return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
