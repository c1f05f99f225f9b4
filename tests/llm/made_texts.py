"""Texts for the tests."""

from __future__ import annotations

import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    stems = ["anon", "ther", "tion", "ous", "with", "oring", "el", "ater", "the", "of", "and", "ing"]
    return " ".join(rng.choice(stems) + rng.choice(["", rng.choice(stems)]) for _ in range(words))
