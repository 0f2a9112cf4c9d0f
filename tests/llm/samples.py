"""Invented prose for the tests of this folder."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))
