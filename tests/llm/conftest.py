import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented prose."""

    def make(seed: int, words: int) -> str:
        r = random.Random(seed)
        parts = ["an", "er", "the", "tion", "ou", "ea", "st", "nd", "ha", "wh", "en", "in"]
        return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(words))

    return make
