"""Random prose for the tests of the text operators."""

import random

WORDS = "the river under old stone bridge carries small boats past quiet farms where people grow apples and sell bread every morning before rain falls on green hills near town".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randrange(6, 12))
        words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) + str(rng.randrange(40)) for _ in range(k)]
        out += [words[0].capitalize(), *words[1:-1], words[-1] + "."][:k] if k > 1 else words
    return " ".join(out)
