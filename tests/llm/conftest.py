import random

import pytest

WORDS = "the of and to in is that it for as river stone cloud amber lantern willow harbor meadow copper violet thunder marble orchard saddle pepper cactus".split()


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words, half of them random syllables, in sentences and lines."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        out, line = [], 0
        for i in range(n):
            w = r.choice(WORDS) if r.random() < 0.4 else "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
            out.append(w)
            line += 1
            if line > 8 and r.random() < 0.2:
                out[-1] += "." + ("\n" if r.random() < 0.3 else "")
                line = 0
        return " ".join(out).replace("\n ", "\n")

    return make
