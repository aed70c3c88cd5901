"""Small made-up texts."""

import numpy as np


def near_texts(n: int, seed: int = 11) -> list[tuple[int, str]]:
    """Texts of which most are edited copies of a few, with more and fewer edits."""
    r = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in r.integers(0, 5000, k)]
    bases = [word(int(r.integers(30, 160))) for _ in range(8)]
    out = []
    for k in range(n):
        if k % 5 == 4:
            words = word(int(r.integers(1, 80)))
        else:
            words = list(bases[int(r.integers(0, 2 if k % 2 else 8))])
            for _ in range(int(r.integers(0, 6))):
                at = int(r.integers(0, len(words)))
                words[at:at + int(r.integers(0, 2))] = word(int(r.integers(0, 2)))
        out.append((k, " ".join(words)))
    return out
