"""Made-up texts, and column names that clash with those of the operators."""

import random

# Names the operators use for their own results or inside.
CLASHING = ["id", "score", "size", "words", "row", "keys", "target", "taken", "label", "found", "n", "copies", "toxicity"]


def prose(seed, n):
    """n made-up words, different for each seed."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sha", "po", "vel"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
