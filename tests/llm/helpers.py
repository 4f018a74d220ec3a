"""Invented documents for the tests."""

import random

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "ing", "schau", "ñez", "é", "ou", "wh", "st"]


def prose(rng, n, per_line=20):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


def edited(rng, text, share):
    return " ".join("x" + w if rng.random() < share else w for w in text.split(" "))
