"""Small tables and plain readings of the definitions, independent of the operators."""

from __future__ import annotations

import random
import re
import unicodedata


def plain_words(text):
    if text is None:
        return []
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").lower()
    return [w for w in re.split(r"[\W_]+", text) if w]


def similarity(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


NAMES = [x + y for x in "ba ke li mo nu ra se ti vo wu".split() for y in "dor fin gal hun jar kel lor mir nov pol".split()]
COMMON = "the of and to in is was that for on with as it be by at from or which this but not are his an they have had all one".split()


def sentence(draw: random.Random, n: int = 14) -> str:
    return " ".join(draw.choice(COMMON) if draw.random() < 0.6 else f"{draw.choice(NAMES)}{draw.randrange(400)}" for _ in range(n)).capitalize() + "."


def edited(draw: random.Random, text: str, edits: int) -> str:
    out = text.split()
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.random()
        if kind < 0.4:
            out[at] = draw.choice(COMMON)
        elif kind < 0.7:
            out.insert(at, draw.choice(NAMES))
        elif len(out) > 1:
            del out[at]
    return " ".join(out)


def dressed(draw: random.Random, text: str) -> str:
    """The same words in another dress."""
    text = draw.choice([str.upper, str.lower, str])(text)
    text = text.replace(" ", draw.choice([" ", "  ", " \t", " - "]))
    return draw.choice(["", "  ", "\n"]) + text.replace("a", draw.choice(["a", "a​"])) + draw.choice(["", "!", " ..."])
