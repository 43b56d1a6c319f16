"""Small documents with copies, shared passages, odd white space and empty texts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def messy(n: int = 60, seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "Ko", "ré", "süd", "x") for b in ("n", "ti", "lo", "ß", "", "um")]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "a b c")]
    texts: list[list[str]] = []
    for i in range(6, n):
        kind = rng.random()
        if texts and kind < 0.35:
            tokens = rng.choice(texts)[:]
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
        else:
            tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
            if kind > 0.7:
                at = rng.randrange(len(tokens))
                tokens[at:at] = passage[rng.randrange(20):]
        texts.append(tokens)
        text = tokens[0]
        for w in tokens[1:]:
            text += rng.choice((" ", " ", " ", "\n", "\t", "  ", "\x0b")) + w
        out.append((i, text))
    rng.shuffle(out)
    return out
