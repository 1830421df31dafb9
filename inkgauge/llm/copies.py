"""Whether an answer gives back its prompt."""

from __future__ import annotations

import re

_WORD = re.compile(r"\w+")
#: Words of one shingle, words that an opening phrase may have, and the share of the rest that must come from the prompt.
SHINGLE, OPENING, SHARE = 4, 12, 0.9


def words_of(text: str) -> list[str]:
    """Case-folded words of text."""
    return _WORD.findall(text.casefold())


def copied(prompt: str, own: list[str]) -> bool:
    """True if own, the words_of() an answer, are prompt or the passage in it, but for case, spacing, an opening phrase or
    repetition.

    After at most OPENING words of its own, at most half of all, SHARE of the words must lie in runs of SHINGLE words (of
    all words, if there are fewer) that prompt has. Answers of fewer than 3 words are no copies.
    """
    if len(own) < 3:
        return False
    given = _WORD.findall(prompt.casefold())
    known = set(given)
    # Words that the prompt has at all: as many as the runs below must cover at least.
    if sum([w in known for w in own]) < SHARE * max(len(own) / 2, len(own) - OPENING):
        return False
    n = min(SHINGLE, len(own))
    runs = set(zip(*(given[i:] for i in range(n))))
    covered = bytearray(len(own))
    for i, run in enumerate(zip(*(own[i:] for i in range(n)))):
        if run in runs:
            covered[i : i + n] = b"\1" * n
    first = covered.find(1)
    if first < 0 or first > OPENING:
        return False
    rest = len(own) - first
    return rest >= 3 and sum(covered) >= SHARE * rest and rest * 2 >= len(own)
