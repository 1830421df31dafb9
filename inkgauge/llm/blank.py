"""Whether an output is no answer at all."""

from __future__ import annotations

import unicodedata

from inkgauge.llm.words import PLACEHOLDERS

_PLACEHOLDER = frozenset(PLACEHOLDERS)
_LONGEST = max(map(len, _PLACEHOLDER))
#: Marks without a letter or digit that are no answer.
MARKS = 8


def is_empty(output: str | None) -> bool:
    """True for null, white space, invisible characters, a bare label or a placeholder, and up to MARKS marks alone."""
    if output is None:
        return True
    plain: list[str] = []
    marks = 0
    for c in output:
        if c.isalnum():
            plain.append(c)
            if len(plain) > _LONGEST:
                return False
        elif not c.isspace() and unicodedata.category(c)[0] != "C":
            marks += 1
    return "".join(plain).lower() in _PLACEHOLDER or not plain and marks <= MARKS
