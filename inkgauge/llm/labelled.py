"""Labelled documents from which the rules of problem 1 are learned.

The project's tables carry no labels, so documents of known shape are written here by rule: prose and verse in four
languages, titles, lists, tables, junk and mixtures, which are labelled by what makes up most of their characters. Words
are made of random syllables between common words; nothing is taken from the tables.
"""

from __future__ import annotations

import random
import string

from inkgauge.llm.words import COMMON

#: Documents that rules are learned from; a bound, whatever the size of the table they are applied to.
TRAINING_DOCUMENTS = 6000

_SYLLABLES = [a + b for a in "b br d f g kl l m n p r s st t tr v".split() for b in "a e i o u ai en or is un".split()]


def _word(r: random.Random, least: int = 1, most: int = 4) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(least, most)))


def _running(r: random.Random, lang: str, n: int, common: float, own: list[str] | None = None) -> list[str]:
    """n words, of which a share are common ones; the others come from own or are new."""
    other = (lambda: r.choice(own)) if own else (lambda: _word(r, 1, 5))
    return [r.choice(COMMON[lang]) if r.random() < common else (other() if r.random() < 0.93 else str(r.randint(1, 2000))) for _ in range(n)]


def _vocabulary(r: random.Random) -> list[str]:
    """The words of one text, which come again in it."""
    longest = r.choice([3, 4, 6])
    return [_word(r, 1, longest) for _ in range(r.choice([6, 12, 25, 60, 150]))]


def _frames(r: random.Random, lang: str, common: float, least: int, most: int) -> list[list[str]]:
    """Word sequences with gaps, from which sentences or lines of one text are made."""
    return [[w if r.random() < common else "" for w in _running(r, lang, r.randint(least, most), 1.0)] for _ in range(r.choice([1, 2, 4, 40]))]


def _filled(r: random.Random, frame: list[str], own: list[str]) -> list[str]:
    return [w or (r.choice(own) if r.random() < 0.93 else str(r.randint(1, 2000))) for w in frame]


def prose(r: random.Random, size: int) -> str:
    lang, common, own, parts = r.choice(list(COMMON)), r.uniform(0.13, 0.6), _vocabulary(r), []
    frames = _frames(r, lang, common, 6, 26)
    while sum(map(len, parts)) < size:
        words = _filled(r, r.choice(frames), own)
        if len(words) > 10 and r.random() < 0.5:
            words[len(words) // 2] += ","
        parts.append(" ".join(words).capitalize() + r.choice("....?!"))
    glue = r.choice([" ", " ", "\n", "\n\n"])
    text = "".join(p + (glue if r.random() < 0.3 else " ") for p in parts).strip()
    return text if r.random() < 0.85 else text[: max(40, len(text) - r.randint(1, 60))]  # some are cut


def remark(r: random.Random, _size: int) -> str:
    """One short sentence, which may hold no common word."""
    words = _running(r, r.choice(list(COMMON)), r.randint(4, 12), r.choice([0.0, r.uniform(0, 0.5)]))
    if r.random() < 0.2:
        words[len(words) // 2] += r.choice([":", ","])
    return " ".join(words).capitalize() + r.choice("..?!")


def verse(r: random.Random, size: int) -> str:
    lang, common, own, lines = r.choice(list(COMMON)), r.uniform(0.3, 0.6), _vocabulary(r), []
    frames = _frames(r, lang, common, 6, 9)
    while sum(map(len, lines)) < size:
        lines.append(" ".join(_filled(r, r.choice(frames), own)) + r.choice(["", "", "", ",", ".", ";"]))
        if r.random() < 0.2:
            lines.append("")
    return "\n".join(lines).strip() + r.choice([".", "!", "?", ""])


def title(r: random.Random, _size: int) -> str:
    words = [_word(r, 2, 4).capitalize() for _ in range(r.randint(3, 8))]
    words[len(words) // 2] = r.choice(["of", "and", "in", "und", "de", "y"])
    return " ".join(words)


def listing(r: random.Random, size: int) -> str:
    lang, style, lines = r.choice(list(COMMON)), r.randrange(9), []
    most, bold = 5 if style == 8 else r.choice([4, 5, 5, 8, 12]), r.random() < 0.35
    while sum(map(len, lines)) < size or len(lines) < 3:
        n = len(lines) + 1
        mark = ["- ", "* ", "• ", f"{n}. ", f"{n}) ", f"{string.ascii_lowercase[n % 26]}) ", "[ ] ", "– ", ""][style]
        body = " ".join(_running(r, lang, r.randint(2, most), r.choice([0.0, r.uniform(0, 0.45)])))
        if r.random() < 0.3:
            body += f", {r.randint(1900, 2030)}"
        if style != 8 and (bold or r.random() < 0.05):
            body = f"**{body}**"
        lines.append(("  " if style != 8 and r.random() < 0.15 else "") + mark + body)
    return "\n".join(lines)


def table(r: random.Random, size: int) -> str:
    columns, style, lines = r.randint(3, 6), r.randrange(6), []
    cell = lambda: _word(r) if r.random() < 0.4 else f"{r.uniform(1, 1000):.{r.randint(0, 1)}f}"
    while sum(map(len, lines)) < size or len(lines) < 3:
        cells = [_word(r), *(cell() for _ in range(columns - 1))]
        lines.append(
            [" | ".join(cells), "| " + " | ".join(cells) + " |", "\t".join(cells), ",".join(cells), " & ".join(cells) + r" \\", "".join(c.ljust(16) for c in cells).rstrip()][style]
        )
    if style < 2:
        lines.insert(1, "|---" * columns + "|" if style else "-----+" * columns)
    if style == 4:
        lines = [r"\begin{tabular}{" + "l" * columns + "}", *lines, r"\end{tabular}"]
    return "\n".join(lines)


def junk(r: random.Random, size: int) -> str:
    kind = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10])
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if kind == 0:
        return " ".join(hexes(64) for _ in range(size // 65 + 1)) + f" 0x{hexes(4)}"
    if kind == 1:
        return "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(size)) + "=="
    if kind == 2:
        return "".join(r.choice("{}[]<>#$%^&*+=~|/\\_-!@ ") for _ in range(size))
    if kind == 3:
        return "".join(r.choice("ÃÂâ€¢¬¦§±¶»¼½¾¿ÐÑï™œ× ") for _ in range(size))
    if kind == 4:
        keys = r.choice(["asdfjkl;qweruiopzxcvnm", "qwertyuiopasdfghjklzxcvbnm", "ertyuio", "asdfgh jkl"])
        return " ".join("".join(r.choice(keys) for _ in range(r.randint(2, 12))) for _ in range(size // 8 + 1))
    if kind == 5:
        unit = " ".join(_running(r, "en", r.randint(1, 3), r.choice([0.0, 0.3])))
        return " ".join([unit] * (size // (len(unit) + 1) + 1))
    if kind == 6:
        return " ".join(_word(r, 2, 4) for _ in range(size // 7 + 3))
    if kind == 7:
        return "\n".join(f"[{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}] {_word(r, 1, 6)}.{_word(r, 1, 4)}:{r.randint(1, 900)} rc={r.randint(-2, 300)} 0x{hexes(8)}" for _ in range(size // 55 + 2))
    if kind == 8:
        return "\n".join(f'<div class="{_word(r)}-{r.randint(1, 99)}"><span data-k="{_word(r)}">&nbsp;</span></div>' for _ in range(size // 70 + 1))
    if kind == 9:
        return "".join(f"\\u{hexes(4)}" if r.random() < 0.5 else f"%{hexes(2).upper()}" for _ in range(size // 5 + 1))
    return "\n".join(f"{_word(r)}.{_word(r)}({_word(r)}:{r.randint(1, 900)}) -> 0x{hexes(8)} {{{r.randint(0, 9)};{r.randint(0, 9)}}}" for _ in range(size // 45 + 2))


def documents(n: int = TRAINING_DOCUMENTS, seed: int = 7) -> list[tuple[str, str]]:
    """(text, label) of n documents; label is prose, list, table or junk."""
    r = random.Random(seed)
    plain = [(prose, "prose"), (prose, "prose"), (verse, "prose"), (title, "prose"), (remark, "prose")]
    shaped = [(listing, "list"), (table, "table"), (junk, "junk")]
    out: list[tuple[str, str]] = []
    while len(out) < n:
        maker, label = r.choice(plain) if r.random() < 0.62 else r.choice(shaped)
        if label == "prose" or r.random() < 0.55:
            text = maker(r, r.randint(60, 1000))
        else:
            # A mixture; those near one half are left out, as their label would be a matter of counting.
            size, part = r.randint(300, 1200), r.choice([r.uniform(0.1, 0.42), r.uniform(0.58, 0.9)])
            own, other = maker(r, int(size * part)), prose(r, int(size * (1 - part)))
            share = len(own) / (len(own) + len(other))
            if 0.45 < share < 0.55:
                continue
            label = label if share > 0.5 else "prose"
            text = "\n\n".join([other, own] if r.random() < 0.7 else [own, other])
        if maker not in (title, remark) and r.random() < 0.1:
            text = r.choice(["Key points:", "Punkte:", "Here:"]) + "\n" + text
        out.append((text, label))
    return out
