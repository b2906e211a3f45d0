"""Words of damaged subtitle texts, as arrays over a whole batch.

Case, accents, punctuation, numbers, markup and the encoding that a file was read in do not change a word:
a word with ASCII letters is its ASCII letters alone, lower-cased, so an accented letter is left out whatever became of it
(é, e with a mark, é read as Latin-1 or as Cyrillic, U+FFFD); characters that recognition confuses are one (l I 1, O 0, rn m).
A word without ASCII letters is its Cyrillic or other letters; Cyrillic in UTF-8 read as Latin-1, or in Windows-1251 read as
Latin-1, is read again.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tokensift.llm.codepoints import code_points

#: Stands between texts laid end to end.
BREAK = "\x1d"
_SEPARATOR, _DROP, _ASCII, _DIGIT, _HIGH, _LETTER = range(6)
#: Characters that recognition confuses, each before the one that stands for both.
CONFUSED = "li 0o 1i 5s 8b"

_WHITE = re.compile(r"[ \n]")
#: Markup of the usual layouts, and sound descriptions in brackets.
MARKUP = re.compile(r"<[^<>\n\x1d]{1,200}>|\{[^{}\n\x1d]{1,40}\}")
SOUNDS = re.compile(r"\[(?!/?url)[^\[\]\x1d]{1,80}\]|\([^()\x1d]{1,80}\)|\*[^*\n\x1d]{1,60}\*")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point below 0x10000, its value in a word, and the Cyrillic letter behind a Latin-1 one."""
    kinds, values, behind = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint32), np.zeros(0x10000, np.uint32)
    for c in range(0x80, 0x10000):
        if 0xD800 <= c <= 0xF8FF:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if c < 0xC0 and c not in (0xA8, 0xB8):
            kinds[c] = _SEPARATOR if c in (0x85, 0xA0) else _DROP
        elif c <= 0xFF:
            kinds[c] = _HIGH
        elif c < 0x250 or kind[0] == "M" or kind == "Cf" or c == 0xFFFD:
            kinds[c] = _DROP
        elif kind[0] == "L":
            kinds[c], values[c] = _LETTER, ord(ch.lower()[0])
            base = unicodedata.normalize("NFD", ch.lower())[0]
            values[c] = ord(base)
    for c in (0xA8, 0xB8, *range(0xC0, 0x100)):
        behind[c] = values[ord(bytes([c]).decode("cp1251"))]
    for c in range(ord("a"), ord("z") + 1):
        kinds[[c, c - 32]] = _ASCII
        values[[c, c - 32]] = c
    for c in range(ord("0"), ord("9") + 1):
        kinds[c], values[c] = _DIGIT, c
    kinds[ord("'")] = _DROP
    for pair in CONFUSED.split():
        for c in {pair[0], pair[0].upper()}:
            values[ord(c)] = ord(pair[1])
    return kinds, values, behind


@lru_cache(1)
def _mix() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 0x10000, dtype=np.uint64) | np.uint64(1)


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of texts in order: hash, number of letters, text and first character of each."""

    hash: np.ndarray
    letters: np.ndarray
    text: np.ndarray
    start: np.ndarray

    def where(self, keep: np.ndarray) -> Words:
        return Words(self.hash[keep], self.letters[keep], self.text[keep], self.start[keep])


def joined(texts: list[str]) -> str:
    """The texts, each after a BREAK; a BREAK inside a text becomes a space."""
    out = BREAK + BREAK.join(texts)
    if out.count(BREAK) != len(texts):
        out = BREAK + BREAK.join(t.replace(BREAK, " ") for t in texts)
    return out


def parts(text: str, size: int = 1 << 21):
    """``text`` in parts of about ``size`` characters, cut at white space, each with its first position."""
    at = 0
    while len(text) - at > size:
        cut = _WHITE.search(text, at + size)
        if not cut:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


def words(text: str) -> Words:
    """The words of a joined text; a run of characters without a letter is no word.

    However long a text is, no more than a part of it is spread out as arrays of characters at a time.
    """
    out, before = [], 0
    for at, part in parts(text):
        own = _words(part)
        out.append(Words(own.hash, own.letters, own.text + before, own.start + at))
        before += part.count(BREAK)
    return out[0] if len(out) == 1 else Words(*(np.concatenate([getattr(w, f) for w in out]) for f in ("hash", "letters", "text", "start")))


def _words(text: str) -> Words:
    kinds, values, behind = _tables()
    p = code_points(text)
    p = np.where(p < 0x10000, p, 0)
    breaks = np.cumsum(p == ord(BREAK))
    after = np.append(p[1:], 0)
    lead = ((p == 0xD0) | (p == 0xD1)) & (after >= 0x80) & (after < 0xC0)
    kind = kinds[p]
    blank = np.flatnonzero(p == 0xA0)
    kind[blank[np.isin(p[blank - 1], (0xC2, 0xC3))]] = _DROP
    mark = (p >= 0x300) & (p < 0x370)
    if mark.any():  # an accented letter in two characters goes as a whole
        base = np.flatnonzero(mark[1:] & ~mark[:-1])
        kind[base[kind[base] == _ASCII]] = _DROP
    value = values[p]
    if lead.any():
        at = np.flatnonzero(lead)
        letters = ((p[at] - 0xC0) << 6) | (p[at + 1] & 0x3F)
        kind[at], value[at] = kinds[letters], values[letters]
        kind[at + 1] = _DROP
    inside = kind != _SEPARATOR
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    of = np.cumsum(first) - 1
    ascii_, high = kind == _ASCII, kind == _HIGH
    n_ascii = np.add.reduceat(ascii_, starts, dtype=np.int64)
    latin = (n_ascii > 0)[of]
    part = ascii_ | ((kind == _DIGIT) & latin & inside) | ((kind == _LETTER) & ~latin)
    if high.any():
        again = high & ~latin
        part |= again
        value = np.where(again, behind[p], value)
    r = np.flatnonzero((value[:-1] == ord("r")) & (value[1:] == ord("n")) & part[:-1] & part[1:])
    value[r] = ord("m")
    part[r + 1] = False
    count = np.cumsum(part)
    local = count - (count[starts] - part[starts])[of] - 1
    local = np.where(part, local, 0)
    powers = np.full(int(local.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    each = np.where(part, _mix()[value] * powers[local], np.uint64(0))
    hashes = scrambled(np.add.reduceat(each, starts, dtype=np.uint64))
    n = np.add.reduceat(part, starts, dtype=np.int64)
    keep = n > 0
    return Words(hashes[keep], n[keep], breaks[starts][keep] - 1, starts[keep])


def word_hashes(phrase: str) -> np.ndarray:
    return words(joined([phrase])).hash
