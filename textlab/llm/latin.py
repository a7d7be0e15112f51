"""The words of a byte-level tokenizer, cut fast in texts of Latin letters."""

from __future__ import annotations

import re
import unicodedata

#: Characters from here on are left to the tokenizer's own tables.
BEYOND = 0x250
#: Finds a character that ``latin_words`` does not know.
beyond_latin = re.compile(f"[^\\x00-\\u{BEYOND - 1:04x}]").search


def _class(initial: str) -> str:
    """Characters below ``BEYOND`` whose Unicode category starts with ``initial``, for a pattern."""
    return "".join(f"\\u{c:04x}" for c in range(BEYOND) if unicodedata.category(chr(c))[0] == initial)


def _pattern() -> re.Pattern:
    """The tokenizer's pattern over characters below ``BEYOND``: contractions, letters,
    numbers, other characters (each with one space before), and white space."""
    letter, number, space = _class("L"), _class("N"), r"\x09-\x0d\x20\x85\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


latin_words = _pattern().findall
