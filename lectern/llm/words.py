"""Words of a text: longest runs of Unicode letters and digits, lower-cased."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import regex

_EXACT = regex.compile(r"[\p{L}\p{Nd}]+")
_FAST = re.compile(r"[^\W_]+")
#: Characters that Python counts as alphanumeric but that are neither letters nor decimal digits.
_RARE = frozenset(chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isalnum() and unicodedata.category(chr(c))[0] != "L" and unicodedata.category(chr(c)) != "Nd")

#: The same rule for regexp_extract_all in a plan.
WORD_PATTERN = r"[\p{L}\p{Nd}]+"


def spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words of text."""
    return [m.span() for m in _EXACT.finditer(text)]


def words(text: str | None) -> list[str]:
    """The words of text in order; none of a null text."""
    if not text:
        return []
    found = _FAST.findall(text) if text.isascii() or _RARE.isdisjoint(text) else _EXACT.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def mix(h: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (splitmix finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
