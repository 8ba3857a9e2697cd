"""Romanisation of Brahmic scripts and accent folding, for Python workers."""

from __future__ import annotations

import unicodedata

from recordweave.functions.fixed import CONSONANTS, DIGIT_ZERO, OTHER_SIGNS, SILENT_SIGNS, VIRAMA, VOWEL_SIGNS, VOWELS

INHERENT = "a"
FIRST, LAST = 0x0900, 0x0D7F


def _kind(c: str) -> int:
    return ord(c) & 0x7F if FIRST <= ord(c) <= LAST else -1


def romanise(text: str | None) -> str | None:
    """text with Brahmic letters in Roman ones; everything else stays.

    A consonant carries its vowel sign, none after a virama, and else an a if another consonant or sign follows. A final
    consonant carries none. Signs without a sound and unknown code points of the blocks go. Null gives null.
    """
    if not text or not any(FIRST <= ord(c) <= LAST for c in text):
        return text
    out: list[str] = []
    open_consonant = False  # the last letter is a consonant that may still take its inherent vowel
    for c in text:
        k = _kind(c)
        if k in SILENT_SIGNS:
            continue
        if open_consonant:
            open_consonant = False
            if k in VOWEL_SIGNS:
                out.append(VOWEL_SIGNS[k])
                continue
            if k == VIRAMA:
                continue
            if k in CONSONANTS or k in OTHER_SIGNS:
                out.append(INHERENT)
        if k < 0:
            out.append(c)
        elif k in CONSONANTS:
            out.append(CONSONANTS[k])
            open_consonant = True
        elif DIGIT_ZERO <= k < DIGIT_ZERO + 10:
            out.append(str(k - DIGIT_ZERO))
        else:
            out.append(VOWELS.get(k) or OTHER_SIGNS.get(k) or VOWEL_SIGNS.get(k) or "")
    return "".join(out)


def fold(text: str | None) -> str | None:
    """text in compatibility form without combining marks."""
    if not text or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
