"""Texts as arrays of code points, and the classes of characters the tokenizers ask for."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
# Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (with the end as last entry)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
