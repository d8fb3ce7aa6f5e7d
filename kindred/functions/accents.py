"""Accent folding: compatibility decomposition without combining marks, as column expressions.

What is left of a character does not depend on its neighbours: decomposition only
reorders combining marks, and those go. So each character is looked up by itself, in
pages of 256 code points that are worked out once from Unicode's own data.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL = 0xAC00  # first of the syllables, which are put together by arithmetic
_LEADS, _VOWELS, _TAILS = 19, 21, 28  # fixed values
_LAST_PAGE = 0x30000  # no later character is decomposed; what lies there combines with nothing


def _folded(code: int) -> str | None:
    """What is left of a character, or None if it stays as it is."""
    c = chr(code)
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return None if plain == c else plain


@cache
def _pages() -> str:
    """Array of pages, an array of folded characters each; null where nothing changes."""
    hangul = range(_HANGUL, _HANGUL + _LEADS * _VOWELS * _TAILS)
    pages = []
    for first in range(0, _LAST_PAGE, 256):
        page = [None if code in hangul else _folded(code) for code in range(first, first + 256)]
        pages.append(page if any(x is not None for x in page) else None)
    return json.dumps(pages)


def _letters(first: int, count: int) -> Column:
    return F.array(*(F.lit(chr(first + i)) for i in range(count)))


def _jamo(code: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    at = code - _HANGUL
    lead = F.get(_letters(0x1100, _LEADS), F.floor(at / (_VOWELS * _TAILS)).cast("int"))
    vowel = F.get(_letters(0x1161, _VOWELS), F.floor(at % (_VOWELS * _TAILS) / _TAILS).cast("int"))
    tails = F.array(F.lit(""), *(F.lit(chr(0x11A7 + i)) for i in range(1, _TAILS)))
    return F.concat(lead, vowel, F.get(tails, at % _TAILS))


def fold_accents(c: Column) -> Column:
    """Plain form of accented and compatibility characters; runs of ASCII pass through whole.

    Null stays null, and the empty text empty.
    """
    pages = F.from_json(F.lit(_pages()), "array<array<string>>")

    def fold(piece: Column) -> Column:
        code = F.ascii(piece)
        plain = F.get(F.get(pages, F.shiftright(code, 8)), code.bitwiseAND(F.lit(255)))
        syllable = code.between(_HANGUL, _HANGUL + _LEADS * _VOWELS * _TAILS - 1)
        return F.when(code < 128, piece).when(syllable, _jamo(code)).otherwise(F.coalesce(plain, piece))

    pieces = F.regexp_extract_all(c, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), 0)
    return F.array_join(F.transform(pieces, fold), "")
