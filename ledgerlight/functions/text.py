"""Words, overlaps and cuts of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(WHITE))


def word_set(text: Column | str) -> Column:
    """Distinct lower-case words; empty for blank text."""
    words = F.split(F.lower(_col(text)), _SPACE)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def collapse(text: Column | str) -> Column:
    """Trimmed, lower-cased, runs of white space as one blank."""
    return F.lower(F.regexp_replace(strip(text), _SPACE, " "))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all words of two word sets; 0 when either is empty."""
    x, y = _col(a), _col(b)
    shared = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - shared
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / total).otherwise(F.lit(0.0))


def snippet(text: Column | str, chars: int = 500) -> Column:
    return F.substring(_col(text), 1, chars)
