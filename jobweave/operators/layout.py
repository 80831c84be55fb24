"""How a document is laid out: columns from the places of its words, hidden characters, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, as shares of a page's width: least span of text, the middle, ends of the two sides, least gap between them.
LEAST_SPAN, MIDDLE, LEFT, RIGHT, LEAST_GAP = 0.30, (0.30, 0.70), 0.40, 0.50, 0.10
#: Characters under so many points, or whiter than this, are hidden.
SMALL, WHITE = 4.0, 0.95


def columns(xs: Column, width: Column) -> Column:
    """1 or 2 columns, from the left edges of a page's words (an array, in any order)."""
    low, high = F.array_min(xs), F.array_max(xs)
    inside = F.filter(xs, lambda x: x.between(width * MIDDLE[0], width * MIDDLE[1]))
    left, right = F.filter(xs, lambda x: x < width * LEFT), F.filter(xs, lambda x: x > width * RIGHT)
    apart = (F.size(left) >= 2) & (F.size(right) >= 2) & (F.array_min(right) - F.array_max(left) > width * LEAST_GAP)
    return F.when(F.coalesce(F.size(xs), F.lit(0)) <= 0, 1).when(high - low < width * LEAST_SPAN, 1).when(F.size(inside) == 0, 2).when(apart, 2).otherwise(1)


def hidden(size: Column, colour: Column) -> Column:
    """Whether a character is too small or too white to be seen; ``colour`` is grey, RGB or CMYK as an array of shares."""
    n = F.size(colour)
    white = F.when(n == 4, F.forall(colour, lambda c: c <= 1 - WHITE)).when(n.isin(1, 3), F.forall(colour, lambda c: c >= WHITE))
    return F.coalesce(size < SMALL, F.lit(False)) | F.coalesce(white, F.lit(False))


def escaped(text: Column) -> Column:
    """Text that may stand in HTML; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


#: Readiness from points, less five for each flag.
READY, UNREADY, FLAG_POINTS = 75, 50, 5


def readiness(points: Column, flags: Column) -> Column:
    """"high", "medium" or "low" for a readability score with so many flags."""
    left = points - FLAG_POINTS * flags
    return F.when(left >= READY, "high").when(left <= UNREADY, "low").otherwise("medium")
