"""Column builders for text that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain letters they fold to, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Pattern class of blanks, with those that a JVM regex doesn't count as white space.
BLANKS = r"[\s\u00A0\u2007\u2009\u202F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def squeeze(c: Column) -> Column:
    """Blanks of any kind become single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))
