"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that count as white space at the ends of a text, as ``(?U)\\s`` has them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:(?<! )|(?!\S))\s*", " "))  # a single space, the usual case, is left as it is


def words(c: Column) -> Column:
    """The words of a text, none for a blank one."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def folded(c: Column) -> Column:
    """Lower case as a pattern of any case compares it: the four other letters whose case form is an ASCII letter become that letter."""
    other = reduce(lambda a, b: a | b, [c.contains(x) for x in "ſıİ\u212a"])
    return F.lower(F.when(other, F.translate(c, "ſıİ\u212a", "siik")).otherwise(c))


def any_of(low: Column, parts: Sequence[str]) -> Column:
    """Whether a ``folded`` text holds one of the parts, which are in lower case."""
    return reduce(lambda a, b: a | b, [low.contains(x) for x in parts])


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def first_capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def choose(c: Column, table: dict[str, object], default: object) -> Column:
    """The entry of a small table, or the default."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def cut(c: Column, n: int, mark: str = "") -> Column:
    """At most ``n`` characters, then ``mark`` where something was cut."""
    short = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(short, F.lit(mark))).otherwise(c) if mark else short


def distinct_matches(c: Column, pattern: str, most: int) -> Column:
    """Matches of a pattern, trimmed, distinct in the order of first sight, at most ``most``."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), strip)), 1, most)


def count_of(c: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def marker_counts(c: Column, markers: Sequence[str]) -> Column:
    """Occurrences of each marker, those without any left out; markers lose their outer spaces as keys."""
    counts = F.map_from_arrays(literals([m.strip() for m in markers]), F.array(*[count_of(c, m) for m in markers]))
    return F.map_filter(counts, lambda _, n: n > 0)
