"""Helpers shared by the training-data operators: scratch tables (those of the session module) and Column building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.session import materialize, scratch_path

__all__ = ["SPACE", "let", "materialize", "prefix_sums", "regex_spans", "scratch_path"]

#: Words are runs of anything but these characters (space and the ASCII controls 9 to 13).
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column, chunk: int = 128) -> Column:
    """Array of exclusive prefix sums of an array of ints, in chunks so that long arrays stay near linear."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def with_sums(d: Column) -> Column:
        n_chunks = F.ceil(F.size(d) / F.lit(chunk)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: total(F.slice(d, c * chunk + 1, chunk)))

        def with_bases(s: Column) -> Column:
            bases = F.transform(s, lambda _, c: F.when(c > 0, total(F.slice(s, F.lit(1), c))).otherwise(F.lit(0).cast("long")))
            return let(
                bases,
                lambda b: F.transform(
                    d,
                    lambda _, i: F.get(b, F.floor(i / F.lit(chunk)).cast("int"))
                    + F.when(i % chunk > 0, total(F.slice(d, i - i % chunk + 1, i % chunk))).otherwise(F.lit(0).cast("long")),
                ),
            )

        return let(sums, with_bases)

    return F.when(F.size(values) > 0, let(values, with_sums)).otherwise(F.array().cast("array<long>"))


def regex_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,match>> in code points, end exclusive.

    The pieces between the matches (``split``) and the matches themselves give the places. ``guard`` is a
    cheap test that must hold wherever the pattern can match at all.
    """
    empty = F.array().cast("array<struct<start:long,end:long,match:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
            return let(
                prefix_sums(steps),
                lambda p: F.transform(
                    m,
                    lambda s, i: F.struct(
                        (F.get(p, i) + F.length(F.get(g, i))).cast("long").alias("start"),
                        (F.get(p, i) + F.length(F.get(g, i)) + F.length(s)).cast("long").alias("end"),
                        s.alias("match"),
                    ),
                ),
            )

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(empty)

    out = let(found, place)
    return out if guard is None else F.when(guard, out).otherwise(empty)
