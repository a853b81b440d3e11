"""Linear-time folds over arrays and texts in DataFrame functions.

``aggregate`` with ``concat`` copies what it has at each step. Here an array is
folded in runs of RUN elements, whose totals are folded after that, and a text
is cut into blocks of BLOCK code points before many parts of it are taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256
BLOCK = 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and whatever the optimiser merges."""
    return F.transform(F.array(value), body)[0]


def _runs(values: Column, run: int) -> Column:
    n = F.ceil(F.size(values) / run).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda b: F.slice(values, b * run + 1, F.lit(run)))


def _fold(values: Column, join) -> Column:
    """The fold of all elements before each element, from 0; for short arrays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _before(values: Column, join, run: int) -> Column:
    def whole(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: join(acc, x).cast("int")))
        return F.flatten(F.zip_with(runs, _fold(totals, join), lambda r, s: F.transform(_fold(r, join), lambda x: join(x, s).cast("int"))))

    return let(values, lambda v: let(_runs(v, run), whole))


def sums_before(values: Column, run: int = RUN) -> Column:
    """Of an array of ints: the sum of the elements before each element."""
    return _before(values, lambda a, b: a + b, run)


def greatest_before(values: Column, run: int = RUN) -> Column:
    """Of an array of ints from 0: the greatest of the elements before each element, 0 at first."""
    return _before(values, lambda a, b: F.greatest(a, b), run)


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The text in blocks of ``size`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(held: Column, start: Column, size: Column, block: int = BLOCK) -> Column:
    """``size`` code points from ``start`` (from 0) of a text in ``blocks``; the work follows the part's size."""
    first = F.floor(start / block).cast("int")
    last = F.floor((start + size - 1) / block).cast("int")
    own = F.array_join(F.slice(held, first + 1, last - first + 1), "")
    return F.when(size > 0, F.substring(own, (start - first * block + 1).cast("int"), size.cast("int"))).otherwise(F.lit(""))
