"""Column helpers shared by the operators that use built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def running(values: Column, zero: str, plus: Callable[[Column, Column], Column]) -> Column:
    """What comes before each value of an array when they are folded by the associative ``plus`` from the SQL value ``zero``.

    A fold that appends copies its array at each step, so it runs over pieces
    of about the root of the size, and over the pieces' totals.
    """

    def folded(x: Column) -> Column:
        start = F.expr(f"named_struct('at', {zero}, 'out', filter(array({zero}), x -> false))")
        step = lambda s, v: F.struct(plus(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(x, start, step)

    def of(x: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x))).cast("int"))

        def by(w: Column) -> Column:
            pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda k: folded(F.slice(x, k * w + 1, w)))
            joined = lambda p: F.zip_with(p, folded(F.transform(p, lambda y: y["at"]))["out"], lambda y, base: F.transform(y["out"], lambda v: plus(base, v)))
            return F.flatten(let(pieces, joined))

        return let(width, by)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.filter(values, lambda x: F.lit(False)))


_BLOCK = 256


def blocks(text: Column) -> Column:
    """A text as an array of runs of ``_BLOCK`` code points, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def piece(of: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given as ``blocks``; the cost is that of the piece, wherever it stands."""
    first = F.floor(start / _BLOCK).cast("int")
    near = F.array_join(F.slice(of, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
    return F.substr(near, start - first * _BLOCK + 1, F.greatest(end - start, F.lit(0)))


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value) of the pattern's leftmost non-overlapping matches, in code points."""

    def placed(both: Column) -> Column:
        # Text between the matches gives their places.
        sizes = F.transform(both["hits"], lambda hit, i: F.length(F.get(both["gaps"], i)) + F.length(hit))
        ends = lambda before: F.transform(
            both["hits"],
            lambda hit, i: F.struct(
                (F.get(before, i) + F.length(F.get(both["gaps"], i))).alias("start"), (F.get(before, i) + F.length(F.get(both["gaps"], i)) + F.length(hit)).alias("end"), hit.alias("value")
            ),
        )
        return let(running(sizes, "0", lambda a, b: a + b), ends)

    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return let(F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("gaps")), placed)
