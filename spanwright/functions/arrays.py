"""Work on arrays in one row that stays in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: what stands in a lambda beside its variable is computed for each element."""
    return F.transform(F.array(value), use)[0]


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers.

    Each round adds what stands 1, 2, 4, ... places before, so n numbers take n log n steps; a
    fold that appends to an array would copy it at each element.
    """
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(lengths), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, lengths, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def marked(text: Column, pattern: str, mark: str = "\x01") -> Column:
    """The matches of ``pattern`` as structs (start, end, token) in order; marks in the text count as blanks.

    The text is cut at marks put around each match, so every other piece is one, and the pieces' lengths give the places.
    """
    pieces = F.split(F.regexp_replace(F.translate(text, mark, " "), pattern, f"{mark}$0{mark}"), mark)

    def spans(own: Column) -> Column:
        ends = running(F.transform(own, lambda p: F.length(p)))
        both = F.zip_with(own, ends, lambda p, end: F.struct((end - F.length(p)).alias("start"), end.alias("end"), p.alias("token")))
        return F.filter(both, lambda _, k: k % 2 == 1)

    return let(pieces, spans)
