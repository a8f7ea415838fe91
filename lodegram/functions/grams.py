"""Grams of text: the folding that the index and the needles share, and windows of code points."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case code point by code point. What a JVM's lower() makes of dotted capital I (two code points) and
    of a final sigma depends on more than the code point, so these two are mapped first."""
    return F.lower(F.translate(_col(c), "İΣ", "iσ"))


def grams(c: Column | str, size: int | Column | str = GRAM, case_insensitive: bool | Column = True) -> Column:
    """All windows of size code points in order, repeats kept, as an array.

    Null if the text, size or case_insensitive is null; empty if the text is shorter than size; a size under 1 is an
    error. size may differ by row.
    """
    text = _col(c)
    if isinstance(case_insensitive, bool):
        text = fold(text) if case_insensitive else text
    else:
        text = F.when(case_insensitive, fold(text)).when(~case_insensitive, text)
    fixed = isinstance(size, int)
    if fixed and size < 1:
        raise ValueError("gram size must be at least 1")
    n = F.lit(size) if fixed else _col(size)

    def windows_of(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(p) - n)
        if fixed and size <= 8:
            return F.transform(starts, lambda i: F.concat(*[F.get(p, i + k) for k in range(size)]))
        return F.transform(starts, lambda i: F.array_join(F.slice(p, (i + 1).cast("int"), n.cast("int")), ""))

    # the outer lambda binds the code points, which would else be split again for every window
    windows = F.get(F.transform(F.array(F.split(text, "")), windows_of), 0)
    found = F.when(F.char_length(text) < n, F.array().cast("array<string>")).when(F.char_length(text) >= n, windows)
    if fixed:
        return found
    return F.when(n < 1, F.raise_error(F.lit("gram size must be at least 1")).cast("array<string>")).otherwise(found)


def needle_grams(spark: SparkSession, needle: str, size: int = GRAM, case_insensitive: bool = True) -> tuple[str, list[str]]:
    """The folded needle and its different grams in order of their first place; none if it is too short.

    The session folds it, by the same expression as the index's texts.
    """
    # over a local relation Catalyst computes this without a job
    row = spark.sql("SELECT * FROM VALUES (1)").select((fold(F.lit(needle)) if case_insensitive else F.lit(needle)).alias("t"), F.array_distinct(grams(F.lit(needle), size, case_insensitive)).alias("g")).first()
    return row.t, list(row.g)
