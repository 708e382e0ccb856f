"""Joins of overlapping ranges without all pairs of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges meet in stretches of so many characters.
STRETCH = 256


def _stretches(start: str, end: str, width: int) -> Column:
    first = F.floor(F.col(start) / width)
    return F.sequence(first, F.greatest(first, F.floor((F.col(end) - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, by: str, at: tuple[str, str], other: tuple[str, str], width: int = STRETCH) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` of the same ``by`` whose range shares a character; left rows
    without one have nulls. ``at`` and ``other`` name start and end of the two sides, whose other columns differ.

    Both sides are dealt to the stretches they touch, so a document is spread over tasks and a range meets
    the others near it only. A pair is kept in the first stretch it shares; a left row comes out once for
    each stretch in which it has no pair, so aggregate over left rows. Rows without a range keep one row.
    """
    a = left.withColumn("_cell", F.explode_outer(_stretches(*at, width))).withColumn("_first", F.floor(F.col(at[0]) / width))
    b = right.withColumn("_other_cell", F.explode(_stretches(*other, width))).withColumn("_other_first", F.floor(F.col(other[0]) / width)).withColumnRenamed(by, "_other_by")
    meet = (F.col(by) == F.col("_other_by")) & (F.col("_cell") == F.col("_other_cell")) & (F.col(at[0]) < F.col(other[1])) & (F.col(at[1]) > F.col(other[0]))
    once = F.col("_cell") == F.greatest("_first", "_other_first")
    return a.join(b, meet & once, "left").drop("_cell", "_first", "_other_by", "_other_cell", "_other_first")
