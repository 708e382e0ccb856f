"""Exact ranks in a hash order without sending a group to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, by: list[str], id_col: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """Add ``out``: the place of a row in its group, ordered by md5(seed:id), then id, from 1.

    Rows are ranked inside 4,096 hash buckets of a group; the rows before a bucket come from a
    running sum over bucket counts, which are at most 4,096 a group whatever the group's size.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    marked = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    left, right = marked.alias("l"), counts.alias("r")
    on = F.col("l._b") == F.col("r._b")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.join(right, on).select("l.*", "r._before")
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col))
    return joined.withColumn(out, F.col("_before") + own).drop("_h", "_b", "_before")


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the columns of ``by``; null meets null, so a group without a name is a group too."""
    other = right.select(*(F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in right.columns))
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))
    return left.join(other, on, how).drop(*(f"_by_{c}" for c in by))


def quantile_cell(df: DataFrame, by: list[str], value: str, cells: int = 64, out: str = "_c") -> DataFrame:
    """Add ``out``: the cell of a number among approximate quantiles of its group, so that one far
    value doesn't put all others into one cell. Cells are in the order of the values; null is in -1."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 1_000).alias("_cuts"))
    cell = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    return join_by(df, cuts, by).withColumn(out, cell).drop("_cuts")


def value_rank(df: DataFrame, by: list[str], value: Column, tie: str, descending: bool = False, out: str = "rank", cells: int = 64) -> DataFrame:
    """Add ``out``: the place of a row in its group by a number, then ``tie``, from 1.

    Rows are ranked inside cells of about as many rows each; the rows before a cell come from a
    running sum over cell counts. Rows of one value share a cell.
    """
    marked = df.withColumn("_v", (-value if descending else value).cast("double"))
    celled = quantile_cell(marked, by, "_v", cells)
    counts = celled.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    order = F.desc(tie) if descending else F.asc(tie)
    own = F.row_number().over(Window.partitionBy(*by, "_c").orderBy("_v", order))
    return join_by(celled, counts, [*by, "_c"]).withColumn(out, F.col("_before") + own).drop("_v", "_c", "_before")
