"""Points in ranges of one key: a join on intervals instead of a comparison of all pairs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: The dyadic nodes that make up the positions from ``__a`` up to ``__b``: at most two on each level.
_COVER = (
    "flatten(flatten(transform(sequence(0, __levels), l -> transform(array(named_struct('a', shiftright(__a + shiftleft(1L, l) - 1L, l), 'b', shiftright(__b, l))), x -> array_compact(array("
    "CASE WHEN x.a < x.b AND x.a % 2 = 1 THEN named_struct('__level', l, '__node', x.a) END, CASE WHEN x.a < x.b AND x.b % 2 = 1 THEN named_struct('__level', l, '__node', x.b - 1) END))))))"
)
#: The dyadic nodes above one position, one on each level.
_ABOVE = "transform(sequence(0, __levels), l -> named_struct('__level', l, '__node', shiftright(__at, l)))"


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str, high: str, low_in: Column, high_in: Column) -> DataFrame:
    """Each point with each range of its keys that holds it, once a pair of rows: all columns of both.

    ``value``, ``low`` and ``high`` are columns of one type with a total order; a null end is
    open, a null value lies nowhere, and ``low_in`` and ``high_in`` (over columns of
    ``ranges``) say whether an end belongs to its range. Besides the keys the two tables
    share no column names.

    The values and ends of a key are numbered in their order, so that a range is a run of
    positions. A run of m positions is made of at most 2 log2(m) dyadic nodes, and a point
    lies below one node of each level: an equi-join on (keys, level, node) finds each pair
    exactly once, and nothing is compared that doesn't match. A key with n values and ends
    gives (points + 2 ranges) log2(n) rows, however its ranges overlap; its rows are spread
    by level and node. Only the different values of one key are sorted in one task, which
    spills as any window does.
    """
    mark = lambda df, c: df.filter(F.col(c).isNotNull()).select(*keys, F.col(c).alias("__v"))
    marks = mark(points, value).unionByName(mark(ranges, low)).unionByName(mark(ranges, high)).distinct()
    by_key = Window.partitionBy(*keys)
    numbered = marks.withColumn("__at", F.row_number().over(by_key.orderBy("__v")).cast("bigint") - 1).withColumn("__n", F.count(F.lit(1)).over(by_key))
    numbered = cut(numbered.withColumn("__levels", F.length(F.bin("__n")).cast("int")))

    def placed(df: DataFrame, c: str, at: str, how: str) -> DataFrame:
        own = numbered.select(*(F.col(k).alias(f"__{k}") for k in keys), "__v", F.col("__at").alias(at))
        same = reduce(and_, (F.col(k) == F.col(f"__{k}") for k in keys))
        return df.join(own, same & (F.col(c) == F.col("__v")), how).drop("__v", *(f"__{k}" for k in keys))

    sizes = numbered.groupBy(*keys).agg(F.first("__n").alias("__n"), F.first("__levels").alias("__levels"))
    runs = placed(placed(ranges.join(sizes, keys), low, "__lo", "left"), high, "__hi", "left")
    runs = runs.withColumn("__a", F.when(F.col(low).isNull(), 0).when(low_in, F.col("__lo")).otherwise(F.col("__lo") + 1).cast("bigint"))
    runs = runs.withColumn("__b", F.when(F.col(high).isNull(), F.col("__n")).when(high_in, F.col("__hi") + 1).otherwise(F.col("__hi")).cast("bigint"))
    runs = runs.filter("__a < __b").withColumn("__cover", F.explode(F.expr(_COVER))).select(*ranges.columns, "__cover.*")
    above = placed(points, value, "__at", "inner").join(sizes.select(*keys, "__levels"), keys).withColumn("__above", F.explode(F.expr(_ABOVE))).select(*points.columns, "__above.*")
    return above.join(runs, [*keys, "__level", "__node"]).drop("__level", "__node")
