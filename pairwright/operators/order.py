"""Places in an order, counted in parallel: no group, however large, is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written


def positions(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in the order inside each group (null keys are a group).

    Rows are dealt by range over (group, order), so that a large group lies in many ranges; each range numbers its own
    rows, and the rows of the ranges before it are added: a row per range and group.
    """
    keys = [F.col(b) for b in by]
    tagged = {"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = written(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumns(tagged), "positions")
    ranges = own.groupBy("__part", *by).agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    ranges = ranges.select(F.col("__part").alias("__p"), *[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)], "__low", before.alias("__before"))
    same = own["__part"] == ranges["__p"]
    for k, b in enumerate(by):
        same = same & own[b].eqNullSafe(ranges[f"__by{k}"])
    return own.join(ranges, same).select(*[own[c] for c in rows.columns], (F.col("__before") + F.col("__id") - F.col("__low")).alias(name))


def average_ranks(rows: DataFrame, by: list[str], value: str, descending: bool = True, name: str = "avg_rank") -> DataFrame:
    """``name``: ranks from 1; ties share the mean of their places."""
    own = positions(rows, by, [F.desc(value) if descending else F.asc(value)], "__place")
    each = own.groupBy(*by, value).agg(F.avg("__place").alias("__mean"))
    each = each.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate([*by, value])], (F.col("__mean") + 1).alias(name))
    same = F.lit(True)
    for k, c in enumerate([*by, value]):
        same = same & own[c].eqNullSafe(each[f"__k{k}"])
    return own.join(each, same).select(*[own[c] for c in rows.columns], name)


def ntile(rows: DataFrame, n: int, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``name``: 0 to n - 1, parts of each group in its order whose sizes differ by one at most, larger ones first."""
    own = positions(rows, by, order, "__place")
    size = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))  # a row per group
    own = own.join(size, by) if by else own.crossJoin(F.broadcast(size))
    part, more = F.floor(F.col("__size") / n), F.col("__size") % n
    cut = more * (part + 1)
    tile = F.when(F.col("__place") < cut, F.floor(F.col("__place") / (part + 1))).otherwise(more + F.floor((F.col("__place") - cut) / part))
    return own.withColumn(name, tile.cast("int")).select(*rows.columns, name)


def first(rows: DataFrame, by: str, order: list[Column | str], quota: DataFrame) -> DataFrame:
    """The first ``quota`` rows of each group. quota: a row per group."""
    own = positions(rows, [by], order, "__place")
    return own.join(F.broadcast(quota.select(by, "quota")), by).where(F.col("__place") < F.col("quota")).select(*rows.columns)
