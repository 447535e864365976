"""Rows of a Markdown table and quoted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Two decimals, or NA."""
    return F.when(c.isNull() | F.isnan(c), "NA").otherwise(F.format_string("%.2f", c.cast("double")))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("\n> ")))


def report(rows: DataFrame, by: str, order: str, cells: list[Column]) -> DataFrame:
    """Per case its table rows in order, as one text. A case has a row per system."""
    each = rows.select(by, F.struct(order, table_row(*cells).alias("row")).alias("x"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "\n").alias("table"))
