"""Data-quality gates: a table of violations (check, n), which ``enforce`` turns into an error."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate has violations."""


def enforce(violations: DataFrame) -> None:
    bad = violations.where("n > 0").collect()  # a row per check
    if bad:
        raise GateError("; ".join(f"{r['check']}: {r['n']}" for r in sorted(bad, key=lambda r: r["check"])))


def row_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (a null outcome breaks it), all rules in one pass."""
    one = rows.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(k) for k, ok in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks])).alias("x")).select("x.*")


def duplicates(rows: DataFrame, keys: list[str], name: str = "duplicate_keys") -> DataFrame:
    """Keys that occur more than once."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return many.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")


def key_sets(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are missing and keys that weren't expected."""
    a, b = expected.select(*keys).distinct(), rows.select(*keys).distinct()
    missing = a.join(b, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_keys").alias("check"), "n")
    extra = b.join(a, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unexpected_keys").alias("check"), "n")
    return missing.unionByName(extra)


def union(*violations: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), violations)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))


def panel(rows: DataFrame, unit: str, system: str, value: str, units: int, systems: int) -> DataFrame:
    """Unique finite cells of a complete panel of the given size."""
    size = rows.agg(F.count_distinct(unit).alias("u"), F.count_distinct(system).alias("s"), F.count_distinct(unit, system).alias("c"))
    grid = size.select(F.lit("panel_size").alias("check"), F.when((F.col("u") == units) & (F.col("s") == systems) & (F.col("c") == units * systems), 0).otherwise(1).cast("long").alias("n"))
    return union(row_checks(rows, {"not_finite": finite(value)}), duplicates(rows, [unit, system]), grid)


def ratings(rows: DataFrame, keys: list[str], dim: str, score: str, dims: list[str], low: int, high: int) -> DataFrame:
    """Unique whole-numbered ratings between ``low`` and ``high`` of known dimensions."""
    x = F.col(score).cast("double")
    return union(
        row_checks(rows, {"not_whole": F.coalesce(x == F.floor(x), F.lit(False)), "out_of_range": x.between(low, high), "unknown_dimension": F.col(dim).isin(dims)}),
        duplicates(rows, [*keys, dim]),
    )


# Fixed values of the release audit: columns and file names that aren't released, and what gives a cell away.
FORBIDDEN_COLUMNS = ["record_id", "candidate_id", "source_zh", "reference_en", "translation", "hypothesis", "reasoning_content", "raw_response", "input_sha256"]
FORBIDDEN_COLUMN = r"(?i)(?:^|_)(?:sha\d*|hash|path|url|endpoint|mapping)(?:$|_)"
FORBIDDEN_FILE = r"(?i)(?:summary|resources?|manifest|raw|mapping|hash|scores?)"
PRIVATE_PLACE = r"^https?://|(?:^|\s)(?:[A-Za-z]:[\\/]|/home/|/Users/|/mnt/)"
DIGEST = r"(?i)^[0-9a-f]{40,128}$"
PROBABILITY = r"(?i)(?:^p(?:_|$)|_p(?:_|$)|probability$|fraction$|^(?:alpha|power)$)"
NOT_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def release_audit(table: DataFrame, marks: list[str] | None = None) -> DataFrame:
    """Violations of a table to be released: bad names, numbers, probabilities, reversed intervals, telling cells, no rows.

    ``marks``: words, in any case, that no cell may hold. Every cell becomes a (column, value) row once.
    """
    names = table.columns
    cells = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in names])).alias("x")).select("x.*")
    cells = cells.where("value is not null and value <> ''")
    number, value = F.col("value").try_cast("double"), F.col("value")
    held = F.lit(False)
    for m in marks or []:
        held = held | F.contains(F.lower(value), F.lit(m.lower()))
    checks = {
        "not_finite": ~value.rlike(NOT_FINITE),
        "probability": ~F.col("column").rlike(PROBABILITY) | F.coalesce(number.between(0, 1), F.lit(False)) | value.rlike(NOT_FINITE),
        "private_place": ~value.rlike(PRIVATE_PLACE),
        "digest": ~value.rlike(DIGEST),
        "mark": ~held,
    }
    out = row_checks(cells, checks)
    low = [c.strip().lower() for c in names]
    fixed = [
        ("forbidden_column", sum(c in FORBIDDEN_COLUMNS or bool(re.search(FORBIDDEN_COLUMN, c)) for c in low)),
        ("duplicate_column", len(names) - len(set(names))),
        ("blank_in_name", sum(c != c.strip() for c in names)),
    ]
    out = out.unionByName(table.sparkSession.createDataFrame(fixed, "check string, n long"))
    bounds = [(a, a.removesuffix(x) + y) for a in names for x, y in (("_low", "_high"), ("_lo", "_hi")) if a.endswith(x) and a.removesuffix(x) + y in names]
    reversed_ = [F.count(F.when(F.col(f"`{a}`").try_cast("double") > F.col(f"`{b}`").try_cast("double"), 1)) for a, b in bounds]
    whole = table.agg(sum(reversed_, F.lit(0)).cast("long").alias("interval"), (F.count(F.lit(1)) == 0).cast("long").alias("empty"))
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in ("interval", "empty")])
    return out.unionByName(whole.select(F.explode(each).alias("x")).select("x.*"))


def release_files(names: list[str], expected: set[str]) -> dict[str, list[str]]:
    """File names that are missing, unexpected, not CSV, or tell of what isn't released."""
    return {
        "missing": sorted(expected - set(names)),
        "unexpected": sorted(set(names) - expected),
        "not_csv": sorted(n for n in names if not n.lower().endswith(".csv")),
        "forbidden": sorted(n for n in names if re.search(FORBIDDEN_FILE, n)),
    }


def one_layer(rows: DataFrame, layer: str = "layer") -> DataFrame:
    """A layer's table isn't empty and names one layer."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(layer).alias("l"), F.count(F.when(F.col(layer).isNull(), 1)).alias("blank"))
    checks = {"empty_layer": F.col("n") == 0, "several_layers": F.col("l") > 1, "no_layer": (F.col("blank") > 0) | ((F.col("n") > 0) & (F.col("l") == 0))}
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), c.cast("long").alias("n")) for k, c in checks.items()])).alias("x")).select("x.*")


def merged_layers(layers: dict[str, DataFrame], identity: list[str], layer: str = "layer") -> tuple[DataFrame, DataFrame]:
    """(the layers' tables under one another, violations): each holds its own layer's rows alone, and no row twice."""
    found = []
    for name, t in layers.items():
        missing = [c for c in identity if c not in t.columns]
        if missing:
            raise GateError(f"{name}: no columns {missing}")
        wrong = t.agg(F.count(F.when(~F.col(layer).eqNullSafe(F.lit(name)), 1)).alias("n")).select(F.lit(f"{name}_wrong_layer").alias("check"), "n")
        found += [wrong, duplicates(t, identity, f"{name}_duplicates")]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers.values())
    return both, union(*found, duplicates(both, identity, "duplicates_across_layers"))


def missing_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns that a table should have and hasn't."""
    n = len([c for c in names if c not in rows.columns])
    return rows.sparkSession.range(1).select(F.lit("missing_columns").alias("check"), F.lit(n).cast("long").alias("n"))


def numeric_kinds(rows: DataFrame, column: str) -> DataFrame:
    """JSON texts that stand for a number but are none: booleans and quoted numbers."""
    raw = F.trim(F.col(column))
    return row_checks(rows, {f"{column}_boolean": ~F.lower(raw).isin("true", "false"), f"{column}_quoted": ~raw.rlike('^".*"$')})
