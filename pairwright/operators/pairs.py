"""Paired comparisons: pivots, effects, Holm steps, ranks, correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_p, t_p
from .order import average_ranks, ntile


def paired(scores: DataFrame, unit: str, system: str, value: str, left: str, right: str, how: str = "drop") -> DataFrame:
    """unit, x (left), y (right). Incomplete pairs are dropped, or with ``how='raise'`` an error at run time."""
    pick = lambda s: F.max(F.when(F.col(system) == s, F.col(value).cast("double")))
    out = scores.where(F.col(system).isin(left, right)).groupBy(unit).agg(pick(left).alias("x"), pick(right).alias("y"))
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    if how == "raise":
        return out.withColumn("x", F.when(whole, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("incomplete pair: "), F.col(unit).cast("string")))))
    return out.where(whole)


def families(scores: DataFrame, unit: str, system: str, value: str, of: dict[str, tuple[str, str]]) -> DataFrame:
    """family, unit, x, y of all families in one pass: the pairs are exploded, not read again."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(a).alias("__a"), F.lit(b).alias("__b")) for f, (a, b) in of.items()])
    rows = scores.select(unit, system, value, F.explode(each).alias("__f")).select(unit, system, value, "__f.*").where((F.col(system) == F.col("__a")) | (F.col(system) == F.col("__b")))
    pick = lambda s: F.max(F.when(F.col(system) == F.col(s), F.col(value).cast("double")))
    return rows.groupBy("family", unit).agg(pick("__a").alias("x"), pick("__b").alias("y")).where("x is not null and y is not null")


def cohen_dz(d: Column, zero_variance: float | None = None) -> Column:
    """Mean over deviation; where all differences are equal and not zero: null, or ``zero_variance``."""
    s = F.stddev_samp(d)
    if zero_variance is not None:
        return F.when(s > 0, F.avg(d) / s).otherwise(zero_variance)
    return F.when(F.max(F.abs(d)) == 0, 0.0).when(s > 0, F.avg(d) / s)


def dz_status(d: Column) -> Column:
    s = F.stddev_samp(d)
    return F.when(F.max(F.abs(d)) == 0, "all_zero").when(s > 0, "ok").otherwise("zero_variance_nonzero")


def effects(pairs: DataFrame, by: list[str], zero_variance: float | None = None) -> DataFrame:
    """Means, delta (y - x), direction and standardised effect of pairs."""
    d = F.col("y") - F.col("x")
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.avg(d).alias("delta"), cohen_dz(d, zero_variance).alias("dz"), dz_status(d).alias("dz_status")
    )
    return out.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("tie"))


def nearest(c: Column, decimals: int) -> Column:
    """``c`` to so many decimals, halves away from zero, as SQL engines round doubles: the scaled value decides, not the shortest decimal form.

    What is too large to be scaled stays as it is.
    """
    scale = F.lit(10.0**decimals)
    scaled = F.abs(c * scale)
    even = F.rint(scaled)
    out = F.signum(c) * F.when(scaled - even == 0.5, even + 1).otherwise(even) / scale
    return F.when(scaled < float("inf"), out).otherwise(c)


def signed_ranks(pairs: DataFrame, by: list[str], zeros: str = "wilcox", decimals: int = 9) -> DataFrame:
    """Per group: pairs that count, rank sums of rises and falls, the statistic W, and the tie and zero terms.

    ``wilcox`` drops zero differences before ranking, ``pratt`` ranks them and drops their ranks.
    Differences are rounded first, so that ties don't hang on the last bit.
    """
    d = pairs.select(*by, nearest(F.col("y") - F.col("x"), decimals).alias("d"))
    d = d if zeros == "pratt" else d.where("d <> 0")
    # Ties are counted before ranks are taken: windows see one row per distinct difference.
    each = d.groupBy(*by, F.abs("d").alias("a")).agg(
        F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down")
    )
    upto = F.sum("t").over(Window.partitionBy(*by).orderBy("a"))
    each = each.withColumn("rank", upto - (F.col("t") - 1) / 2.0)
    some = F.col("a") != 0
    out = each.groupBy(*by).agg(
        F.sum(F.when(some, F.col("t")).otherwise(0)).alias("n"), F.sum(F.col("rank") * F.col("up")).alias("r_plus"), F.sum(F.col("rank") * F.col("down")).alias("r_minus"),
        F.sum(F.when(some, F.pow("t", F.lit(3)) - F.col("t")).otherwise(0)).cast("double").alias("ties"), F.sum(F.when(some, 0).otherwise(F.col("t"))).alias("zeros"),
    )
    return out.withColumn("w", F.least("r_plus", "r_minus"))


def holm(rows: DataFrame, p: str, by: list[str], family_size: int | None = None) -> DataFrame:
    """``p_holm``: step-down adjusted p of the non-null values of each family, by a declared or counted size."""
    rank = F.row_number().over(Window.partitionBy(*by, F.col(p).isNull()).orderBy(p))
    m = F.lit(family_size) if family_size is not None else F.count(p).over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - rank + 1) * F.col(p))
    running = F.max("__step").over(Window.partitionBy(*by, F.col(p).isNull()).orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumns({"__rank": rank, "__step": step})
    return out.withColumn("p_holm", F.when(F.col(p).isNotNull(), running)).drop("__rank", "__step")


def tertiles(rows: DataFrame, value: str, key: str, by: list[str] | None = None) -> DataFrame:
    """``tertile`` 0 to 2 by (value, key as text)."""
    return ntile(rows, 3, by or [], [F.col(value), F.col(key).cast("string")], "tertile")


def extremes(rows: DataFrame, by: list[str], name: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Names at the top and at the bottom, ties joined by ``|``, and the weight each of them gets.

    Equal values are tied whatever they are: infinities and NaN have no distance. Without any value there are no names, and the weight is 1 / 0.
    """
    w = Window.partitionBy(*by)
    own = rows.withColumns({"__top": F.max(value).over(w), "__low": F.min(value).over(w)})
    at = lambda c: (F.col(value) == F.col(c)) | (F.abs(F.col(value) - F.col(c)) <= tolerance)
    names = lambda c: F.array_sort(F.collect_set(F.when(at(c), F.col(name))))
    joined = lambda c: F.when(F.size(names(c)) > 0, F.array_join(names(c), "|"))
    n = F.count(F.when(at("__top"), 1))
    return own.groupBy(*by).agg(joined("__top").alias("top"), joined("__low").alias("bottom"), F.when(n > 0, 1 / n).otherwise(float("inf")).alias("top_weight"))


def pearson(x: Column, y: Column) -> Column:
    """Null where a side is constant; ``corr`` itself would fail there."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def inversions(ranks: np.ndarray, weight: np.ndarray) -> int:
    """Weight of the pairs in which a greater rank stands before a lesser one; bit by bit, without the pairs."""
    total, ranks, weight = 0, ranks.astype(np.int64), weight.astype(np.int64)
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        order = np.argsort(ranks >> (bit + 1), kind="stable")  # equal higher bits together, each in their order
        ranks, weight = ranks[order], weight[order]
        one = (ranks >> bit) & 1
        before = np.cumsum(one * weight) - one * weight
        high = ranks >> (bit + 1)
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        before -= np.repeat(before[first], np.diff(np.append(first, len(high))))
        total += int((before * weight)[one == 0].sum())
    return total


def tau_b(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Kendall's tau-b of the distinct values (x, y), each of which occurs c times, and its normal score; NaN where a side is constant."""
    if np.isnan(x).any() or np.isnan(y).any():
        return np.nan, np.nan
    rx, ry = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.lexsort((ry, rx))  # ties in x rise in y and so count as no inversion
    tied = lambda n: sum(k * (k - 1) // 2 for k in n.tolist())
    sums = lambda r: np.bincount(r, c).round().astype(np.int64)
    n, sx, sy = int(c.sum()), sums(rx), sums(ry)
    whole, tx, ty = n * (n - 1) // 2, tied(sx), tied(sy)
    nx, ny = whole - tx, whole - ty
    s = whole - tx - ty + tied(c) - 2 * inversions(ry[order], c[order])
    if not nx or not ny:
        return np.nan, np.nan
    # The variance of s under independence, given the ties.
    cubed = [sum(k * (k - 1) * (k - 2) for k in v.tolist()) for v in (sx, sy)]
    fifths = [sum(k * (k - 1) * (2 * k + 5) for k in v.tolist()) for v in (sx, sy)]
    pairs = float(n) * (n - 1)
    var = (pairs * (2 * n + 5) - sum(fifths)) / 18 + 2.0 * tx * ty / pairs
    a, b = cubed
    var += float(a) * b / (9 * pairs * (n - 2)) if n > 2 else 0.0
    return s / np.sqrt(float(nx) * float(ny)), s / np.sqrt(var)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson or Spearman correlation by Student's t."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(F.abs(r) >= 1, F.when(n > 2, 0.0).otherwise(1.0)).when(n > 2, t_p(t, n - 2))


def correlations(rows: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """Pearson, Spearman and Kendall's tau-b of each group, with two-sided p (Student's t; for tau-b the normal score given the ties).

    tau-b counts the distinct (x, y) of a group and then their inversions: n log n, a group's distinct values in one task.
    """
    own = rows.select(*by, F.col(key).alias("__key"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranked = average_ranks(average_ranks(own, by, "__x", name="rx"), by, "__y", name="ry")
    plain = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("__x"), F.col("__y")).alias("pearson"), pearson(F.col("rx"), F.col("ry")).alias("spearman"))
    cells = own.where("__key is not null and __x is not null and __y is not null").groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).alias("__c"))

    def one(c: pd.DataFrame) -> pd.DataFrame:
        got = tau_b(c["__x"].to_numpy(float), c["__y"].to_numpy(float), c["__c"].to_numpy(np.int64))
        return c[by].head(1).assign(constant=c["__x"].nunique(dropna=False) < 2 or c["__y"].nunique(dropna=False) < 2, kendall=got[0], __z=got[1])

    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    tau = cells.groupBy(*by).applyInPandas(one, f"{kinds}, constant boolean, kendall double, __z double")
    some = ~F.col("constant")
    out = plain.join(tau.select(*by, F.when(some, F.col("kendall")).alias("kendall"), F.when(some, normal_p(F.col("__z"))).alias("kendall_p")), by, "left")
    return out.select(*by, "n", "pearson", correlation_p(F.col("pearson"), F.col("n")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("n")).alias("spearman_p"), "kendall", "kendall_p")


def contrast(scores: DataFrame, unit: str, system: str, a: str, b: str, family: list[str]) -> DataFrame:
    """Per-unit difference in differences: the mean of (b - a) in the family less that of the others."""
    d = F.col(b) - F.col(a)
    inside = F.col(system).isin(family)
    per = scores.groupBy(unit).agg((F.avg(F.when(inside, d)) - F.avg(F.when(~inside, d))).alias("d"))
    d = F.col("d")
    return per.agg(F.count(d).alias("n"), F.avg(d).alias("contrast"), cohen_dz(d).alias("dz"), dz_status(d).alias("dz_status"))
