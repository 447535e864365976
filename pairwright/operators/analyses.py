"""Whole tables of an evaluation: paired effects with interval, test, adjustment and effect size; judges against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.tails import signed_rank_p
from . import models, pairs, resample
from .gates import union
from .summary import complete_composites


def bundle(paired: DataFrame, by: list[str], unit: str, *, zeros: str = "wilcox", decimals: int = 9, n_draws: int = 2000, seed: int = 0, exact_up_to: int = 50) -> DataFrame:
    """One row per group of pairs (x, y): n, means, delta, interval, direction, effect size with its status, W, p and how p was taken.

    p is exact for up to ``exact_up_to`` pairs without ties and zeros, else by the normal approximation; without any difference it is 1.
    """
    effect = pairs.effects(paired, by)
    d = paired.select(*by, unit, (F.col("y") - F.col("x")).alias("d"))
    ci = resample.bootstrap_interval(d, by, unit, "d", n_draws, seed).select(*by, "ci_low", "ci_high")
    ranks = pairs.signed_ranks(paired, by, zeros, decimals).withColumnRenamed("n", "n_ranked")
    p = signed_rank_p(F.col("w"), F.col("n_ranked"), F.col("ties"), F.col("zeros"))
    exact = F.lit(False)
    if exact_up_to:
        few = (F.col("n_ranked") <= exact_up_to) & (F.col("ties") == 0) & (F.col("zeros") == 0)
        one = F.udf(lambda w, n: special.wilcoxon_p(w, n, exact=True) if w is not None and n <= exact_up_to else None, "double")  # a row per group
        p, exact = F.when(few, one("w", "n_ranked")).otherwise(p), few
    ranks = ranks.select(*by, "n_ranked", "w", p.alias("p"), F.when(exact, "exact").otherwise("approx").alias("p_method"))
    out = effect.join(ci, by).join(ranks, by, "left")
    none = F.col("p").isNull()
    return out.withColumns({"n_ranked": F.coalesce("n_ranked", F.lit(0).cast("long")), "p_method": F.when(none, "no_differences").otherwise(F.col("p_method")), "p": F.coalesce("p", F.lit(1.0))})


def rated(ratings: DataFrame, record: str, system: str, rater: str, dim: str, score: str, n_dims: int) -> DataFrame:
    """record, system, measure, value: means over raters of each dimension, and of COMPOSITE, a rater's mean of all dimensions."""
    by = [record, system]
    each = ratings.groupBy(*by, F.col(dim).alias("measure")).agg(F.avg(F.col(score).cast("double")).alias("value"))
    whole = complete_composites(ratings, [*by, rater], dim, score, n_dims).groupBy(*by).agg(F.avg("composite").alias("value"))
    return each.unionByName(whole.withColumn("measure", F.lit("COMPOSITE")))


def measured_pairs(long: DataFrame, unit: str, system: str, families: dict[str, tuple[str, str]]) -> DataFrame:
    """family, measure, unit, x, y of long scores (unit, system, measure, value)."""
    own = long.select(F.struct("measure", F.col(unit).alias("unit")).alias("key"), system, "value")
    out = pairs.families(own, "key", system, "value", families)
    return out.select("family", "key.measure", F.col("key.unit").alias(unit), "x", "y")


def paired_table(long: DataFrame, unit: str, system: str, families: dict[str, tuple[str, str]], *, holm_by: list[str], family_size: int | None = None, **how) -> DataFrame:
    """``bundle`` of every family and measure, with p_holm over the families of tests ``holm_by`` (their declared or counted size)."""
    out = bundle(measured_pairs(long, unit, system, families), ["family", "measure"], unit, **how)
    return pairs.holm(out, "p", holm_by, family_size)


def layered(parts: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """Tables of several layers under one another (name, table, whether its p_holm counts): a layer without leaves p_holm empty."""
    return union(*[t.withColumns({"layer": F.lit(k), "p_holm": F.col("p_holm") if counts else F.lit(None).cast("double")}) for k, t, counts in parts])


def least_effects(table: DataFrame, paired: DataFrame, by: list[str], dz: dict[str, float]) -> DataFrame:
    """A row per group and alpha: the least difference that would have been found, in units of the measure."""
    sd = paired.groupBy(*by).agg(F.stddev_samp(F.col("y") - F.col("x")).alias("sd"))
    each = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(z).alias("dz_least")) for a, z in dz.items()])
    return table.select(*by, "delta").join(sd, by).select(*by, "delta", F.explode(each).alias("a"), "sd").select(*by, "delta", "a.alpha", "a.dz_least", (F.col("sd") * F.col("a.dz_least")).alias("least"), (F.abs("delta") >= F.col("sd") * F.col("a.dz_least")).alias("found"))


def within_family(panel: DataFrame, unit: str, system: str, judges: list[str], families: dict[str, tuple[str, str]], **how) -> DataFrame:
    """Every judge's paired effect in every family, Holm over all of them, and whether the judges agree in direction."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("measure"), F.col(j).cast("double").alias("value")) for j in judges]))
    long = panel.select(unit, system, each.alias("j")).select(unit, system, "j.*")
    out = paired_table(long, unit, system, families, holm_by=[], **how).withColumnRenamed("measure", "judge")
    w, sign = Window.partitionBy("family"), F.signum("delta")  # a family has a row per judge
    ties = F.sum((F.col("delta") == 0).cast("int")).over(w)
    same = F.when(ties == len(judges), "both_tie").when(ties > 0, "one_tie").when(F.max(sign).over(w) == F.min(sign).over(w), "same").otherwise("opposite")
    return out.withColumn("agreement", same)


def cross_judge(panel: DataFrame, unit: str, system: str, a: str, b: str, own: list[str], families: dict[str, tuple[str, str]], n_draws: int, seed: int) -> dict[str, DataFrame]:
    """The tables of two judges against each other; every analysis draws from a seed of its own."""
    s = lambda name: resample.analysis_seed(seed, name) % (1 << 31)
    return {
        "agreement": pairs.correlations(panel.withColumn("scope", F.lit("all")), ["scope"], a, b, unit),
        "permutation": resample.hash_permutation(panel.withColumn("cell", F.concat_ws(":", F.col(unit).cast("string"), system)), "cell", a, b, n_draws, s("permutation")),
        "preference": models.fe_preference(panel, unit, system, a, b, own, n_draws, s("preference")),
        "contrast": pairs.contrast(panel, unit, system, a, b, own),
        "within_family": within_family(panel, unit, system, [a, b], families, n_draws=n_draws, seed=s("within"), exact_up_to=0),
        "rank_stability": resample.rank_stability(panel, unit, system, a, n_draws, s("rank")),
        "rank_agreement": resample.rank_agreement(panel, unit, system, a, b, n_draws, s("rank")),
    }


def long_form(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """table, row (values of those of ``keys`` that a table has), name, value: all numbers of several tables."""
    parts = []
    for name, t in tables.items():
        numbers = [f.name for f in t.schema if f.dataType.typeName() in ("double", "long", "integer")]
        numbers = [c for c in numbers if c not in keys]
        row = F.concat_ws("/", *[F.col(k).cast("string") for k in keys if k in t.columns]) if any(k in t.columns for k in keys) else F.lit("all")
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers]))
        parts.append(t.select(F.lit(name).alias("table"), row.alias("row"), each.alias("x")).select("table", "row", "x.*"))
    return union(*parts)
