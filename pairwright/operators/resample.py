"""Resampling inference: portable hash draws as plans, seeded numpy draws by Arrow, one seed per analysis.

A hash draw is a function of (seed, draw, unit), so any engine gives the same. A bootstrap draw gives each unit a
Poisson(1) weight by its hash: units need no numbers, no table of draws is joined, and what a task sends on is sums per draw.
A permutation draw turns the units' hash order by a hashed offset; places in that order are counted in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_rank_key
from .order import positions
from .pairs import pearson


#: Weights of Poisson(1) are whole; a hash above the last bound weighs as many as there are bounds (less than once in 10**12).
_BOUNDS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(14)]
_HASHES = float(16**15)


def weight(seed: int, draw: Column, *unit: Column) -> Column:
    """How often a bootstrap draw takes a unit: Poisson(1) by its hash."""
    u = hash_rank_key(seed, draw, *unit) / F.lit(_HASHES)
    return sum((F.when(u >= b, 1).otherwise(0) for b in _BOUNDS[1:]), F.when(u >= _BOUNDS[0], 1).otherwise(0))


def weight_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} / {_HASHES!r}::DOUBLE >= {b!r}::DOUBLE)::INT" for b in _BOUNDS) + ")"


def _drawn(rows: DataFrame, n_draws: int) -> DataFrame:
    """``rows`` once for each draw: a fixed number, aggregated where they are made."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))


def _weighed(rows: DataFrame, columns: list[str], n_draws: int, seed: int) -> DataFrame:
    """draw, ``columns`` and __k, the weight of the row's __unit: hashed once for a unit and draw, not for each of its few rows."""
    units = rows.groupBy("__unit").agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    each = _drawn(units, n_draws).withColumn("__k", weight(seed, F.col("draw"), F.col("__unit")))
    return each.select("draw", "__k", F.explode("__rows").alias("__row")).select("draw", "__k", "__row.*")


def bootstrap_interval(values: DataFrame, by: list[str], unit: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """Per group n, mean, and the percentile interval of the mean over hash draws of its units; all groups share a draw's weights."""
    own = values.select(*by, F.col(unit).alias("__unit"), F.col(value).cast("double").alias("__x")).where("__x is not null")
    each = _weighed(own, [*by, "__x"], n_draws, seed)
    means = each.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("__k") * F.col("__x")), F.sum("__k")).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"), F.count("m").alias("n_valid"))
    point = own.groupBy(*by).agg(F.count("__x").alias("n"), F.avg("__x").alias("mean"))
    return point.join(ci, by) if by else point.crossJoin(ci)  # one row each


def hash_bootstrap(values: DataFrame, unit: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """Mean of values with its percentile interval over hash draws."""
    return bootstrap_interval(values, [], unit, value, n_draws, seed)


def hash_permutation(pairs: DataFrame, unit: str, x: str, y: str, n_draws: int, seed: int) -> DataFrame:
    """Correlation of units with the two-sided p of hashed turns of y over the units' hash order, smoothed by one."""
    own = pairs.select(F.col(unit).alias("__unit"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    own = positions(own.withColumn("__hash", hash_rank_key(seed, F.col("__unit"))), [], [F.col("__hash"), F.col("__unit")], "__place")
    point = own.agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("estimate"))
    n = F.broadcast(own.agg(F.count(F.lit(1)).alias("__n")))  # one row
    each = _drawn(own.select("__place", "y"), n_draws).crossJoin(n)
    turned = each.select("draw", "y", ((F.col("__place") + hash_rank_key(seed, F.col("draw"), F.lit("turn"))) % F.col("__n")).alias("__place"))
    r = turned.join(own.select("__place", "x"), "__place").groupBy("draw").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    out = r.crossJoin(F.broadcast(point)).groupBy("n", "estimate").agg(F.count("r").alias("n_valid"), F.count(F.when(F.abs("r") >= F.abs("estimate") - 1e-12, 1)).alias("extreme"))
    return out.select("n", "estimate", "n_valid", ((F.col("extreme") + 1) / (F.col("n_valid") + 1)).alias("p_perm"))


def _draw_means(scores: DataFrame, unit: str, system: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """draw, system, m (rounded): means of hash draws of units. A row per draw and system."""
    cell = scores.groupBy(F.col(unit).alias("__unit"), system).agg(F.avg(F.col(value).cast("double")).alias("x"))
    each = _weighed(cell, [system, "x"], n_draws, seed)
    return each.groupBy("draw", system).agg(F.round(F.try_divide(F.sum(F.col("__k") * F.col("x")), F.sum("__k")), 9).alias("m"))


def rank_stability(scores: DataFrame, unit: str, system: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """Per system the mean, its rank, and the shares of hash draws of units in which it is first or last (ties share)."""
    means = _draw_means(scores, unit, system, value, n_draws, seed)
    w = Window.partitionBy("draw")  # a draw has a row per system
    means = means.withColumns({"top": F.max("m").over(w), "low": F.min("m").over(w)})
    means = means.withColumns({"t": (F.col("m") == F.col("top")).cast("double"), "l": (F.col("m") == F.col("low")).cast("double")})
    means = means.withColumns({"t": F.col("t") / F.sum("t").over(w), "l": F.col("l") / F.sum("l").over(w)})
    share = means.groupBy(system).agg(F.avg("t").alias("top_probability"), F.avg("l").alias("bottom_probability"), F.count(F.lit(1)).alias("n_valid"))
    point = scores.groupBy(unit, system).agg(F.avg(F.col(value).cast("double")).alias("x")).groupBy(system).agg(F.avg("x").alias("mean"))
    point = point.withColumn("rank", F.rank().over(Window.partitionBy().orderBy(F.desc(F.round("mean", 9)))))  # a row per system
    return point.join(share, system)


def rank_agreement(scores: DataFrame, unit: str, system: str, first: str, second: str, n_draws: int, seed: int) -> DataFrame:
    """Two judges' system means: Pearson and Spearman over systems, the share of draws with one top system in common, and intervals.

    A draw takes the same units for both. Ties at the top share: the chance that two systems picked among them are one.
    """
    long = scores.select(unit, F.col(system).alias("__system"), F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(c).cast("double").alias("v")) for j, c in ((1, first), (2, second))])).alias("j"))
    long = long.select(unit, F.struct("j.judge", "__system").alias("__key"), "j.v")
    m = _draw_means(long, unit, "__key", "v", n_draws, seed)
    point = long.groupBy(unit, "__key").agg(F.avg("v").alias("x")).groupBy("__key").agg(F.round(F.avg("x"), 9).alias("m")).select(F.lit(-1).alias("draw"), "__key", "m")
    wide = m.unionByName(point).groupBy("draw", F.col("__key.__system").alias("s")).agg(*[F.max(F.when(F.col("__key.judge") == j, F.col("m"))).alias(c) for j, c in ((1, "x"), (2, "y"))])
    w = Window.partitionBy("draw")  # a row per system
    for c in ("x", "y"):
        rank = F.rank().over(w.orderBy(F.desc(c))) + (F.count(F.lit(1)).over(Window.partitionBy("draw", c)) - 1) / 2.0
        top = (F.col(c) == F.max(c).over(w)).cast("double")
        wide = wide.withColumns({f"r{c}": rank, f"t{c}": top})
    per = wide.groupBy("draw").agg(
        pearson(F.col("x"), F.col("y")).alias("pearson"), pearson(F.col("rx"), F.col("ry")).alias("spearman"), (F.sum(F.col("tx") * F.col("ty")) / (F.sum("tx") * F.sum("ty"))).alias("same_top"), F.count(F.lit(1)).alias("n_systems")
    )
    at, drawn = F.col("draw") == -1, F.col("draw") >= 0
    out = [F.max(F.when(at, F.col("n_systems"))).alias("n_systems")]
    for c in ("pearson", "spearman"):
        x = F.when(drawn, F.col(c))
        out += [F.max(F.when(at, F.col(c))).alias(c), F.percentile(x, 0.025).alias(f"{c}_low"), F.percentile(x, 0.975).alias(f"{c}_high")]
    return per.agg(*out, F.avg(F.when(drawn, F.col("same_top"))).alias("same_top_probability"), F.count(F.when(drawn, 1)).alias("n_valid"))


def stratified_resample(population: DataFrame, panel: DataFrame, stratum: str, key: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """Whether a panel's mean is what samples of its strata counts, drawn without replacement, would give.

    Each draw takes the lowest hashes of each stratum; expected is the count-weighted mean of stratum means.
    """
    spark = population.sparkSession
    counts = panel.groupBy(stratum).agg(F.count(F.lit(1)).alias("k"))
    own = population.join(F.broadcast(counts), stratum).select(stratum, key, "k", F.col(value).cast("double").alias("x"))
    expected = own.groupBy(stratum, "k").agg(F.avg("x").alias("m")).agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("expected"), F.sum("k").alias("n"))
    # Of a stratum's N hashes the k lowest lie below (k + 6 sqrt(k) + 20) / N of their range but for less than once in 10**8
    # draws; where they don't, all rows of that draw and stratum are ranked. So a draw ranks about k rows of a stratum.
    size = own.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    own = own.join(F.broadcast(size), stratum).withColumn("__bound", (F.col("k") + 6 * F.sqrt("k") + 20) / F.col("__size") * F.lit(_HASHES))
    each = _drawn(own, n_draws).withColumn("__hash", hash_rank_key(seed, F.col("draw"), F.col(key)))
    low = each.where(F.col("__hash") <= F.col("__bound"))
    every = _drawn(size.join(F.broadcast(counts.select(stratum, "k")), stratum), n_draws)  # draws times strata
    enough = low.groupBy("draw", stratum).agg(F.count(F.lit(1)).alias("__found"))
    short = every.join(enough, ["draw", stratum], "left").where(F.coalesce("__found", F.lit(0)) < F.least("k", "__size")).select("draw", stratum)
    both = low.unionByName(each.where(F.col("__hash") > F.col("__bound")).join(F.broadcast(short), ["draw", stratum], "left_semi"))
    rank = F.row_number().over(Window.partitionBy("draw", stratum).orderBy("__hash", key))
    means = both.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).groupBy("draw").agg(F.avg("x").alias("m"))
    seen = panel.agg(F.avg(F.col(value).cast("double")).alias("observed"))
    point = seen.crossJoin(expected)  # one row each
    out = means.crossJoin(F.broadcast(point)).groupBy("observed", "expected", "n").agg(
        F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"), F.count(F.lit(1)).alias("n_valid"),
        F.count(F.when(F.abs(F.col("m") - F.col("expected")) >= F.abs(F.col("observed") - F.col("expected")) - 1e-12, 1)).alias("extreme"),
    )
    inside = F.col("observed").between(F.col("ci_low"), F.col("ci_high"))
    return out.select("observed", "expected", "n", "ci_low", "ci_high", "n_valid", ((F.col("extreme") + 1) / (F.col("n_valid") + 1)).alias("p_resample"), inside.alias("inside"))


def _portions(n_draws: int, width: int) -> list[int]:
    """Draws in portions whose matrices stay below four million cells; the generator gives the same draws in any portions."""
    step = max(1, (1 << 22) // max(1, width))
    return [min(step, n_draws - k) for k in range(0, n_draws, step)]


def numpy_bootstrap(pairs: DataFrame, group: str, unit: str, n_draws: int, seed: int) -> DataFrame:
    """Percentile interval of the mean of y - x per group, by a seeded generator over units in order. Groups are panels."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        d = (own["y"] - own["x"])[np.argsort(own[unit].to_numpy(), kind="stable")].to_numpy()
        rng = np.random.default_rng(seed)
        means = np.concatenate([d[rng.integers(0, len(d), (k, len(d)))].mean(1) for k in _portions(n_draws, len(d))])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({group: [own[group].iloc[0]], "n": [len(d)], "delta": [d.mean()], "ci_low": [low], "ci_high": [high]})

    kind = pairs.schema[group].dataType.simpleString()
    return pairs.select(group, unit, "x", "y").groupBy(group).applyInPandas(one, f"{group} {kind}, n long, delta double, ci_low double, ci_high double")


def _sums(codes: np.ndarray, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per unit: rows, and sums of x, y, their squares and their product."""
    return np.stack([np.bincount(codes, w, n) for w in (None, x, y, x * x, y * y, x * y)], 1)


def _r(sums: np.ndarray) -> np.ndarray:
    """Correlations from sums; NaN where a side is constant."""
    n, a, b, aa, bb, ab = sums.T
    va, vb = aa - a * a / n, bb - b * b / n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((va > 1e-12) & (vb > 1e-12), (ab - a * b / n) / np.sqrt(va * vb), np.nan)


def _interval(got: np.ndarray, n_draws: int, least_valid: float) -> tuple[int, float, float]:
    ok = got[~np.isnan(got)]
    low, high = np.percentile(ok, [2.5, 97.5]) if len(ok) and len(ok) >= least_valid * n_draws else (np.nan, np.nan)
    return len(ok), low, high


def correlation_bootstrap(rows: DataFrame, group: str, unit: str, x: str, y: str, n_draws: int, seed: int, least_valid: float = 0.8) -> DataFrame:
    """Pearson r per group with a cluster bootstrap over units; the interval is null when too few draws are valid."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        codes, units = pd.factorize(own[unit], sort=True)
        sums = _sums(codes, len(units), *[own[c].to_numpy(float) for c in (x, y)])
        rng = np.random.default_rng(seed)
        got = np.concatenate([_r(sums[rng.integers(0, len(units), (k, len(units)))].sum(1)) for k in _portions(n_draws, 6 * len(units))])
        n, low, high = _interval(got, n_draws, least_valid)
        return pd.DataFrame({group: [own[group].iloc[0]], "estimate": _r(sums.sum(0, keepdims=True)), "n_valid": [n], "ci_low": [low], "ci_high": [high]})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, unit, x, y).groupBy(group).applyInPandas(one, f"{group} {kind}, estimate double, n_valid long, ci_low double, ci_high double")


def correlation_difference(rows: DataFrame, group: str, unit: str, first: str, second: str, y: str, n_draws: int, seed: int, least_valid: float = 0.8) -> DataFrame:
    """r(second, y) - r(first, y) per group with a bootstrap over units that draws the same units for both."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        codes, units = pd.factorize(own[unit], sort=True)
        a, b = (_sums(codes, len(units), own[c].to_numpy(float), own[y].to_numpy(float)) for c in (first, second))
        rng = np.random.default_rng(seed)
        picks = (rng.integers(0, len(units), (k, len(units))) for k in _portions(n_draws, 12 * len(units)))
        got = np.concatenate([_r(b[p].sum(1)) - _r(a[p].sum(1)) for p in picks])
        n, low, high = _interval(got, n_draws, least_valid)
        point = _r(b.sum(0, keepdims=True)) - _r(a.sum(0, keepdims=True))
        p = difference_p(got[~np.isnan(got)]) if n else np.nan
        return pd.DataFrame({group: [own[group].iloc[0]], "difference": point, "n_valid": [n], "ci_low": [low], "ci_high": [high], "p": [p]})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, unit, first, second, y).groupBy(group).applyInPandas(one, f"{group} {kind}, difference double, n_valid long, ci_low double, ci_high double, p double")


def difference_p(draw_differences: np.ndarray) -> float:
    """Two-sided bootstrap p of a difference, smoothed by one."""
    n = len(draw_differences)
    return min(1.0, 2 * (min((draw_differences <= 0).sum(), (draw_differences >= 0).sum()) + 1) / (n + 1))


def analysis_seed(seed: int, name: str) -> int:
    """A seed of its own for each analysis, so that changing one doesn't move the others."""
    return int.from_bytes(__import__("hashlib").sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def mixed_model(rows: DataFrame, group: str, y: str, mode: str, first: str, second: str) -> DataFrame:
    """y ~ mode with crossed random intercepts, by REML over two variance ratios; one fit per group.

    Rows are summed by (first, second) beforehand and the fit goes through the crossed effects' normal equations:
    the factor of more levels is eliminated (its block is diagonal), the other's block is dense. Nothing is as wide as the rows.
    status: ok, or failed where the fit isn't finite or has no standard error.
    """
    m, v = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in (mode, y))  # a missing value fails its group's fit
    sums = {"n": F.count(F.lit(1)), "m": F.sum(m), "y": F.sum(v), "mm": F.sum(m * m), "my": F.sum(m * v), "yy": F.sum(v * v)}
    names = [f"__{k}" for k in sums]
    cells = rows.groupBy(group, first, second).agg(*[c.alias(f"__{k}") for k, c in sums.items()])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        codes = [pd.factorize(own[c], sort=True)[0] for c in (first, second)]
        q = [int(c.max()) + 1 for c in codes]
        wide, dense = (0, 1) if q[0] > q[1] else (1, 0)
        n, sm, sy, smm, smy, syy = (own[c].to_numpy(float) for c in names)
        mean = sy.sum() / n.sum()  # the intercept takes it up
        sy, smy, syy = sy - mean * n, smy - mean * sm, syy - 2 * mean * sy + mean**2 * n
        k = q[dense]
        # Columns: the dense factor's levels, one, mode, y. ``own_sums``: by level of the wide factor; ``gram``: over all rows.
        own_sums = np.zeros((q[wide], k + 3))
        np.add.at(own_sums, (codes[wide], codes[dense]), n)
        gram = np.zeros((k + 3, k + 3))
        for j, part in enumerate((n, sm, sy)):
            np.add.at(own_sums[:, k + j], codes[wide], part)
            gram[:k, k + j] = np.bincount(codes[dense], part, k)
        gram[k:, :k] = gram[:k, k:].T
        gram[np.arange(k), np.arange(k)] = np.bincount(codes[dense], n, k)
        gram[k:, k:] = [[n.sum(), sm.sum(), sy.sum()], [sm.sum(), smm.sum(), smy.sum()], [sy.sum(), smy.sum(), syy.sum()]]
        # Levels of equal size are eliminated alike, so their products are summed once.
        size, back = np.unique(own_sums[:, k], return_inverse=True)
        levels = np.bincount(back)
        products = [own_sums[back == j].T @ own_sums[back == j] for j in range(len(size))]
        total, p = n.sum(), 2

        def fit(theta: np.ndarray):
            ratio = np.exp(theta[[wide, dense]])
            a = gram - sum(x / (s + 1 / ratio[0]) for x, s in zip(products, size, strict=True))
            inner = np.eye(k) + ratio[1] * a[:k, :k]
            low = np.linalg.cholesky((inner + inner.T) / 2)
            half = np.linalg.solve(low, a[:k, k:])
            rest = a[k:, k:] - ratio[1] * half.T @ half
            xx, xy = rest[:p, :p], rest[:p, p]
            b = np.linalg.solve(xx, xy)
            s2 = (rest[p, p] - xy @ b) / (total - p)
            det = (levels * np.log1p(ratio[0] * size)).sum() + 2 * np.log(np.diag(low)).sum()
            return 0.5 * ((total - p) * np.log(s2) + det + np.linalg.slogdet(xx)[1]), b, np.sqrt(s2 * np.diag(np.linalg.inv(xx)))

        at, step = np.array([-1.0, -1.0]), 2.0
        best = fit(at)
        while step > 1e-3:  # pattern search: two parameters, smooth
            for move in ([step, 0], [-step, 0], [0, step], [0, -step]):
                new = np.clip(at + move, -12, 8)
                got = fit(new)
                if got[0] < best[0] - 1e-10:
                    at, best = new, got
                    break
            else:
                step /= 2
        ok = bool(np.isfinite(best[1]).all() and best[2][1] > 0)
        return pd.DataFrame({group: [own[group].iloc[0]], "coef": [best[1][1] if ok else np.nan], "se": [best[2][1] if ok else np.nan], "status": ["ok" if ok else "failed"]})

    kind = rows.schema[group].dataType.simpleString()
    return cells.groupBy(group).applyInPandas(one, f"{group} {kind}, coef double, se double, status string")
