"""Closed-form models and agreement: fixed effects with clustered errors, HC3, W, kappa, alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import t_p
from .pairs import families as pairs_of
from .pairs import tertiles
from .resample import weight
from .summary import complete_composites


def fe_interaction(scores: DataFrame, unit: str, system: str, a: str, b: str, family: list[str]) -> DataFrame:
    """Judge x family interaction with unit and system effects, CR1 errors by unit, of a balanced panel.

    With every (unit, system) scored by both judges the dummy-variable fit reduces to means of
    d = b - a inside and outside the family, and its clustered variance to sums by unit: two small aggregations.
    """
    d = scores.select(F.col(unit).alias("__unit"), F.col(system).alias("__system"), F.col(system).isin(family).cast("double").alias("f"), (F.col(b) - F.col(a)).alias("d"))
    whole = d.agg(
        F.avg(F.when(F.col("f") == 1, F.col("d"))).alias("inside"), F.avg(F.when(F.col("f") == 0, F.col("d"))).alias("outside"), F.avg("f").alias("share"),
        F.count(F.lit(1)).alias("cells"), F.count_distinct("__system").alias("s"), F.count_distinct("__unit").alias("r"),
    )
    each = d.crossJoin(F.broadcast(whole))  # one row
    resid = F.col("d") - F.col("outside") - (F.col("inside") - F.col("outside")) * F.col("f")
    u = each.groupBy("__unit").agg(F.sum(0.5 * (F.col("f") - F.col("share")) * resid).alias("u")).agg(F.sum(F.col("u") * F.col("u")).alias("uu"))
    out = whole.crossJoin(u)
    r, s = F.col("r").cast("double"), F.col("s").cast("double")
    spread = 0.5 * F.col("cells") * F.col("share") * (1 - F.col("share"))
    n, k = 2 * r * s, r + s + 1
    var = F.col("uu") / (spread * spread) * r / (r - 1) * (n - 1) / (n - k)
    return out.select((F.col("inside") - F.col("outside")).alias("estimate"), F.sqrt(var).alias("se"), n.cast("long").alias("n_obs"), (r - 1).cast("long").alias("df"))


def fe_slope(scores: DataFrame, unit: str, system: str, y: str, x: str) -> DataFrame:
    """Slope of y on x with unit and system effects (balanced panel: double demeaning), CR1 errors by unit."""
    own = scores.select(F.col(unit).alias("__unit"), F.col(system).alias("__system"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    by_unit = own.groupBy("__unit").agg(F.avg("y").alias("yu"), F.avg("x").alias("xu"))
    by_system = own.groupBy("__system").agg(F.avg("y").alias("ys"), F.avg("x").alias("xs"))
    whole = own.agg(F.avg("y").alias("ya"), F.avg("x").alias("xa"), (F.var_pop("y") * F.count(F.lit(1))).alias("tss"), F.count(F.lit(1)).alias("n"), F.count_distinct("__unit").alias("r"), F.count_distinct("__system").alias("s"))
    d = own.join(by_unit, "__unit").join(by_system, "__system").crossJoin(F.broadcast(whole))  # one row
    d = d.select("__unit", (F.col("y") - F.col("yu") - F.col("ys") + F.col("ya")).alias("y"), (F.col("x") - F.col("xu") - F.col("xs") + F.col("xa")).alias("x"))
    per = d.groupBy("__unit").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    fit = per.agg(F.sum("yy").alias("syy"), (F.sum("xy") / F.sum("xx")).alias("b"), F.sum("xx").alias("sxx"))
    meat = per.crossJoin(F.broadcast(fit)).agg(F.sum(F.pow(F.col("xy") - F.col("b") * F.col("xx"), F.lit(2))).alias("m"))
    out = fit.crossJoin(meat).crossJoin(whole)
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), (F.col("r") + F.col("s")).cast("double")
    var = F.col("m") / (F.col("sxx") * F.col("sxx")) * r / (r - 1) * (n - 1) / (n - k)
    return out.select(F.col("b").alias("slope"), F.sqrt(var).alias("se"), F.col("n").alias("n_obs"), (r - 1).cast("long").alias("df"), (1 - (F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / F.col("tss")).alias("r_squared"))


def tidy(fit: DataFrame, estimate: str, se: str = "se", df: str = "df") -> DataFrame:
    """``fit`` with t and its two-sided p."""
    t = F.try_divide(F.col(estimate), F.col(se))
    return fit.withColumn("t", t).withColumn("p", t_p(F.col("t"), F.col(df)))


def leave_one_system_out(scores: DataFrame, unit: str, system: str, a: str, b: str, family: list[str]) -> DataFrame:
    """excluded, estimate: the interaction of a balanced panel without each system in turn; null where no system of a kind is left. A row per system."""
    per = scores.groupBy(F.col(system).alias("system")).agg(F.avg(F.col(b) - F.col(a)).alias("d"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("inside", F.col("system").isin(family))
    other = per.join(F.broadcast(per.select(F.col("system").alias("excluded"))), F.col("system") != F.col("excluded"))  # systems squared
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("d") * F.col("n"))), F.sum(F.when(c, F.col("n"))))
    return other.groupBy("excluded").agg((mean(F.col("inside")) - mean(~F.col("inside"))).alias("estimate"))


def fe_preference(scores: DataFrame, unit: str, system: str, a: str, b: str, family: list[str], n_draws: int, seed: int) -> DataFrame:
    """``fe_interaction`` with t and p, its interval over hash draws of units, and its bounds when one system is left out."""
    fit = tidy(fe_interaction(scores, unit, system, a, b, family), "estimate")
    inside = F.col(system).isin(family)
    per = scores.groupBy(F.col(unit).alias("unit")).agg(*[f(F.when(c, F.col(b) - F.col(a))).alias(n) for c, k in ((inside, "i"), (~inside, "o")) for f, n in ((F.sum, f"{k}s"), (F.count, f"{k}n"))])
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("k", weight(seed, F.col("draw"), F.col("unit")))
    total = lambda c: F.sum(F.col("k") * F.col(c))
    means = drawn.groupBy("draw").agg((F.try_divide(total("is"), total("in")) - F.try_divide(total("os"), total("on"))).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    bounds = leave_one_system_out(scores, unit, system, a, b, family).agg(F.min("estimate").alias("least_without_one"), F.max("estimate").alias("most_without_one"))
    return fit.crossJoin(ci).crossJoin(bounds)  # one row each


def hc3(rows: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Simple regression with HC3 errors, one per group; a constant regressor is an error at run time."""
    by = by or []
    own = rows.select(*by, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    fit = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count(F.lit(1))).alias("sxx"), (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("sxy"))
    fit = fit.withColumn("sxx", F.when(F.col("sxx") > 0, F.col("sxx")).otherwise(F.raise_error(F.lit("the regressor is constant"))))
    fit = fit.withColumn("b", F.col("sxy") / F.col("sxx"))
    joined = lambda a, b: a.join(F.broadcast(b), by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  # a row per group
    each = joined(own, fit)
    dx = F.col("x") - F.col("mx")
    e = F.col("y") - F.col("my") - F.col("b") * dx
    h = 1 / F.col("n") + dx * dx / F.col("sxx")
    meat = each.groupBy(*by).agg(F.sum(F.pow(dx * e / (1 - h), F.lit(2))).alias("m"), F.sum(e * e).alias("rss"), F.sum(F.pow(F.col("y") - F.col("my"), F.lit(2))).alias("tss"))
    out = joined(fit, meat)
    return out.select(
        *by, (F.col("my") - F.col("b") * F.col("mx")).alias("intercept"), F.col("b").alias("slope"), (F.sqrt("m") / F.col("sxx")).alias("se"),
        (1 - F.col("rss") / F.col("tss")).alias("r_squared"), F.col("n").alias("n_obs"),
    )


def kendall_w(ratings: DataFrame, by: list[str], item: str, rater: str, score: str) -> DataFrame:
    """Kendall's W with the tie correction; null where all ranks tie."""
    w = Window.partitionBy(*by, rater)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, rater, score))
    ranked = ratings.select(*by, item, rater, (F.rank().over(w.orderBy(score)) + (ties - 1) / 2.0).alias("rank"), (ties * ties - 1).cast("double").alias("t"))
    per = ranked.groupBy(*by, item).agg(F.sum("rank").alias("r"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("m"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("m").cast("double").alias("m"), (F.var_pop("r") * F.count(F.lit(1))).alias("s"), F.sum("t").alias("t"))
    low = F.col("m") * F.col("m") * (F.pow("n", F.lit(3)) - F.col("n")) - F.col("m") * F.col("t")
    return out.select(*by, F.col("n").cast("long").alias("n_items"), F.col("m").cast("long").alias("n_raters"), F.when(low > 0, 12 * F.col("s") / low).alias("kendall_w"))


def fleiss_kappa(ratings: DataFrame, by: list[str], item: str, score: str, n_raters: int) -> DataFrame:
    """Fleiss' kappa over items with all ratings."""
    counts = ratings.groupBy(*by, item, score).agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy(*by, item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).where(F.col("m") == n_raters)
    p = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.col("agree") / (n_raters * (n_raters - 1))).alias("p"))
    share = counts.join(items.select(*by, item), [*by, item], "left_semi").groupBy(*by, score).agg(F.sum("c").alias("c"))
    share = share.withColumn("q", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))  # a row per category
    pe = share.groupBy(*by).agg(F.sum(F.col("q") * F.col("q")).alias("pe"))
    return p.join(pe, by).select(*by, "n_items", F.when(F.col("pe") < 1, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("fleiss_kappa"))


def krippendorff_alpha(ratings: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """Ordinal alpha from the coincidences of categories; missing ratings allowed, items of one rating fall out.

    Only counts per item and category are joined with themselves: categories squared rows an item.
    """
    counts = ratings.where(F.col(score).isNotNull()).groupBy(*by, item, F.col(score).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = counts.groupBy(*by, item).agg(F.sum("n").alias("m")).where("m > 1")
    counts = counts.join(size, [*by, item])
    other = counts.select(*by, item, F.col("c").alias("k"), F.col("n").alias("nk"))
    pair = counts.join(other, [*by, item]).withColumn("o", F.col("n") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1))
    o = pair.groupBy(*by, "c", "k").agg(F.sum("o").alias("o"))
    margin = o.groupBy(*by, "c").agg(F.sum("o").alias("n"))
    w = Window.partitionBy(*by).orderBy("c")
    margin = margin.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*by))})
    right = margin.select(*by, F.col("c").alias("k"), F.col("n").alias("nk"), F.col("upto").alias("upto_k"))
    both = margin.join(right, by).where("c < k")  # categories squared rows
    delta = F.pow(F.col("upto_k") - F.col("nk") / 2 - (F.col("upto") - F.col("n") / 2), F.lit(2))
    both = both.withColumn("delta", delta).join(o, [*by, "c", "k"], "left")
    out = both.groupBy(*by).agg(F.max("total").alias("total"), F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")).alias("d_o"), F.sum(F.col("n") * F.col("nk") * F.col("delta")).alias("d_e"))
    return out.select(*by, F.when(F.col("d_e") > 0, 1 - (F.col("total") - 1) * F.col("d_o") / F.col("d_e")).alias("krippendorff_alpha"))


def agreement(ratings: DataFrame, item: str, rater: str, dim: str, score: str, n_raters: int, n_dims: int) -> DataFrame:
    """dim, n_items, n_complete, alpha, W and kappa of each dimension and of COMPOSITE (the mean of a rater's whole set of dimensions), whose kappa is null."""
    own = ratings.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(dim).alias("dim"), F.col(score).cast("double").alias("score"))
    whole = complete_composites(own, ["item", "rater"], "dim", "score", n_dims).select("item", "rater", F.lit("COMPOSITE").alias("dim"), F.round("composite", 9).alias("score"))
    every = own.unionByName(whole)
    per = every.groupBy("dim", "item").agg(F.count("score").alias("m"))
    counts = per.groupBy("dim").agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(F.col("m") == n_raters, 1)).alias("n_complete"))
    full = every.join(per.where(F.col("m") == n_raters).select("dim", "item"), ["dim", "item"], "left_semi")
    w = kendall_w(full, ["dim"], "item", "rater", "score").select("dim", "kendall_w")
    kappa = fleiss_kappa(own, ["dim"], "item", "score", n_raters).select("dim", "fleiss_kappa")
    out = counts.join(krippendorff_alpha(every, ["dim"], "item", "score"), "dim", "left")  # a row per dimension from here
    return out.join(w, "dim", "left").join(kappa, "dim", "left")


def length_confound(scores: DataFrame, record: str, system: str, score: str, words: str, families: dict[str, tuple[str, str]]) -> DataFrame:
    """Whether length explains scores: a slope with record and system effects, per family the slope of score on word differences
    (first - second, HC3), and mean differences by tertile of a pair's mean words.

    analysis, family, bucket, n, estimate, se, t, p, r_squared, mean_score_delta, mean_word_delta, positive, least_words, most_words.
    """
    fixed = tidy(fe_slope(scores, record, system, score, words), "slope")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    fixed = fixed.select(
        F.lit("candidate_fixed_effect").alias("analysis"), F.lit("all").alias("family"), F.lit("all").alias("bucket"), F.col("n_obs").alias("n"), F.col("slope").alias("estimate"), "se", "t", "p", "r_squared",
        *none("double", "mean_score_delta", "mean_word_delta"), *none("long", "positive"), *none("double", "least_words", "most_words"),
    )
    both = [pairs_of(scores, record, system, c, families).select("family", record, F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k, c in (("s", score), ("w", words))]
    paired = both[0].join(both[1], ["family", record]).select("family", record, (F.col("sx") - F.col("sy")).alias("ds"), (F.col("wx") - F.col("wy")).alias("dw"), ((F.col("wx") + F.col("wy")) / 2).alias("mw"))
    means = [F.count(F.lit(1)).alias("n"), F.avg("ds").alias("mean_score_delta"), F.avg("dw").alias("mean_word_delta")]
    fit = hc3(paired, "ds", "dw", ["family"]).withColumn("df", F.col("n_obs") - 2)
    fit = tidy(fit, "slope").join(paired.groupBy("family").agg(*means), "family")
    fit = fit.select(
        F.lit("within_family_regression").alias("analysis"), "family", F.lit("all").alias("bucket"), "n", F.col("slope").alias("estimate"), "se", "t", "p", "r_squared",
        "mean_score_delta", "mean_word_delta", *none("long", "positive"), *none("double", "least_words", "most_words"),
    )
    cut = tertiles(paired, "mw", record, ["family"]).groupBy("family", "tertile").agg(
        *means, F.count(F.when(F.col("ds") > 0, 1)).alias("positive"), F.min("mw").alias("least_words"), F.max("mw").alias("most_words")
    )
    cut = cut.select(
        F.lit("length_bucket").alias("analysis"), "family", F.element_at(F.array(F.lit("short"), F.lit("middle"), F.lit("long")), F.col("tertile") + 1).alias("bucket"), "n", F.col("mean_score_delta").alias("estimate"),
        *none("double", "se", "t", "p", "r_squared"), "mean_score_delta", "mean_word_delta", "positive", "least_words", "most_words",
    )
    return fixed.unionByName(fit).unionByName(cut)
