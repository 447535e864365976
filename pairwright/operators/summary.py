"""Grouped summaries: systems, sources, macro averages, resources, composites, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sd(c: Column) -> Column:
    """Sample deviation; 0 for one value, null for none."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def ci95(c: Column) -> Column:
    return F.when(F.count(c) == 1, 0.0).otherwise(1.96 * F.stddev_samp(c) / F.sqrt(F.count(c)))


def system_summary(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Counts, versions, run time, and mean, deviation and half-width of ``fields`` over ok rows.

    rows: status, output_text, prompt_version, error, seq, latency_seconds. A row is ok if its status is and
    its text isn't blank; failed rows are those of another status, so blank ok rows are in neither.
    """
    ok = (F.col("status") == "ok") & (F.trim(F.coalesce("output_text", F.lit(""))) != "")
    failed = F.coalesce(F.col("status") != "ok", F.lit(True))
    count = lambda c: F.count(F.when(c, 1))
    aggs = [
        F.count(F.lit(1)).alias("n_total"), count(ok).alias("n_ok"), count(failed).alias("n_failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("prompt_version") != "", F.col("prompt_version")))), ";").alias("prompt_version"),
        F.coalesce(F.sum("latency_seconds"), F.lit(0.0)).alias("runtime_seconds_total"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("seq"))).alias("first_error"),
    ]
    for f in fields:
        x = F.when(ok, F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")))
        aggs += [F.avg(x).alias(f"{f}_mean"), sd(x).alias(f"{f}_sd"), ci95(x).alias(f"{f}_ci95")]
    out = rows.groupBy(*by).agg(*aggs)
    some = F.col("n_ok") > 0
    out = out.withColumn("status", F.when(some, "ok").otherwise("not_available_or_failed"))
    return out.withColumn("metric_errors", F.when(some, "").otherwise(F.coalesce("first_error", F.lit("")))).drop("first_error")


def share_time(summary: DataFrame, seconds: float) -> DataFrame:
    """Scoring time shared evenly by the systems with ok rows. A window over a row per system."""
    n = F.sum(F.when(F.col("n_ok") > 0, 1).otherwise(0)).over(Window.partitionBy())
    return summary.withColumn("scoring_seconds", F.when(F.col("n_ok") > 0, F.lit(seconds) / n).otherwise(0.0))


def source_summary(rows: DataFrame, source: str, system: str, value: str) -> DataFrame:
    """Per source and system: count, mean, deviation, half-width and the share of the system's rows."""
    x = F.col(value).cast("double")
    out = rows.groupBy(source, system).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sd(x).alias("sd"), ci95(x).alias("ci95"))
    # Sources times systems rows are left here.
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(system)))


def macro_average(rows: DataFrame, source: str, system: str, values: list[str], known: list[str]) -> DataFrame:
    """Means per source and system, then one ``overall`` row per system: the unweighted mean over known sources."""
    per = rows.groupBy(source, system).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    overall = per.where(F.col(source).isin(known)).groupBy(system).agg(F.sum("n").alias("n"), *[F.avg(v).alias(v) for v in values])
    return per.unionByName(overall.withColumn(source, F.lit("overall")))


def completeness(attempts: DataFrame, expected: DataFrame, systems: DataFrame, key: str, system: str, ok: Column) -> DataFrame:
    """Counters per system against the expected keys. attempts: all physical rows, with ``seq``."""
    rows = attempts.withColumn("ok", ok)
    per = rows.groupBy(system, key).agg(F.count(F.lit(1)).alias("rows"), F.max_by("ok", "seq").alias("ok"))
    grid = expected.select(key).distinct().join(F.broadcast(systems.select(system).distinct()), how="cross").withColumn("expected", F.lit(True))  # a few systems
    both = grid.join(per, [system, key], "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    wanted, seen = F.coalesce("expected", F.lit(False)), F.col("rows").isNotNull()
    out = both.groupBy(system).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), count(seen).alias("unique_count"), count(seen & F.col("ok")).alias("ok_count"),
        count(seen & ~F.col("ok")).alias("not_ok_count"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_key_count"),
        count(wanted & ~seen).alias("missing_count"), count(seen & ~wanted).alias("unexpected_count"), count(wanted).alias("expected_count"),
    )
    whole = (F.col("missing_count") == 0) & (F.col("unexpected_count") == 0) & (F.col("duplicate_key_count") == 0) & (F.col("not_ok_count") == 0)
    return out.withColumn("complete", whole)


def resources(attempts: DataFrame, system: str, key: str, ok: Column, measures: list[str]) -> DataFrame:
    """Over physical attempts: counts and failure rate; mean, median and total of the measures of successes."""
    aggs = [F.count(F.lit(1)).alias("attempts"), F.count(F.when(ok, 1)).alias("successes"), F.count_distinct(F.when(ok, F.col(key))).alias("unique_finals")]
    for m in measures:
        x = F.when(ok, F.col(m).cast("double"))
        aggs += [F.avg(x).alias(f"{m}_mean"), F.percentile(x, 0.5).alias(f"{m}_median"), F.sum(x).alias(f"{m}_total")]
    out = attempts.groupBy(system).agg(*aggs)
    return out.withColumn("failure_rate", 1 - F.col("successes") / F.col("attempts"))


def complete_composites(ratings: DataFrame, unit: list[str], dim: str, score: str, n_dims: int) -> DataFrame:
    """Mean over dimensions of each unit that has exactly ``n_dims`` rows of as many dimensions."""
    out = ratings.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(dim).alias("dims"), F.avg(F.col(score).cast("double")).alias("composite"))
    return out.where((F.col("rows") == n_dims) & (F.col("dims") == n_dims)).drop("rows", "dims")


def rater_composites(ratings: DataFrame, item: list[str], rater: str, dim: str, score: str, n_dims: int, least: int) -> DataFrame:
    """Per item the mean of complete composites over raters; ``enough`` says whether there are ``least``."""
    per = complete_composites(ratings, [*item, rater], dim, score, n_dims)
    return per.groupBy(*item).agg(F.count(F.lit(1)).alias("raters"), F.avg("composite").alias("composite")).withColumn("enough", F.col("raters") >= least)


def dimension_composites(ratings: DataFrame, item: list[str], rater: str, dim: str, score: str, n_raters: int, n_dims: int, least: int) -> DataFrame:
    """Per dimension the mean over raters (``least`` of them), then the equal mean of dimensions; missing cells counted."""
    per = ratings.groupBy(*item, dim).agg(F.count_distinct(rater).alias("raters"), F.avg(F.col(score).cast("double")).alias("x"))
    out = per.groupBy(*item).agg(F.avg("x").alias("composite"), F.sum("raters").alias("cells"), F.min("raters").alias("least_raters"), F.count(F.lit(1)).alias("dims"))
    return out.select(*item, "composite", (F.lit(n_raters * n_dims) - F.col("cells")).alias("missing_cells"), ((F.col("least_raters") >= least) & (F.col("dims") == n_dims)).alias("valid"))


def rater_direction(ratings: DataFrame, rater: str, record: str, system: str, score: str, families: dict[str, tuple[str, str]]) -> DataFrame:
    """Per family and rater the paired mean first - second, with the family's counts and bounds beside it."""
    cell = ratings.groupBy(rater, record, system).agg(F.avg(F.col(score).cast("double")).alias("x"))
    each = [F.struct(F.lit(f).alias("family"), F.lit(a).alias("__a"), F.lit(b).alias("__b")) for f, (a, b) in families.items()]
    rows = cell.withColumn("__f", F.explode(F.array(*each))).where(F.col(system).isin([s for p in families.values() for s in p]))
    pick = lambda s: F.max(F.when(F.col(system) == F.col(s), F.col("x")))
    pairs = rows.select("*", "__f.*").groupBy("family", rater, record).agg(pick("__a").alias("x"), pick("__b").alias("y")).where("x is not null and y is not null")
    out = pairs.groupBy("family", rater).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("delta"))
    # A row per family and rater is left here.
    w = Window.partitionBy("family")
    return out.withColumns({"positive_raters": F.sum((F.col("delta") > 0).cast("long")).over(w), "least": F.min("delta").over(w), "most": F.max("delta").over(w)})


def leave_one_out(scores: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """Greatest shift of each group's mean when one unit is left out, in closed form: no join with units."""
    per = scores.groupBy(group, unit).agg(F.avg(F.col(value).cast("double")).alias("x"))
    total = per.groupBy(group).agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    each = per.join(total, group).withColumn("shift", F.when(F.col("n") > 1, F.abs((F.col("s") - F.col("x")) / (F.col("n") - 1) - F.col("s") / F.col("n"))))
    return each.groupBy(group).agg(F.max("n").alias("n"), F.max(F.col("s") / F.col("n")).alias("mean"), F.max("shift").alias("max_shift"), F.min("shift").alias("min_shift"))


def count_string(rows: DataFrame, by: list[str], name: str, alias: str) -> DataFrame:
    """``k:v;k:v`` of the counts of ``name`` in each group, sorted by key."""
    counts = rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "n"))), lambda x: F.concat_ws(":", x[name], x["n"].cast("string"))), ";")
    return counts.groupBy(*by).agg(text.alias(alias))


def cell_means(ratings: DataFrame, item: list[str], score: str) -> DataFrame:
    """Per item the mean over all its cells, whoever rated what."""
    return ratings.groupBy(*item).agg(F.count(score).alias("cells"), F.avg(F.col(score).cast("double")).alias("mean"))


def against_targets(latest: DataFrame, targets: DataFrame, system: str, ok: Column) -> DataFrame:
    """Per system of ``targets`` (system, target) the latest ok and failed rows, and whether the target is reached. A row per system."""
    per = latest.groupBy(system).agg(F.count(F.when(ok, 1)).alias("ok_count"), F.count(F.when(~ok, 1)).alias("failed_count"))
    out = targets.join(per, system, "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(system, "target", count("ok_count").alias("ok_count"), count("failed_count").alias("failed_count"), (count("ok_count") >= F.col("target")).alias("reached"))


def source_metrics(rows: DataFrame, source: str, system: str, fields: list[str], seconds: float) -> DataFrame:
    """``system_summary`` per source and system; a system's scoring time is shared by its sources' ok rows."""
    per = system_summary(rows, [source, system], fields)
    whole = F.sum("n_ok").over(Window.partitionBy(system))  # a row per source
    systems = per.groupBy(system).agg((F.sum("n_ok") > 0).cast("int").alias("some")).agg(F.sum("some").alias("__systems"))  # one row
    out = per.withColumn("__whole", whole).crossJoin(F.broadcast(systems))
    return out.withColumn("scoring_seconds", F.when(F.col("n_ok") > 0, F.lit(seconds) / F.col("__systems") * F.col("n_ok") / F.col("__whole")).otherwise(0.0)).drop("__whole", "__systems")


def matrix(ratings: DataFrame, by: list[str], rater: str, score: str, raters: list) -> DataFrame:
    """Per group the scores of all ``raters`` in their order, null where one is missing."""
    cells = F.map_from_entries(F.collect_list(F.struct(rater, score)))
    return ratings.groupBy(*by).agg(cells.alias("__m")).select(*by, F.array(*[F.element_at("__m", F.lit(r).cast(ratings.schema[rater].dataType)) for r in raters]).alias("scores"))
