"""Append-only attempt logs: the latest row of each key, resume sets, shards and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import positions


def latest_wins(attempts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the greatest ``seq`` of each key: a partial aggregation, no sort. Null keys are a key."""
    rest = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def in_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest.select(key), key, "left_semi")


def enrich(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest, key)


def remaining(work: DataFrame, done: DataFrame, keys: list[str], retry_failed: bool = False, status: str = "status") -> DataFrame:
    """Work without a row in ``done``; with ``retry_failed`` only ok rows count as done."""
    return work.join((done.where(F.col(status) == "ok") if retry_failed else done).select(*keys), keys, "left_anti")


def with_sequence(frames: list[DataFrame], seq: str) -> DataFrame:
    """Logs one after another: (log, seq) as one order."""
    parts = [f.withColumn("log", F.lit(k)) for k, f in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumn("log_seq", F.struct("log", seq)).drop("log")


def merge_logs(frames: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """Rows without a whole key pass; of the others the latest of each key stays."""
    both = with_sequence(frames, seq)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    kept = latest_wins(both.where(whole), keys, "log_seq")
    return both.where(~whole).unionByName(kept).drop("log_seq")


def shard(rows: DataFrame, order: str, count: int) -> DataFrame:
    """``position`` in the order, counted in parallel, and ``shard`` = position modulo ``count``."""
    return positions(rows, [], [F.col(order)]).withColumn("shard", F.col("position") % count)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """only_left, only_right, common: the sizes of what two sets of keys share."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    return both.select(F.col("l").isNotNull().alias("l"), F.col("r").isNotNull().alias("r")).agg(
        count(F.col("l") & ~F.col("r")).alias("only_left"), count(~F.col("l") & F.col("r")).alias("only_right"), count(F.col("l") & F.col("r")).alias("common")
    )


def with_values(pairs: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair with its values, null where there are none. Two rows of values for one pair are an error at run time."""
    rest = [c for c in values.columns if c not in keys]
    one = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__v"))
    single = F.when(F.col("__n") > 1, F.raise_error(F.lit("several values for one pair"))).otherwise(F.col("__v"))
    one = one.select(*keys, single.alias("__v"))
    return pairs.join(one, keys, "left").select(*pairs.columns, *[F.col(f"__v.{c}").alias(c) for c in rest])


def joined_whole(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that may lose no row: one without a partner is an error at run time."""
    tagged = other.withColumn("__here", F.lit(True))
    out = rows.join(tagged, keys, "left")
    whole = F.when(F.col("__here").isNull(), F.raise_error(F.concat(F.lit("no partner for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))).otherwise(F.col(keys[0]))
    return out.withColumn(keys[0], whole).drop("__here")


def looked_up(cases: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """A few curated cases with a JSON object of their row in each table, ``{}`` where there is none. Tables are read for these cases alone."""
    out = cases
    few = F.broadcast(cases.select(key).distinct())  # curated by hand
    for name, t in tables.items():
        rest = [c for c in t.columns if c != key]
        own = t.join(few, key, "left_semi").groupBy(key).agg(F.max(F.struct(*rest)).alias("__r"))
        out = out.join(own, key, "left").withColumn(name, F.coalesce(F.to_json("__r"), F.lit("{}"))).drop("__r")
    return out


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order: the limit of a manifest, before it is dealt to shards."""
    return rows.orderBy(order).limit(n)


def head_outputs(manifest: DataFrame, outputs: DataFrame, key: str, order: str, n: int, ok) -> DataFrame:
    """The latest usable output (``ok``) of each system for the first ``n`` manifest rows. outputs: system_id, ``key``, seq, ..."""
    rows = latest_wins(in_manifest(outputs, head(manifest, order, n), key), ["system_id", key], "seq")
    return rows.where(ok)


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join of tables that each have a key once: a key that occurs twice on a side is an error at run time."""
    sides = []
    for name, t in (("left", left), ("right", right)):
        rest = [c for c in t.columns if c not in keys]
        one = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__v"))
        twice = F.raise_error(F.concat(F.lit(f"{name} has a key twice: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
        one = one.withColumn("__v", F.when(F.col("__n") > 1, twice).otherwise(F.col("__v")))
        sides.append(one.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]))
    return sides[0].join(sides[1], keys)
