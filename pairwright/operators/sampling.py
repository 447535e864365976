"""Manifests and panels: quotas, heads, samples, letters."""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_rank_key
from .order import first


def allocate(counts: DataFrame, group: str, n: int, first: str) -> DataFrame:
    """Largest remainders: ``quota`` per group of a table of groups (group, count, first-seen order).

    Ties of remainder go to the larger and then the earlier group. The windows see a row per group.
    """
    w = Window.partitionBy()
    total = F.sum("count").over(w)
    exact = F.lit(n) * F.col("count") / total
    own = counts.withColumns({"__total": total, "base": F.least(F.floor(exact), F.col("count"))})
    own = own.withColumn("rest", F.lit(n) * F.col("count") - F.floor(F.lit(n) * F.col("count") / F.col("__total")) * F.col("__total"))
    left = F.lit(n) - F.sum("base").over(w)
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.desc("count"), F.asc(first)))
    own = own.withColumns({"__left": left, "__order": order})
    return own.select(group, "count", (F.col("base") + F.when((F.col("__order") <= F.col("__left")) & (F.col("base") < F.col("count")), 1).otherwise(0)).cast("long").alias("quota"))


def head_manifest(rows: DataFrame, group: str, seq: str, n: int) -> DataFrame:
    """The first rows of each group in corpus order, by quota."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.min(seq).alias("__first"))
    return first(rows, group, [F.col(seq)], allocate(counts, group, n, "__first"))


def hash_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """As ``head_manifest`` in the order of a hash of (seed, key)."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.min(key).alias("__first"))
    own = rows.withColumn("__hash", hash_rank_key(seed, F.col(key)))
    return first(own, group, [F.col("__hash"), F.col(key)], allocate(counts, group, n, "__first")).drop("__hash")


def seeded_panel(ids_by_source: list[tuple[str, list[str]]], quota: dict[str, int], seed: int) -> list[str]:
    """Panel mode: one seeded generator over sources in order, samples without replacement, sorted. For panels of dozens."""
    rng = random.Random(seed)
    return sorted(x for source, ids in ids_by_source for x in rng.sample(sorted(ids), quota.get(source, 0)))


def hash_letters(rows: DataFrame, record: str, system: str, seed: int) -> DataFrame:
    """``letter``: A, B, ... in the order of a hash of (seed, record, system) inside each record."""
    place = F.row_number().over(Window.partitionBy(record).orderBy(hash_rank_key(seed, F.col(record), F.col(system)), system))
    return rows.withColumn("letter", F.chr(F.lit(64) + place))


def seeded_letters(rows: DataFrame, record: str, system: str, seed: int) -> DataFrame:
    """As ``hash_letters`` with the standard library's generator, seeded per record: a group is a record's few systems."""
    from .. import functions as _  # noqa: F401
    from ..functions.text import stable_seed

    own = rows.select(F.col(record).cast("string").alias("record"), F.col(system).cast("string").alias("system"), stable_seed(seed, F.col(record)).cast("string").alias("seed"))

    def deal(group: Iterator[pd.DataFrame]) -> pd.DataFrame:
        systems = sorted(group["system"])
        random.Random(int(group["seed"].iloc[0])).shuffle(systems)
        return pd.DataFrame({"record": group["record"].iloc[0], "system": systems, "letter": list(string.ascii_uppercase[: len(systems)])})

    return own.groupBy("record").applyInPandas(deal, "record string, system string, letter string")
