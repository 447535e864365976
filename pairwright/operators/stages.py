"""Gates between stages: complete translations before judging, private mappings, shard outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import gates
from .summary import completeness


def stage_gate(outputs: DataFrame, scores: DataFrame, expected: DataFrame, systems: DataFrame, system_count: int) -> DataFrame:
    """Violations that keep a judge from starting: incomplete systems, unequal record sets, scores that aren't numbers."""
    ok = (F.col("status") == "ok") & (strip(F.col("output_text")) != "")
    per = completeness(outputs, expected, systems, "record_id", "system_id", ok)
    whole = per.agg(F.count(F.when(~F.col("complete"), 1)).alias("n")).select(F.lit("incomplete_systems").alias("check"), "n")
    n = systems.select("system_id").distinct().agg((F.count(F.lit(1)) != system_count).cast("long").alias("n")).select(F.lit("system_count").alias("check"), "n")
    grid = expected.select("record_id").distinct().join(F.broadcast(systems.select("system_id").distinct()), how="cross")  # a few systems
    return gates.union(whole, n, gates.row_checks(scores, {"score_not_finite": gates.finite("score")}), gates.key_sets(scores, grid, ["system_id", "record_id"]))


def mapping_faults(mapping: DataFrame, records: DataFrame, outputs: DataFrame, systems: int) -> DataFrame:
    """Violations of a private mapping (record_id, candidate_id, system_id): its records, candidates, systems, outputs."""
    per = mapping.groupBy("record_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("candidate_id").alias("c"), F.count_distinct("system_id").alias("s"))
    bad = per.agg(F.count(F.when((F.col("rows") != systems) | (F.col("c") != systems) | (F.col("s") != systems), 1)).alias("n"))
    good = outputs.where((F.col("status") == "ok") & (strip(F.col("output_text")) != "")).select("record_id", "system_id").distinct()
    lost = mapping.join(good, ["record_id", "system_id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return gates.union(bad.select(F.lit("not_a_bijection").alias("check"), "n"), lost.select(F.lit("output_not_ok").alias("check"), "n"), gates.key_sets(mapping, records, ["record_id"]))


def with_mapping(answers: DataFrame, private: DataFrame) -> DataFrame:
    """The mapping of each answer: its own where it has one, else the private one (arrays of candidates)."""
    other = private.select("record_id", F.col("candidate_map").alias("__private"))
    return answers.join(other, "record_id", "left").withColumn("candidate_map", F.coalesce("candidate_map", "__private")).drop("__private")


def verification_report(violations: DataFrame, facts: dict) -> str:
    """JSON of a gate's outcome, for passes and failures alike. A row per check is collected."""
    found = {r["check"]: r["n"] for r in violations.collect()}
    return json.dumps({**facts, "violations": found, "passed": not any(found.values())}, ensure_ascii=False, sort_keys=True)


def shard_paths(paths: list[str], index: int, count: int) -> None:
    """Outputs of a shard carry its number, so that shards can't overwrite one another."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    token = f"shard-{index}-of-{count}"
    missing = [p for p in paths if token not in p]
    if count > 1 and missing:
        raise ValueError(f"without {token}: {missing}")


def system_paths(specs: list[str]) -> dict[str, str]:
    """``SYSTEM=PATH`` arguments, each system once."""
    out: dict[str, str] = {}
    for s in specs:
        name, _, path = (x.strip() for x in s.partition("="))
        if not name or not path or name in out:
            raise ValueError(f"not SYSTEM=PATH, or twice: {s!r}")
        out[name] = path
    return out


def ranking_faults(parsed: DataFrame, mapping: DataFrame, record: str = "record_id") -> DataFrame:
    """Records whose parsed answer ranks or scores other candidates than its mapping names. parsed: record, answer."""
    named = mapping.groupBy(record).agg(F.array_sort(F.collect_set("candidate_id")).alias("__named"))
    own = parsed.select(record, F.array_sort("answer.ranking").alias("__ranked"), F.array_sort(F.transform("answer.candidate_scores", lambda c: c["candidate_id"])).alias("__scored"))
    both = own.join(named, record, "full_outer")
    bad = lambda c: F.count(F.when(~F.coalesce(F.col(c) == F.col("__named"), F.lit(False)), 1))
    one = both.agg(bad("__ranked").alias("ranking_differs"), bad("__scored").alias("candidates_differ"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in ("ranking_differs", "candidates_differ")])).alias("x")).select("x.*")
