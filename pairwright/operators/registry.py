"""Systems, sets of systems, labels, folders and manifests of a run."""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists


@dataclass(frozen=True)
class System:
    system_id: str
    name: str
    model: str
    mode: str
    family: str


class Registry:
    """Systems in a fixed order, and aliases of sets of them."""

    def __init__(self, systems: list[System], aliases: dict[str, list[str]] | None = None) -> None:
        self.systems = {s.system_id: s for s in systems}
        if len(self.systems) < len(systems):
            raise ValueError("a system is registered twice")
        self.aliases = {"all": list(self.systems)} | (aliases or {})

    def expand(self, names: list[str]) -> list[str]:
        """Ids of systems and aliases, each once, in the order given; unknown names are an error."""
        out: dict[str, None] = {}
        for n in names:
            if n not in self.aliases and n not in self.systems:
                raise ValueError(f"no such system or set: {n}")
            out |= dict.fromkeys(self.aliases.get(n, [n]))
        return list(out)

    def families(self) -> dict[str, tuple[str, str]]:
        """family: (its plain system, its thinking one), of families that have both."""
        found: dict[str, dict[str, str]] = {}
        for s in self.systems.values():
            found.setdefault(s.family, {})[s.mode] = s.system_id
        return {f: (m["plain"], m["thinking"]) for f, m in found.items() if {"plain", "thinking"} <= m.keys()}

    def table(self, spark: SparkSession) -> DataFrame:
        """system_id, place, name, model, mode, family: the dimension table."""
        rows = [(s.system_id, k, s.name, s.model, s.mode, s.family) for k, s in enumerate(self.systems.values())]
        return spark.createDataFrame(rows, "system_id string, place int, name string, model string, mode string, family string")


def label(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key; a key without one stays as it is."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key) if pairs else key


def in_order(rows: DataFrame, key: str, order: list[str], *rest: str) -> DataFrame:
    """Rows sorted by a custom order of ``key`` (unknown keys last), then by the other columns."""
    places = F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, k)])
    return rows.orderBy(F.coalesce(F.element_at(places, F.col(key)), F.lit(len(order))), *rest)


def run_stamp() -> str:
    """The time of a run in UTC, taken once and written into its rows as a literal."""
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def prompt_version(default: str = "v1", name: str = "PROMPT_VERSION") -> str:
    return os.environ.get(name, "").strip() or default


@dataclass(frozen=True)
class Paths:
    """Where a run's tables lie below its folder."""

    root: str

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def manifest(self) -> str:
        return self.at("manifest")

    def outputs(self, system: str) -> str:
        return self.at("outputs", system)

    def scores(self, system: str) -> str:
        return self.at("scores", system)

    @property
    def summary(self) -> str:
        return self.at("summary")


def prepared(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """A manifest that is made once: what is written at ``path`` is used again unless it is to be overwritten."""
    if overwrite or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def extrapolated(run: Callable[[int], object], n: int, total: int, clock: Callable[[], float]) -> dict[str, float]:
    """Seconds that ``run(n)`` takes and what ``total`` would take in proportion."""
    if n < 1 or total < n:
        raise ValueError(f"{n} of {total}")
    start = clock()
    run(n)
    took = clock() - start
    return {"n": n, "seconds": took, "seconds_each": took / n, "total": total, "seconds_total": took / n * total}
