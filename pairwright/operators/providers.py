"""Row sources behind a service: a pluggable client called per row, with retries and fail-over.

No client for a network is part of this library; ``EchoClient`` stands in offline.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "status string, output_text string, error string, attempts int, latency_seconds double, client string"


@dataclass(frozen=True)
class Result:
    status: str
    output_text: str = ""
    error: str = ""

    @staticmethod
    def not_available(why: str) -> Result:
        return Result("not_available", error=why)


@dataclass(frozen=True)
class EchoClient:
    """Gives the prompt back; fails for prompts that hold ``broken``."""

    label: str = "echo"
    broken: str = "\0"

    def __call__(self, prompt: str) -> Result:
        return Result("error", error="service unavailable 503") if self.broken in prompt else Result("ok", prompt)


@dataclass
class Retry:
    """Tries each client in turn, each up to ``times`` with pauses that double."""

    clients: list[Callable[[str], Result]]
    times: int = 3
    pause: float = 0.0
    retryable: Callable[[str], bool] = field(default=lambda error: any(s in error for s in ("408", "429", "500", "502", "503", "504")))

    def __call__(self, prompt: str) -> tuple[Result, int, str]:
        last, tries, label = Result.not_available("no client"), 0, ""
        for client in self.clients:
            label = getattr(client, "label", type(client).__name__)
            for k in range(self.times):
                tries += 1
                last = client(prompt)
                if last.status == "ok":
                    return last, tries, label
                if not self.retryable(last.error):
                    break
                time.sleep(self.pause * 2**k)
        return last, tries, label


def call(rows: DataFrame, prompt: str, policy: Retry) -> DataFrame:
    """``rows`` with the service's answer to each row's prompt. A partition is a worker; failed rows stay as rows."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in names] + [RESULT])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b[prompt].fillna(""):
                start = time.time()
                result, tries, label = policy(text)
                out.append((result.status, result.output_text, result.error, tries, time.time() - start, label))
            own = b.drop(columns=[n for n in names if n in b.columns]).reset_index(drop=True)
            yield pd.concat([own, pd.DataFrame(out, columns=names)], axis=1)

    return rows.mapInPandas(run, schema)


def unique_clients(specs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(label, address) once each, in order."""
    return list(dict.fromkeys(specs))
