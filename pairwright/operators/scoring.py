"""Scoring of outputs against a manifest: form diagnostics, text metrics, model scorers by profile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ngram, ter
from ..functions import text as t
from .latest import enrich, in_manifest, latest_wins
from .summary import share_time, system_summary

#: Profile: the model scorers that it runs.
PROFILES = {"light": [], "semantic": ["semantic"], "learned": ["learned"], "all": ["semantic", "learned"]}
Scorer = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]


def model_scores(rows: DataFrame, name: str, load: Callable[[], Scorer] | None) -> DataFrame:
    """``name`` and ``name_error``: scores of (source, hypothesis, reference) by a model loaded once per worker.

    Without a loader, or where loading or scoring fails, scores are null and the error says why; rows stay.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{name}` double", f"`{name}_error` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, error = None, f"{name} is not available: no model is installed"
        if load is not None:
            try:
                score, error = load(), ""
            except Exception as e:  # any failure of a plug-in is a reason, not a lost job
                error = f"{name} is not available: {e}"
        for b in batches:
            values, why = None, error
            if score is not None:
                try:
                    values = pd.Series(score(b["source"], b["hypothesis"], b["reference"])).to_numpy()
                except Exception as e:
                    why = f"{name} failed: {e}"
            yield b.assign(**{name: values if values is not None else None, f"{name}_error": why})

    return rows.mapInPandas(run, schema)


def score_rows(outputs: DataFrame, manifest: DataFrame, profile: str = "light", loaders: dict[str, Callable[[], Scorer]] | None = None, counts: bool = False) -> DataFrame:
    """A row per (system, record) of the manifest with all diagnostics and metrics; metrics are null for rows that aren't ok.

    With ``counts`` the column of that name keeps what they were made of, so that corpus scores don't count again.

    outputs: system_id, record_id, seq, status, output_text, ...; manifest: record_id, source_id, source, reference.
    """
    rows = enrich(latest_wins(in_manifest(outputs, manifest, "record_id"), ["system_id", "record_id"], "seq"), manifest, "record_id")
    rows = rows.withColumn("hypothesis", t.strip(F.col("output_text")))
    h, r = F.col("hypothesis"), F.col("reference")
    rows = rows.withColumns(
        {"line_count_diff": t.line_count_difference(h, r), "length_ratio": t.length_ratio(h, r), "english_ratio": t.english_ratio(h), "empty_output": t.empty_output(h), "ok": (F.col("status") == "ok") & (h != "")}
    )
    keys = ["system_id", "record_id"]
    rows, ok = _counted(rows, keys), F.col("ok")
    scores = {"bleu": ngram.bleu(True, "counts.bleu."), "chrf": ngram.chrf(at="counts.chrf."), "ter": ter.ter(F.col("counts.edits"), F.col("counts.ref_words"))}
    rows = rows.withColumns({k: F.when(ok, c) for k, c in scores.items()})
    rows = rows if counts else rows.drop("counts")
    for name in ("semantic", "learned"):
        if name in PROFILES[profile]:
            rows = model_scores(rows, name, (loaders or {}).get(name))
        else:
            rows = rows.withColumns({name: F.lit(None).cast("double"), f"{name}_error": F.lit(f"{name} is not in profile {profile}")})
    return rows


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``counts``: n-gram counts for BLEU and chrF++, word edits and reference words; of rows that aren't ok, of empty texts."""
    own = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    own = own.withColumns({"__h": F.when(F.col("ok"), F.col("hypothesis")), "__r": F.when(F.col("ok"), F.col("reference"))})
    own = ngram.counted(ngram.counted(own, "__h", "__r", ngram.BLEU_ORDERS, "__bleu"), "__h", "__r", ngram.CHRF_ORDERS, "__chrf")
    edits = ter.line_edits(rows.where("ok"), keys, t.line_pairs(F.col("hypothesis"), F.col("reference"))).select(*keys, F.col("edits").alias("__edits"), F.col("ref_words").alias("__ref_words"))
    parts = F.struct(*[F.col(f"__{c}").alias(c) for c in ("bleu", "chrf", "edits", "ref_words")])
    return own.join(edits, keys, "left").select(*rows.columns, parts.alias("counts"))


def corpus_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Corpus BLEU, chrF++ and TER over the ok rows of each group: summed statistics, not means of scores.

    Rows with ``counts`` (see ``score_rows``) are only summed.
    """
    ok = scored.where("ok")
    if "counts" not in scored.columns:
        keys = [*by, *[k for k in ("system_id", "record_id") if k not in by]]
        ok = _counted(ok.select(*keys, "ok", "hypothesis", "reference"), keys)
    own = lambda fields: ngram.add_up(ok.select(*by, *fields), by, [])
    bleu = own(["counts.bleu.*"]).select(*by, ngram.bleu(False).alias("bleu_corpus"))
    chrf = own(["counts.chrf.*"]).select(*by, ngram.chrf().alias("chrf_corpus"))
    edits = own(["counts.edits", "counts.ref_words"]).select(*by, ter.ter(F.col("edits"), F.col("ref_words")).alias("ter_corpus"))
    return bleu.join(chrf, by).join(edits, by)


FIELDS = ["bleu", "chrf", "ter", "line_count_diff", "length_ratio", "english_ratio", "empty_output"]


def score_systems(scored: DataFrame, seconds: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The summary of each system (or of ``by``) with its corpus scores."""
    by = by or ["system_id"]
    return share_time(system_summary(scored, by, FIELDS), seconds).join(corpus_scores(scored, by), by, "left")
