"""Counts of n-grams and edits against plain readings, and the shape of the plans that take them."""

import random
from collections import Counter

import pandas as pd

from pairwright.functions import ngram, ter
from pairwright.operators import scoring

LOG = "system_id string, record_id string, seq long, status string, output_text string, error string, prompt_version string, latency_seconds double"


def plain(h, r, n):
    a, b = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (h, r))
    return [sum((a & b).values()), sum(a.values()), sum(b.values())]


def test_counts_equal_a_plain_reading():
    rng = random.Random(2)
    texts = ["", "a", "\U0001f600b\U0001f600"] + ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(60))) for _ in range(80)]
    h, r = rng.choices(texts, k=200), rng.choices(texts, k=200)
    want = [[c for n in range(1, 7) for c in plain(a, b, n)] for a, b in zip(h, r, strict=True)]
    assert ngram.char_counts(h, r, list(range(1, 7))).tolist() == want
    assert ngram.char_counts([""], [""], [1, 2]).tolist() == [[0] * 6]
    for a, b in zip(h, r, strict=True):
        assert [list(ngram.counts(list(a), list(b), n)) for n in (1, 2, 4)] == [plain(a, b, n) for n in (1, 2, 4)]
    parts = list(ngram._portions(pd.Series(["x" * 700_000] * 4), pd.Series([""] * 4)))
    assert sorted(k for p in parts for k in range(4)[p]) == [0, 1, 2, 3] and len(parts) > 1


def test_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(500):
        h, r = ([rng.choice("abcdef") for _ in range(rng.randrange(70))] for _ in range(2))
        assert ter.distance(h, ter.masks(r), len(r)) == ter.alignment(h, r)[0]


def test_work_is_dealt_in_parts_and_done_once(spark, capsys):
    """Few bytes are much work: a plan that leaves the parts to sizes gives it to one task; corpus scores only add up."""
    outputs = spark.createDataFrame([("s", str(k), k, "ok", f"the cat {k} sat", "", "v", 1.0) for k in range(40)], LOG)
    manifest = spark.createDataFrame([(str(k), "p", "x", "the cat sat") for k in range(40)], "record_id string, source_id string, source string, reference string")
    rows = scoring.score_rows(outputs, manifest, counts=True)
    rows.select("system_id", "counts").explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") <= 3 and "Exchange RoundRobinPartitioning" in plan and "Generate explode(flatten" not in plan
    stored = rows.persist()
    stored.count()
    scoring.corpus_scores(stored, ["system_id"]).explain()
    top = capsys.readouterr().out.split("InMemoryRelation")[0]
    assert "ArrowEvalPython" not in top
    a, b = (scoring.corpus_scores(x, ["system_id"]).first() for x in (stored, stored.drop("counts")))
    assert a == b and a["bleu_corpus"] > 0
    stored.unpersist()
