"""Recompression dedup against a brute-force reading of its contract."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairwright.llm import recompression


def brute(rows, window):
    """rows of (doc_id, text) with distinct doc_ids -> {doc_id: (n_words, n_removed, sha256 of the kept words)}."""
    docs = sorted((d is not None, d or 0, re.findall(r"[^ \t-\r]+", t or "")) for d, t in rows)
    seen, out = set(), {}
    for some, d, words in docs:
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = True
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d if some else None] = (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 40, 90]))] for _ in range(12)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(passages)
            elif kind < 0.5:
                words += ["a"] * rng.randrange(60)
            elif kind < 0.6:
                words += ["a", "b"] * rng.randrange(40)
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randrange(50))]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200 + k, rows[rng.randrange(120)][1]) for k in range(30)]
    return [*rows, (300, None), (301, ""), (302, " \n"), (None, rows[5][1]), (303, "x" * 100_000), (304, "été " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, d string, t int").repartition(5)
    out = recompression.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "d", "t", "__n_words", "__n_removed", "__kept"]
    got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], hashlib.sha256(r["__kept"].encode()).hexdigest()) for r in out.collect()}
    assert got == brute(rows, 20)


def test_joins_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = fixture(3)
    monkeypatch.setattr(recompression, "MAX_SENT_BYTES", 0)
    out = recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], hashlib.sha256(r["__kept"].encode()).hexdigest()) for r in out.collect()}
    assert got == brute(rows, 20)


def test_repeated_rows_are_one_document_and_empty_tables_pass(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = recompression.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["__n_removed"]) for r in out.collect()) == [(1, 0), (1, 0), (2, 30)]
    assert recompression.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_substrings_get_equal_symbols_inside():
    rng = random.Random(9)
    middle = [rng.choice("abcdefgh") for _ in range(200)]
    texts = [" ".join([rng.choice("xyz") for _ in range(50)] + middle + [rng.choice("uvw") for _ in range(30)]) for _ in range(2)]
    levels, _, first, _ = recompression.parse(pa.array(texts))
    s = levels[5]
    for k in (0, 1):
        low, high = first[k] + 50, first[k] + 250
        own = [(int(n), int(b - first[k])) for n, b, ds, de in zip(s.name, s.s, s.ds, s.de, strict=True) if ds >= low and de <= high]
        assert len(own) > 20
        assert k == 0 or own == other  # noqa: F821
        other = own  # noqa: F841
