"""Translation edit rate: word edits after greedy block shifts, by Arrow batches (SQL has no form of it)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_SHIFT, MAX_DISTANCE = 10, 50


def alignment(hyp: list[str], ref: list[str]) -> tuple[int, list[int], list[bool]]:
    """(edits, the reference place before each hypothesis word and whether that word is matched)."""
    n, m = len(hyp), len(ref)
    if not n or not m:
        return n + m, [0] * n, [False] * n
    cost = [list(range(m + 1))]
    for i, w in enumerate(hyp, 1):
        before, row, left = cost[-1], [i], i
        diagonal = before[0]
        for v, up in zip(ref, before[1:], strict=True):
            least = diagonal if w == v else diagonal + 1
            diagonal = up
            if up < least:
                least = up + 1 if up + 1 < least else least
            if left < least:
                least = left + 1 if left + 1 < least else least
            row.append(least)
            left = least
        cost.append(row)
    at, right = [0] * n, [False] * n
    i, j = n, m
    while i > 0:
        if j > 0 and cost[i][j] == cost[i - 1][j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            at[i], right[i] = j, hyp[i] == ref[j]
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            at[i] = j
        else:
            j -= 1
    return cost[n][m], at, right


def masks(words: list[str]) -> dict[str, int]:
    """The places of each word, as bits."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def distance(hyp: list[str], ref: dict[str, int], m: int) -> int:
    """Edits alone, of a reference of m words given by its masks: a column of the table is a pair of bit rows (Myers, Hyyro)."""
    if not m:
        return len(hyp)
    whole, last, d = (1 << m) - 1, 1 << (m - 1), m
    up, down = whole, 0
    for w in hyp:
        same = ref.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        more, less = down | (whole & ~(zero | up)), up & zero
        if more & last:
            d += 1
        elif less & last:
            d -= 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(zero | more)) & whole, more & zero & whole
    return d


def edits(hyp: list[str], ref: list[str]) -> int:
    """Least edits that greedy shifts of matching phrases lead to, each shift an edit."""
    shifts, bits = 0, masks(ref)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    now, at, right = alignment(hyp, ref)
    while now > 0:
        taken = set()
        for i, ok in enumerate(right):
            if ok:
                taken.add(at[i])
        best = None
        for i in range(len(hyp)):
            for j in places.get(hyp[i], ()):
                if abs(j - at[i]) > MAX_DISTANCE:
                    continue
                k = 0
                while k < MAX_SHIFT and i + k < len(hyp) and j + k < len(ref) and hyp[i + k] == ref[j + k]:
                    k += 1
                    if all(right[i : i + k]) or all(p in taken for p in range(j, j + k)):
                        continue
                    rest = hyp[:i] + hyp[i + k :]
                    to = next((p for p in range(len(hyp)) if at[p] >= j and not i <= p < i + k), len(hyp))
                    to = to if to <= i else to - k
                    if to == i:
                        continue
                    moved = rest[:to] + hyp[i : i + k] + rest[to:]
                    gain = now - distance(moved, bits, len(ref))
                    if gain > 1 and (best is None or gain > best[0]):
                        best = (gain, moved)
        if best is None:
            break
        hyp, shifts = best[1], shifts + 1
        now, at, right = alignment(hyp, ref)
    return shifts + now


def rate(n_edits: int, n_words: int) -> float:
    return 100.0 * n_edits / n_words if n_words else 100.0 if n_edits else 0.0


@F.pandas_udf(LongType())
def _edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for hyp, ref in pairs:
        yield pd.Series([edits((h or "").lower().split(), (r or "").lower().split()) for h, r in zip(hyp, ref, strict=True)])


def line_edits(pairs: DataFrame, keys: list[str], line_pairs: Column) -> DataFrame:
    """keys, edits and reference words, summed over the line pairs of each key.

    Line pairs are dealt in a fixed number of parts: few bytes of text are much work, so that sizes say nothing of it.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = pairs.select(*keys, F.explode(line_pairs).alias("x")).repartition(parts)
    each = each.select(*keys, _edits(F.col("x.h"), F.col("x.r")).alias("e"), F.size(F.filter(F.split("x.r", r"\s+"), lambda w: w != "")).alias("n"))
    return each.groupBy(*keys).agg(F.sum("e").alias("edits"), F.sum("n").cast("long").alias("ref_words"))


def ter(n_edits: Column, n_words: Column) -> Column:
    return F.when(n_words > 0, 100.0 * n_edits / n_words).when(n_edits > 0, 100.0).otherwise(0.0)
