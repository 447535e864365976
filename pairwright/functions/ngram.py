"""BLEU and chrF++ from clipped n-gram counts: texts are cut into units by expressions, n-grams counted pair by pair in Arrow batches, closed formulas.

Statistics are sums, so that a corpus score is the formula over summed statistics of its pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text

BLEU_ORDERS = {f"w{n}": ("words", n) for n in range(1, 5)}
CHRF_ORDERS = {f"c{n}": ("chars", n) for n in range(1, 7)} | {f"w{n}": ("split", n) for n in range(1, 3)}
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def tokens_13a(c: Column) -> Column:
    """The usual tokens of machine-translation scoring."""
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c if isinstance(c, Column) else F.col(c), F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, by in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        c = F.regexp_replace(c, pattern, by)
    return words(c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def split_words(c: Column) -> Column:
    """Words with a final, or else a first, punctuation mark apart."""
    cut = F.regexp_replace(F.regexp_replace(c, rf"(?<=\S)({_PUNCTUATION})(?=\s|$)", "\u0001$1"), rf"(?<=^|\s)({_PUNCTUATION})(?=[^\s\u0001]+(\s|$))", "$1\u0001")
    return F.filter(F.split(cut, "[\\s\u0001]+"), lambda x: x != "")


_UNITS = {"words": tokens_13a, "chars": lambda c: F.regexp_replace(c, r"\s+", ""), "split": split_words}


def _grams(units: list[str], n: int) -> Iterable[str]:
    """n-grams of words, joined by a mark."""
    return units if n == 1 else map("\u0002".join, zip(*(units[k:] for k in range(n)), strict=False))


def counts(h: list[str], r: list[str], n: int) -> tuple[int, int, int]:
    """Clipped matches of two word sequences' n-grams, and n-grams of each."""
    size = (max(0, len(h) - n + 1), max(0, len(r) - n + 1))
    if not all(size):
        return 0, *size
    there = Counter(_grams(r, n))
    both = Counter(filter(there.__contains__, _grams(h, n)))  # what the reference doesn't have isn't counted
    return sum(min(k, there[g]) for g, k in both.items()), *size


def char_counts(h: list[str], r: list[str], orders: list[int]) -> np.ndarray:
    """``counts`` of the characters of many pairs at once, for orders 1, 2, ...: a row per pair, three columns per order.

    An n-gram is named by its first n - 1 characters' name and its last character: numbers, not hashes. A place whose name
    only one side has is dropped, as no longer n-gram from there can match.
    """
    text_ = [*h, *r]
    size = np.array([len(x) for x in text_], np.int64)
    code = np.unique(np.frombuffer("".join(text_).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    letters = int(code.max(initial=0)) + 1
    which = np.repeat(np.arange(len(text_)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the end of the text
    at, name = np.arange(len(code)), which % max(1, len(h))
    out = np.zeros((len(h), 3 * len(orders)), np.int64)
    for k, n in enumerate(orders):
        own = left[at] >= n
        at, name = at[own], name[own]
        key, name = np.unique(name * letters + code[at + n - 1], return_inverse=True)
        mine = which[at] < len(h)
        there = [np.bincount(name[side], minlength=len(key)) for side in (mine, ~mine)]
        pair = np.zeros(len(key), np.int64)
        pair[name] = which[at] % max(1, len(h))
        both = np.minimum(*there)
        out[:, 3 * k] = np.bincount(pair, both, len(h))
        out[:, 3 * k + 1], out[:, 3 * k + 2] = np.maximum(size - n + 1, 0).reshape(2, -1)
        own = both[name] > 0
        at, name = at[own], name[own]
    return out


def _portions(h: pd.Series, r: pd.Series) -> Iterator[slice]:
    """Rows in portions of about a million characters: what one count holds."""
    upto = (h.str.len() + r.str.len()).cumsum().to_numpy() // 1_000_000
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(h)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def counted(rows: DataFrame, hypothesis: str, reference: str, orders: dict, name: str) -> DataFrame:
    """``rows`` with the struct ``name``: for each order ``m_``, ``h_``, ``r_``, clipped matches and n-grams of both sides.

    A pair's n-grams live only while its row is counted: no row is made of an n-gram, and nothing of them is shuffled.
    """
    needed = sorted({u for u, _ in orders.values()})
    fields = [f"{s}_{o}" for o in orders for s in "mhr"]

    @F.pandas_udf(", ".join(f"{f} long" for f in fields))
    def count(pairs: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for units in pairs:
            own = []
            for k, u in enumerate(needed):
                h, r = units[k], units[len(needed) + k]
                n = [n for v, n in orders.values() if v == u]
                if u == "chars":
                    got = [char_counts(h[p].tolist(), r[p].tolist(), n) for p in _portions(h, r)]
                    got = np.concatenate(got) if got else np.zeros((0, 3 * len(n)), np.int64)
                else:
                    got = np.array([[c for m in n for c in counts(a, b, m)] for a, b in zip(map(list, h), map(list, r), strict=True)], np.int64).reshape(len(h), 3 * len(n))
                own.append(pd.DataFrame(got, columns=[f"{s}_{o}" for o, (v, _) in orders.items() if v == u for s in "mhr"]))
            yield pd.concat(own, axis=1)[fields]

    return rows.withColumn(name, count(*[_UNITS[u](text(F.col(c))) for c in (hypothesis, reference) for u in needed]))


def statistics(pairs: DataFrame, keys: list[str], hypothesis: str, reference: str, orders: dict) -> DataFrame:
    """keys, and for each order ``m_``, ``h_``, ``r_`` of the row's pair. Dealt in a fixed number of parts: the work is far larger than the texts."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = pairs.select(*keys, hypothesis, reference).repartition(parts)
    return counted(own, hypothesis, reference, orders, "__n").select(*keys, "__n.*")


def add_up(stats: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Statistics of the corpora that ``by`` names."""
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in stats.columns if c not in (*keys, *by)])


def bleu(sentence: bool, at: str = "") -> Column:
    """From statistics, columns or fields ``at`` a struct; sentences go by the orders they have, zero counts are smoothed by halves."""
    n = list(BLEU_ORDERS)
    zeros, logs, order, alive = F.lit(0), F.lit(0.0), F.lit(0), F.lit(True)
    for k in n:
        m, h = F.col(f"{at}m_{k}"), F.col(f"{at}h_{k}")
        alive = alive & (h > 0)
        zeros = zeros + F.when(alive & (m == 0), 1).otherwise(0)
        p = F.when(m == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * h)).otherwise(m / h)
        logs = logs + F.when(alive, F.log(p * 100)).otherwise(0.0)
        order = order + F.when(alive, 1).otherwise(0)
    hyp, ref = F.col(f"{at}h_w1"), F.col(f"{at}r_w1")
    brevity = F.when(hyp >= ref, 1.0).when(hyp > 0, F.exp(1 - ref / hyp)).otherwise(0.0)
    some = F.greatest(*[F.col(f"{at}m_{k}") for k in n]) > 0
    whole = some if sentence else some & (order == len(n))
    return F.when(whole, brevity * F.exp(logs / order)).otherwise(0.0)


def chrf(beta: float = 2.0, at: str = "") -> Column:
    p, r, order = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k in CHRF_ORDERS:
        m, h, q = F.col(f"{at}m_{k}"), F.col(f"{at}h_{k}"), F.col(f"{at}r_{k}")
        both = (h > 0) & (q > 0)
        p, r, order = p + F.when(both, m / h).otherwise(0.0), r + F.when(both, m / q).otherwise(0.0), order + F.when(both, 1).otherwise(0)
    p, r = p / order, r / order
    return F.when((order > 0) & (p + r > 0), 100 * (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
