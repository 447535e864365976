"""Tail probabilities as column expressions, so that p-values stay in the plan; and the same as SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational Chebyshev approximations of the error function (1969), leading coefficient first.
ERF_P = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
ERF_Q = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
MID_P = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
MID_Q = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
FAR_P = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_Q = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _ratio(x: Column, p: list[float], q: list[float]) -> Column:
    top, low = (reduce(lambda a, c: a * x + c, k[1:], F.lit(k[0])) for k in (p, q))
    return top / low


def normal_p(z: Column) -> Column:
    """Two-sided tail of the standard normal."""
    x = F.abs(z) / math.sqrt(2)
    far = 1 / (x * x)
    tail = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - far * _ratio(far, FAR_P, FAR_Q))
    return F.when(x <= 0.46875, 1 - x * _ratio(x * x, ERF_P, ERF_Q)).when(x <= 4, F.exp(-x * x) * _ratio(x, MID_P, MID_Q)).otherwise(tail)


def normal_p_sql(z: str) -> str:
    def ratio(x: str, p: list[float], q: list[float]) -> str:
        top, low = (reduce(lambda a, c: f"({a} * {x} + {c!r}::DOUBLE)", k[1:], f"{k[0]!r}::DOUBLE") for k in (p, q))
        return f"{top} / {low}"

    x = f"(abs({z}) / {math.sqrt(2)!r}::DOUBLE)"
    far = f"(1 / ({x} * {x}))"
    return (
        f"CASE WHEN {x} <= 0.46875 THEN 1 - {x} * {ratio(f'({x} * {x})', ERF_P, ERF_Q)} WHEN {x} <= 4 THEN exp(-{x} * {x}) * {ratio(x, MID_P, MID_Q)} "
        f"WHEN {x} > 4 THEN exp(-{x} * {x}) / {x} * ({1 / math.sqrt(math.pi)!r}::DOUBLE - {far} * {ratio(far, FAR_P, FAR_Q)}) END"
    )


def signed_rank_p(w: Column, n: Column, ties: Column, zeros: Column) -> Column:
    """Two-sided p of the signed-rank statistic by its normal approximation, corrected for ties and, after Pratt, for zeros."""
    m = (n + zeros).cast("double")
    mean = m * (m + 1) / 4 - zeros * (zeros + 1) / 4
    var = m * (m + 1) * (2 * m + 1) / 24 - zeros * (zeros + 1) * (2 * zeros + 1) / 24 - ties / 48
    return F.when(var > 0, normal_p((w - mean) / F.sqrt(var))).otherwise(1.0)


def signed_rank_p_sql(w: str, n: str, ties: str, zeros: str) -> str:
    m = f"({n} + {zeros})::DOUBLE"
    mean = f"({m} * ({m} + 1) / 4 - {zeros} * ({zeros} + 1) / 4.0::DOUBLE)"
    var = f"({m} * ({m} + 1) * (2 * {m} + 1) / 24 - {zeros} * ({zeros} + 1) * (2 * {zeros} + 1) / 24.0::DOUBLE - {ties} / 48)"
    return f"CASE WHEN {var} > 0 THEN {normal_p_sql(f'(({w} - {mean}) / sqrt({var}))')} ELSE 1.0 END"


#: Terms of the sum for Student's t; with more degrees of freedom than twice as many the tail is that of a corrected normal.
MOST_TERMS = 5000


def t_p(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t of whole degrees of freedom: the finite sum in the angle atan(t / sqrt(df)).

    Terms follow one from the other, so a row costs df / 2 steps; beyond ``MOST_TERMS`` Wallace's normal approximation
    is right to all digits that are shown.
    """
    x, n = F.abs(t).cast("double"), df.cast("double")
    angle = F.atan(x / F.sqrt(n))
    cc = n / (n + x * x)
    odd = n % 2
    steps = F.least(F.floor((n - 2 - odd) / 2), F.lit(MOST_TERMS)).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, j: Column) -> Column:
        k = j.cast("double")
        term = a["term"] * cc * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")), first, step, lambda a: a["total"])
    even_p = 1 - F.sin(angle) * total
    odd_p = 1 - 2 / math.pi * (angle + F.when(n > 1, F.sin(angle) * F.cos(angle) * total).otherwise(0.0))
    many = normal_p((8 * n + 1) / (8 * n + 3) * F.sqrt(n * F.log1p(x * x / n)))
    return F.greatest(F.lit(0.0), F.when(n > 2 * MOST_TERMS, many).when(odd == 1, odd_p).otherwise(even_p))


def t_p_sql(t: str, df: str) -> str:
    """The same sum with its terms by gamma functions."""
    x, n = f"abs({t})", f"({df})::DOUBLE"
    angle, cc = f"atan({x} / sqrt({n}))", f"({n} / ({n} + {x} * {x}))"
    even = f"list_sum(list_transform(range(0, (({n} - 2) / 2 + 1)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - lgamma(0.5) + j * ln({cc}))))"
    odd = f"list_sum(list_transform(range(0, (({n} - 3) / 2 + 1)::BIGINT), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5) + lgamma(1.5) + j * ln({cc}))))"
    return f"greatest(0.0, CASE WHEN {n} % 2 = 0 THEN 1 - sin({angle}) * {even} WHEN {n} = 1 THEN 1 - 2 / pi() * {angle} ELSE 1 - 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END)"
