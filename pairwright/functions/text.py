"""Text predicates and form diagnostics as Column expressions (no Python on executors).

White space is what Unicode calls so, plus the separators U+001C-U+001F; nulls count as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# Han ranges, and patterns that betray workflow talk in an output.
HAN = r"[㐀-䶿一-鿿豈-﫿]"
CONTAMINATION = [
    r"internal\s+(understanding|workflow)",
    r"understanding\s+workflow",
    r"\btranslation\s+planning\b",
    r"\bthought\s+and\s+emotion\b",
    r"\bmodernity\b.*\bpoeticity\b",
    r"^\s*#{1,6}\s+.*(content|expression|translation|workflow)",
    r"\bI'll\s+work\s+through\b",
    r"\bI\s+will\s+work\s+through\b",
    r"\bbefore\s+translat(?:ing|e)\b",
    r"\bfinal\s+english\s+poem\b",
]
#: What a text must hold for each of them: a search that is far cheaper than the pattern.
_NEEDED = ["internal", "understanding", "planning", "emotion", "poeticity", "#", "i'll", "through", "before", "poem"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    """Non-empty lines, stripped."""
    return F.filter(F.transform(F.split(text(c), LINE_BREAK), strip), lambda x: x != "")


def has_han(c: Column) -> Column:
    return text(c).rlike(HAN)


def english_ratio(c: Column) -> Column:
    latin, han = F.regexp_count(text(c), F.lit("[A-Za-z]")), F.regexp_count(text(c), F.lit(HAN))
    return F.when(latin + han > 0, latin / (latin + han)).otherwise(F.lit(0.0))


def line_count_difference(hypothesis: Column, reference: Column) -> Column:
    return F.abs(F.size(lines(hypothesis)) - F.size(lines(reference)))


def length_ratio(hypothesis: Column, reference: Column) -> Column:
    n = F.length(strip(reference))
    return F.when(n > 0, F.length(strip(hypothesis)) / n).otherwise(F.lit(0.0))


def empty_output(c: Column) -> Column:
    return (strip(c) == "").cast("int")


def count_words(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit("[A-Za-z']+"))


def contaminated(c: Column) -> Column:
    """Whether any workflow pattern occurs, in any case, ``^`` at every line."""
    low, out = F.lower(text(c)), F.lit(False)
    for p, needed in zip(CONTAMINATION, _NEEDED, strict=True):
        out = out | (low.contains(needed) & text(c).rlike(f"(?im){p}"))
    return out


def flag_list(c: Column) -> Column:
    """A JSON list or a bare string of flags as an array without empty entries."""
    raw = strip(c)
    listed = F.from_json(raw, "array<string>")
    return F.filter(F.transform(F.when(raw.startswith("["), listed).otherwise(F.array(raw)), strip), lambda x: x != "")


def eligible(pair: Column, source: Column, reference: Column) -> Column:
    """A zh-en record with Han in its source and a reference without."""
    return (pair == "zh-en") & (strip(source) != "") & (strip(reference) != "") & has_han(source) & ~has_han(reference)


def finite_or_null(c: Column) -> Column:
    """A number from anything; NaN and text are null."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def half_step(c: Column) -> Column:
    return F.abs(c * 2 - F.round(c * 2)) < 1e-9


def stable_seed(seed: int, key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``seed:key`` as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_rank_key(seed: int, *keys: Column) -> Column:
    """First 15 hex digits of a SHA-256, as a long: a portable random order."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256), 1, 15), 16, 10).cast("long")


def line_pairs(hypothesis: Column, reference: Column) -> Column:
    """Lines side by side, the shorter side filled with empty lines."""
    return F.transform(F.arrays_zip(lines(hypothesis).alias("h"), lines(reference).alias("r")), lambda x: F.struct(text(x["h"]).alias("h"), text(x["r"]).alias("r")))


def oriented_delta(metric: Column, delta: Column) -> Column:
    """Deltas in which more is better: error rates change sign."""
    return F.when(metric.startswith("ter"), -delta).otherwise(delta)


def redact(c: Column, secrets: list[str]) -> Column:
    out = text(c)
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    return out


def env_list(c: Column) -> Column:
    """Entries between commas or semicolons."""
    return F.filter(F.transform(F.split(F.replace(text(c), F.lit(";"), F.lit(",")), ","), strip), lambda x: x != "")


def endpoint(base: Column, suffix: str) -> Column:
    """A service address that ends in ``suffix`` once."""
    bare = F.regexp_replace(strip(base), "/+$", "")
    return F.when(bare.endswith(suffix), bare).otherwise(F.concat(bare, F.lit(suffix)))


def retryable(status: Column, body: Column) -> Column:
    """Whether to try again: not when the account is out of balance, else for busy and broken answers."""
    broke = F.lower(text(body)).rlike("insufficient|balance|quota|arrears")
    return ~broke & status.isin(408, 409, 425, 429, 500, 502, 503, 504)


def first_filled(*names: Column) -> Column:
    """The first of a column and its aliases that isn't empty; blanks count as filled."""
    return F.coalesce(*[F.when(text(c) != "", c) for c in names], F.lit(""))
