"""Line dedup: overlapping windows of three lines.

The text is cut at ``\\n``. Each three consecutive lines are hashed (two 64-bit lanes), windows that
occur more than once anywhere are found by a partial aggregation, and every occurrence but the first
is removed: the positions that the later windows cover are merged per document and those lines go.

The first occurrence is the least (doc_id, text hash, line), null doc_ids first. Rows of equal
doc_id and text are one document and keep the same lines. Null texts stay null; texts of fewer than
three lines stay as they are; a text that loses all lines becomes empty and its row stays. Empty
tables give no rows. Other columns pass unchanged, whatever their names.

Two shuffles of fixed-width window rows; a window that a third of all documents share is aggregated
on the map side and joined by an equi-join that the adaptive planner can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inner_name, packed

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """d, th, pos (0-based line), a, b: two hash lanes per window."""
    lanes = docs.select(
        F.col("doc_id").alias("d"),
        F.xxhash64("text").alias("th"),
        F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("x"),
        F.transform(_lines(F.col("text")), lambda x: F.xxhash64(F.lit(7), x)).alias("y"),
    ).where(F.size("x") >= WIDTH)
    at = [F.element_at("x", F.col("i") + k) for k in range(1, WIDTH + 1)]
    bt = [F.element_at("y", F.col("i") + k) for k in range(1, WIDTH + 1)]
    each = lanes.select("*", F.explode(F.sequence(F.lit(0), F.size("x") - WIDTH)).alias("i"))
    return each.select("d", "th", F.col("i").alias("pos"), F.xxhash64(*at).alias("a"), F.xxhash64(*bt).alias("b"))


def later_windows(docs: DataFrame) -> DataFrame:
    """d, th, starts: per document the sorted first lines of windows that occur earlier elsewhere."""
    w = windows(docs)
    place = F.struct("d", "th", "pos")
    first = w.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = w.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _deduped(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs`` but text), text, new (the kept lines), n_lines, n_removed (0 for null texts)."""
    found = later_windows(docs)
    own = docs.select(packed(docs, "text"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("own"))
    both = own.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("th")), "left")
    lines, starts, m = F.col("lines"), F.col("starts"), F.size("starts")
    both = both.withColumn("lines", _lines(F.col("text")))
    gaps = F.transform(
        F.sequence(F.lit(0), m),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + WIDTH).alias("s"),
            F.when(i == m, F.size(lines)).otherwise(F.get(starts, i)).alias("e"),
        ),
    )
    gaps = F.filter(gaps, lambda g: g["e"] > g["s"])
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"] + 1, g["e"] - g["s"])))
    both = both.withColumn("kept", F.when(starts.isNull(), lines).otherwise(kept))
    size = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    new = F.when(starts.isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return both.select("row", new.alias("new"), size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_removed"))


def _with_text(docs: DataFrame, new: Column, length: bool) -> list[Column]:
    """The columns of ``docs`` with ``new`` as text (and its length as n_chars)."""
    out = []
    for c in docs.columns:
        n_chars = F.length(new).cast(docs.schema["n_chars"].dataType).alias(c) if length and c == "n_chars" else None
        out.append(new.alias(c) if c == "text" else n_chars if n_chars is not None else F.col(f"row.`{c}`"))
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the kept lines, and __n_lines, __n_removed (0 for null texts); one more underscore where ``docs`` has such a name."""
    more = [F.col(c).alias(inner_name(docs, f"__{c}")) for c in ("n_lines", "n_removed")]
    return _deduped(docs).select(*_with_text(docs, F.col("new"), False), *more)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the kept lines as text (and n_chars, if there is one, as its length)."""
    return _deduped(docs).select(*_with_text(docs, F.col("new"), True))
