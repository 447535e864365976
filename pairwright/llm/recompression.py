"""Substring dedup by recompression: repeats of ``window`` words, all but the first occurrence removed.

Each round renames the sequence of symbols of every document (at first its words): in a run round every
maximal run of one symbol becomes a symbol, in a pair round symbols are dealt to a left and a right half
by a bit of their name and every left-right pair becomes a symbol. A name is a hash of what it stands
for, so a round names alike everywhere and equal substrings get equal symbols inside, whatever stands
around them. With each symbol goes the stretch of words that decided it; where that stretch lies within a
window, every other occurrence of the window holds the same symbol at the same place.

1. Names of the high round are counted over all documents. A window that holds no symbol of that round with its
   stretch goes by a lower round, in the end by its words. A symbol that occurs once in the world is
   told to its document, and no window that holds it can repeat; the others are candidates.
2. Candidate windows are verified by a 128-bit name of their words: the least (doc_id, text hash, start)
   of each name is the first occurrence, the others are removed. Rows of equal text are compared as one:
   a copy of an earlier text loses all its words (if it has a window at all).

All shuffles are partial aggregations of fixed-width rows, which a name that a third of the corpus
shares doesn't skew, and collections per document, which its length bounds. Tables by document are sent to all tasks
up to ``MAX_SENT_BYTES`` and joined by a shuffle beyond.

Words are runs of ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null and empty texts have no words;
texts shorter than a window stay; null doc_ids come first; rows of equal doc_id and text are one document and
keep the same words, equal doc_ids with other texts are ordered by a hash of the text; other columns pass, whatever their names;
an empty table gives no rows. Words of one text are at most 2**30, which a string's limit of 2 GB ensures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import drop_staged, inner_name, map_batches, packed, staged, unpacked
from .neardup import mix
from .words import portions, word_names

#: r: runs, p: pairs.
ROUNDS = "rpppp"
#: What windows go by, the first that a window holds: symbols after so many rounds whose names end in so many 0 bits.
LEVELS = ((5, 0), (3, 0), (1, 0), (0, 0))
MAX_SENT_BYTES = 24 << 20
#: Text that a task holds as symbols at once, unless one document is longer: about 100 bytes of arrays for each of text.
SLICE_BYTES = 1 << 20
_U = np.uint64
_P1, _P2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_words = re.compile(r"[^ \t-\r]+").findall


def _salt(k: int) -> np.uint64:
    return _U((k + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))


class Symbols:
    """A sequence of symbols: name (0: the edge of a document), first and end word, bounds of the stretch that decided it."""

    def __init__(self, name: np.ndarray, s: np.ndarray, e: np.ndarray, ds: np.ndarray, de: np.ndarray) -> None:
        self.name, self.s, self.e, self.ds, self.de = name, s, e, ds, de

    def runs(self) -> Symbols:
        name = self.name
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (name[1:] == 0)]))
        last = np.concatenate([first[1:], [len(name)]]) - 1
        k = last - first + 1
        new = name[first]
        many = np.flatnonzero(k > 1)
        new[many] = mix(new[many] * _P1 + k[many].astype(_U) * _P2)
        # A run ends where its neighbours differ, which their stretches say.
        ds = np.minimum(np.minimum.reduceat(self.ds, first), self.ds[np.maximum(first - 1, 0)])
        de = np.maximum(np.maximum.reduceat(self.de, first), self.de[np.minimum(last + 1, len(name) - 1)])
        return self._edges(Symbols(new, self.s[first], self.e[last], ds, de))

    def pairs(self, salt: int) -> Symbols:
        name = self.name
        bit = (mix(name + _salt(salt)) >> _U(17)) & _U(1)
        left, right = (bit == 0) & (name != 0), (bit == 1) & (name != 0)
        joined = np.concatenate([left[:-1] & right[1:], [False]])
        keep = np.concatenate([[True], ~joined[:-1]])
        # A left symbol looks at what follows it, a right one at what comes before: on one side alone.
        de_next, ds_prev = np.concatenate([self.de[1:], self.de[-1:]]), np.concatenate([self.ds[:1], self.ds[:-1]])
        de, ds = np.where(left, np.maximum(self.de, de_next), self.de), np.where(right, np.minimum(self.ds, ds_prev), self.ds)
        at = np.flatnonzero(joined)
        new, e = name.copy(), self.e.copy()
        new[at] = mix(mix(name[at] + _P2) * _P1 + name[at + 1])
        e[at] = self.e[at + 1]
        ds[at], de[at] = np.minimum(self.ds[at], self.ds[at + 1]), np.maximum(self.de[at], self.de[at + 1])
        return self._edges(Symbols(new[keep], self.s[keep], e[keep], ds[keep], de[keep]))

    @staticmethod
    def _edges(out: Symbols) -> Symbols:
        z = np.flatnonzero(out.name == 0)
        out.ds[z], out.de[z] = out.s[z], out.e[z]
        return out


def parse(texts: pa.Array) -> tuple[dict[int, Symbols], np.ndarray, np.ndarray, np.ndarray]:
    """(symbols after the rounds of LEVELS, word names with a 0 around each text, place of each text's first word, words per text)."""
    h, _, counts = word_names(texts)
    h[h == 0] = _U(1)
    doc = np.repeat(np.arange(len(texts)), counts)
    seq = np.zeros(len(h) + len(texts) + 1, _U)
    seq[np.arange(len(h)) + doc + 1] = h
    at = np.arange(len(seq), dtype=np.int32)
    now = Symbols(seq, at, at + 1, at.copy(), at + 1)
    out = {0: now}
    wanted = {level for level, _ in LEVELS}
    for k, kind in enumerate(ROUNDS[: max(wanted)], 1):
        now = now.runs() if kind == "r" else now.pairs(k)
        if k in wanted:
            out[k] = now
    return out, seq, np.cumsum(counts) - counts + np.arange(len(texts)) + 1, counts


def _whole(seq: np.ndarray, window: int) -> np.ndarray:
    """Which places start a window of one text."""
    zeros = np.concatenate([[0], np.cumsum(seq == 0)])
    out = np.zeros(len(seq), bool)
    if len(seq) >= window:
        out[: len(seq) - window + 1] = zeros[window:] == zeros[: len(seq) - window + 1]
    return out


def anchors(texts: pa.Array, window: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """([text, level index, place in text, name, stretch before, stretch behind] of the symbols that windows go by, first places, words per text)."""
    levels, seq, first, counts = parse(texts)
    open_ = _whole(seq, window)
    found = []
    for k, (level, bits) in enumerate(LEVELS):
        s = levels[level]
        own = mix(s.name + _salt(2 * level + 3))
        low, high = s.de - window, s.ds  # the windows that hold it with its stretch
        upto = np.concatenate([[0], np.cumsum(open_)])
        ok = np.flatnonzero((s.name != 0) & (low <= high) & (own & _U((1 << bits) - 1) == 0))
        lo, hi = np.maximum(low[ok], 0), np.minimum(high[ok], len(seq) - 1)
        ok = ok[upto[hi + 1] > upto[lo]]
        lo, hi = np.maximum(low[ok], 0), np.minimum(high[ok], len(seq) - 1)
        doc = np.searchsorted(first, s.s[ok], side="right") - 1
        found.append([doc, np.full(len(ok), k), s.s[ok] - first[doc], mix(own[ok] + _salt(k)), s.s[ok] - s.ds[ok], s.de[ok] - s.s[ok]])
        delta = np.zeros(len(seq) + 1, np.int64)
        np.add.at(delta, lo, 1)
        np.add.at(delta, hi + 1, -1)
        open_ &= np.cumsum(delta[:-1]) == 0
        if not open_.any():
            break
    cols = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols], first, counts


_ANCHORED = "d long, t int, n_words long, names array<long>, codes array<long>, stretch binary"


def _anchor_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in portions(batch.column("text"), SLICE_BYTES):
            texts = batch.column("text").slice(start, end - start)
            (doc, level, at, name, before, behind), _, counts = anchors(texts, window)
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            code = (at.astype(np.int64) << 2) | level
            reach = np.stack([before, behind], 1).astype(np.uint16)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))
            binary = [reach[a:b].tobytes() for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            own = [batch.column(c).slice(start, len(texts)) for c in ("d", "t")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), lists(name.view(np.int64)), lists(code), pa.array(binary, pa.binary())], names=["d", "t", "n_words", "names", "codes", "stretch"])


def _candidate_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of candidate windows (start, end, ...) of each document, from its anchors and those of them that are unique."""
    for batch in batches:
        runs = []
        for n, codes, stretch, unique in zip(batch.column("n_words").to_pylist(), batch.column("codes"), batch.column("stretch"), batch.column("unique"), strict=True):
            code = codes.values.to_numpy()
            reach = np.frombuffer(stretch.as_buffer(), np.uint16).reshape(-1, 2).astype(np.int64)
            level, at = code & 3, code >> 2
            size = n - window + 1
            lo, hi = np.maximum(at + reach[:, 1] - window, 0), np.minimum(at - reach[:, 0], size - 1)
            alone = np.isin(code, unique.values.to_numpy()) if unique.is_valid else np.zeros(len(code), bool)
            out, open_ = np.zeros(size, bool), np.ones(size, bool)
            for k in range(len(LEVELS)):
                own = level == k
                every, lone = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
                for to, which in ((every, own), (lone, own & alone)):
                    to += np.bincount(lo[which], minlength=size + 1) - np.bincount(hi[which] + 1, minlength=size + 1)
                held = (np.cumsum(every)[:-1] > 0) & open_
                out |= held & (np.cumsum(lone)[:-1] == 0)
                open_ &= ~held
                if not open_.any():
                    break
            runs.append(np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))).tolist())
        some = [k for k, r in enumerate(runs) if r]
        own = [batch.column(c).take(pa.array(some, pa.int64())) for c in ("d", "t")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([runs[k] for k in some], pa.list_(pa.int32()))], names=["d", "t", "runs"])


def _spread(runs: np.ndarray) -> np.ndarray:
    """The numbers in runs (start, end, ...)."""
    s, e = runs[::2].astype(np.int64), runs[1::2].astype(np.int64)
    ends = np.cumsum(e - s)
    return np.repeat(s - (ends - (e - s)), e - s) + np.arange(int(ends[-1]) if len(ends) else 0)


def _window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """128-bit name and place (rank of the document, start) of each candidate window."""
    for batch in batches:
        for start, end in portions(batch.column("text"), SLICE_BYTES):
            texts = batch.column("text").slice(start, end - start)
            h, h2, counts = word_names(texts)
            base = np.cumsum(counts) - counts
            at, place = [], []
            for k, (rank, runs) in enumerate(zip(batch.column("rank").slice(start, len(texts)).to_pylist(), batch.column("runs").slice(start, len(texts)), strict=True)):
                pos = _spread(runs.values.to_numpy())
                at.append(pos + base[k])
                place.append((rank << 30) | pos)
            at, place = np.concatenate(at), np.concatenate(place)
            a, b = np.zeros(len(at), _U), np.zeros(len(at), _U)
            for k in range(window):
                a, b = (a * _P1 + h[at + k]) ^ (a >> _U(31)), (b * _P2 + h2[at + k]) ^ (b >> _U(29))
            for i in range(0, len(at), 1 << 18):
                cut = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(mix(a[cut]).view(np.int64)), pa.array(mix(b[cut]).view(np.int64)), pa.array(place[cut])], names=["a", "b", "place"])


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Words (start, end, ...) that windows cover which aren't first occurrences."""
    for batch in batches:
        cuts = []
        for runs, firsts in zip(batch.column("runs"), batch.column("firsts"), strict=True):
            pos = _spread(runs.values.to_numpy())
            if firsts.is_valid:
                pos = pos[~np.isin(pos, firsts.values.to_numpy())]
            gap = np.flatnonzero(np.diff(pos) > window) if len(pos) else pos
            starts, ends = pos[np.concatenate([[0], gap + 1])] if len(pos) else pos, pos[np.concatenate([gap, [-1]])] + window if len(pos) else pos
            cuts.append(np.stack([starts, ends], 1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.array(cuts, pa.list_(pa.int32()))], names=["d", "t", "cuts"])


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t (tells texts of one doc_id apart), text."""
    return docs.select(F.col("doc_id").alias("d"), _text_bits().alias("t"), "text")


def _text_bits() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit((1 << 29) - 1)).cast("int")


def _by_document(docs: DataFrame, table: DataFrame, values: str | None, how: str) -> DataFrame:
    """``docs`` (d, t, ...) joined with a staged table by document: sent to all tasks if its size is small enough."""
    size = F.sum(F.lit(48) + (F.size(values) * 4 if values else F.lit(0)))
    small = (table.agg(size).first()[0] or 0) <= MAX_SENT_BYTES
    other = table.withColumnsRenamed({"d": "__d", "t": "__t"})
    other = F.broadcast(other) if small else other
    return docs.join(other, docs["d"].eqNullSafe(other["__d"]) & (docs["t"] == other["__t"]), how).drop("__d", "__t")


def _key() -> Column:
    return F.unhex(F.sha2("text", 256))


def copies(docs: DataFrame) -> DataFrame:
    """key, least, has_null: texts that several rows hold, by SHA-256, and the first doc_id of each (null before all); staged."""
    text = docs.where("text is not null").select(_key().alias("key"), "doc_id")
    groups = text.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    return staged(groups.where("n > 1").select("key", "least", "has_null"), "copies")


def _flagged(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, text, copy (whether an earlier doc_id has the same text) and row (all columns of ``docs`` but text)."""
    groups = F.broadcast(groups) if groups.count() * 64 <= MAX_SENT_BYTES else groups
    own = docs.select(packed(docs, "text"), "doc_id", "text", _key().alias("key")).join(groups, "key", "left")
    later = F.when(F.col("has_null"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col("least"))
    return own.select("row", "doc_id", "text", F.coalesce(later, F.lit(False)).alias("copy"))


def _ranked(found: DataFrame) -> DataFrame:
    """``found`` (d, t, runs; staged) with rank: its place in the order of (d, t)."""
    spark = found.sparkSession
    order = staged(found.orderBy("d", "t").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "repeat-order")
    each = order.groupBy("part").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per task
    before, total = [], 0
    for r in each:
        before.append((r["part"], total - r["low"]))
        total += r["n"]
    shift = spark.createDataFrame(before, "part int, shift long")
    return staged(order.join(F.broadcast(shift), "part").select("d", "t", "runs", (F.col("row") + F.col("shift")).alias("rank")), "repeat-candidates")


def repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """d, t, cuts (words start, end, ...): what goes from texts that aren't copies of earlier ones; staged. ``docs``: doc_id, text, copy."""
    own = _keyed(docs.where(~F.col("copy")))
    each = staged(map_batches(own, lambda it: _anchor_batches(it, window), _ANCHORED), "symbols").where(F.col("n_words") >= window)
    rows = each.select("d", "t", F.explode(F.arrays_zip("names", "codes")).alias("x"))
    rows = rows.select("x.names", "d", (F.shiftleft(F.col("t").cast("long"), 34) + F.col("x.codes")).alias("code"))
    # Of a name that occurs once, the least doc_id and code are those of its one occurrence.
    once = rows.groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.min("code").alias("code")).where("n = 1")
    once = once.select("d", F.shiftright("code", 34).cast("int").alias("t"), F.col("code").bitwiseAND(F.lit((1 << 34) - 1)).alias("code"))
    unique = once.groupBy(F.col("d").alias("u"), F.col("t").alias("v")).agg(F.collect_list("code").alias("unique"))
    known = each.select("d", "t", "n_words", "codes", "stretch").join(unique, F.col("d").eqNullSafe(F.col("u")) & (F.col("t") == F.col("v")), "left")
    known = known.select("n_words", "codes", "stretch", "unique", "d", "t")
    found = staged(map_batches(known, lambda it: _candidate_batches(it, window), "d long, t int, runs array<int>").dropDuplicates(["d", "t"]), "repeat-runs")
    drop_staged(each)
    found = _ranked(found)
    texts = _by_document(own, found, "runs", "inner").select("text", "rank", "runs")
    windows = map_batches(texts, lambda it: _window_batches(it, window), "a long, b long, place long")
    first = windows.groupBy("a", "b").agg(F.min("place").alias("place"))
    first = first.groupBy(F.shiftright("place", 30).alias("rank")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 30) - 1))).alias("firsts"))
    cuts = map_batches(found.join(first, "rank", "left").select("d", "t", "runs", "firsts"), lambda it: _cut_batches(it, window), "d long, t int, cuts array<int>")
    return staged(cuts.where(F.size("cuts") > 0), "repeat-cuts")


def _keep_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in portions(batch.column("text"), SLICE_BYTES):
            part = batch.slice(start, end - start)
            n, gone, kept = [], [], []
            for text, copy, cuts in zip(part.column("text").to_pylist(), part.column("copy").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                words = _words(text or "")
                total = len(words)
                if copy and total >= window:
                    words = []
                elif cuts:
                    bounds = [0, *cuts, total]
                    words = [w for a, b in zip(bounds[::2], bounds[1::2], strict=True) for w in words[a:b]]
                n.append(total)
                gone.append(total - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "text", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs``, all columns, with __n_words, __n_removed and __kept (the words that stay, joined by a space); one more underscore where ``docs`` has such a name."""
    groups = copies(docs.select("doc_id", "text"))
    cuts = repeated_words(_flagged(docs.select("doc_id", "text"), groups), window)
    own = _flagged(docs, groups).withColumns({"d": F.col("doc_id"), "t": _text_bits()})
    both = _by_document(own, cuts, "cuts", "left").select("row", "text", "copy", "cuts")
    schema = StructType([both.schema["row"], both.schema["text"], *(StructField(k, v) for k, v in (("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType())))])
    out = map_batches(both, lambda it: _keep_batches(it, window), schema)
    return out.select(*unpacked(docs, "text"), *[F.col(c).alias(inner_name(docs, f"__{c}")) for c in ("n_words", "n_removed", "kept")])
