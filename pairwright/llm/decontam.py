"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a run of documents of bounded size) becomes a sequence of word ids, 0 for words that no
benchmark item has. A suffix array over the positions from which a match can start is built by prefix
doubling; every suffix of every item is binary-searched in it, all at once. The neighbours of its
place give its longest verbatim match and where it lies; the range of equal prefixes gives every
occurrence of its window. Documents hold the items whose windows occur in them, and leave the
training set once they hold enough.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window.

Items are read by the driver in blocks of at most ``MAX_BLOCK_BYTES`` of text, each sent to all tasks;
a larger benchmark is more blocks, one pass each, and no result depends on the number of blocks.
Training text isn't shuffled.

Defined cases: null texts have no words; null item_ids count as the item "null", equal item_ids as
one item; repeated documents are judged each; a window never crosses documents; empty tables give no
rows, an empty benchmark no hits; other columns pass, whatever their names. Words are compared as they are, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, packed, unpacked
from .words import LETTERS, portions, split

MAX_BLOCK_BYTES = 32 << 20
#: Text of a shard, unless one document is longer: about 60 bytes of arrays for each of text.
SHARD_BYTES = 2 << 20
class Benchmark:
    """Word ids, suffixes and windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.names = sorted({name for name, _ in items})
        index = {n: k for k, n in enumerate(self.names)}
        distinct, codes, counts = split(pa.array([t for _, t in items], pa.string()), LETTERS)
        self.vocabulary = {w: k for k, w in enumerate(sorted(distinct), 1)}
        ids = self.ids(distinct)[codes]
        owner = np.repeat(np.arange(len(items)), counts)
        # A zero after each item and at the end, so that no comparison runs on.
        self.longest = int(counts.max()) if len(counts) else 0
        at = np.arange(len(ids)) + owner
        self.seq = np.zeros(len(ids) + len(items) + self.longest + 2, np.int64)
        self.seq[at] = ids
        ends = np.cumsum(counts) + np.arange(len(items))
        self.left = ends[owner] - at  # words from a suffix's start to the item's end
        self.starts, self.start_of_item = at, (np.cumsum(counts) - counts + np.arange(len(items)))
        self.item = np.array([index[n] for n, _ in items], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        self.size = np.minimum(window, counts)[owner] if len(owner) else np.zeros(0, np.int64)
        self.is_window = self.left >= self.size
        self.least = int(self.size.min()) if len(self.size) else 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)


class Shard:
    """The suffix array of a run of documents."""

    def __init__(self, texts: pa.Array, bench: Benchmark) -> None:
        self.bench = bench
        distinct, codes, self.counts = split(texts, LETTERS)
        h = bench.ids(distinct)[codes]
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        place = np.arange(len(h)) + self.doc
        self.first = np.cumsum(self.counts) - self.counts + np.arange(len(texts))
        self.seq = np.zeros(len(h) + len(texts) + bench.longest + 2, np.int64)
        self.seq[place] = h
        self.doc_at = np.zeros(len(self.seq), np.int64)
        self.doc_at[place] = self.doc
        # A match has ``least`` words at least: shorter runs of known words can't hold one.
        known = self.seq > 0
        stop = np.flatnonzero(~known)
        here = np.flatnonzero(known)
        after = np.searchsorted(stop, here)
        left = stop[after] - here
        whole = stop[after] - np.where(after > 0, stop[np.maximum(after - 1, 0)], -1) - 1
        self.sa = self._sort(here[left >= bench.least], here[whole >= bench.least])

    def _sort(self, here: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Prefix doubling up to the longest item: ranks of the first 2, 4, 8, ... words. ``active``: ``here`` and the ends of its runs."""
        rank = self.seq.copy()
        depth = 1
        while depth < self.bench.longest and active.size:
            nxt = np.minimum(active + depth, len(rank) - 1)
            key = rank[active] * (int(rank.max()) + 1) + rank[nxt]
            o = np.argsort(key, kind="stable")
            k = key[o]
            new = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
            rank[active[o]] = new
            depth *= 2
            if new[-1] == len(active):
                break
        return here[np.argsort(rank[here], kind="stable")]

    def _compare(self, at: np.ndarray, test: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(-1, 0, 1 as the training suffix is below, equal to or above the test suffix in ``depth`` words; common words)."""
        out, lcp = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
        live, k = np.flatnonzero(depth > 0), 0
        while live.size:
            a, b = self.seq[at[live] + k], self.bench.seq[test[live] + k]
            out[live] = np.sign(a - b)
            live = live[a == b]
            k += 1
            lcp[live] = k
            live = live[depth[live] > k]
        return out, lcp

    def _bound(self, test: np.ndarray, depth: np.ndarray, upper: bool) -> np.ndarray:
        low, high = np.zeros(len(test), np.int64), np.full(len(test), len(self.sa))
        while True:
            live = np.flatnonzero(low < high)
            if not live.size:
                return low
            mid = (low[live] + high[live]) // 2
            c, _ = self._compare(self.sa[mid], test[live], depth[live])
            right = c < 0 if not upper else c <= 0
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Per test suffix: words of its longest verbatim match, and where in this shard (-1: none)."""
        b = self.bench
        size, where = np.zeros(len(b.starts), np.int64), np.full(len(b.starts), -1)
        if not len(self.sa):
            return size, where
        at = self._bound(b.starts, b.left, upper=False)
        for near in (at, at - 1):
            ok = np.flatnonzero((near >= 0) & (near < len(self.sa)))
            p = self.sa[near[ok]]
            _, lcp = self._compare(p, b.starts[ok], b.left[ok])
            up = lcp > size[ok]
            size[ok[up]], where[ok[up]] = lcp[up], p[up]
        return size, where

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, words, item) of every occurrence of every window; equal windows of an item once."""
        b = self.bench
        none = np.zeros(0, np.int64)
        if not len(self.sa):
            return none, none, none
        size, _ = self.longest()
        t = np.flatnonzero(b.is_window & (size >= b.size))
        if not t.size:
            return none, none, none
        low = self._bound(b.starts[t], b.size[t], upper=False)
        high = self._bound(b.starts[t], b.size[t], upper=True)
        keep = np.unique(np.stack([low, high, b.size[t], b.item[t]], 1), axis=0)
        low, high, words, item = keep.T
        n = high - low
        ends = np.cumsum(n)
        at = np.repeat(low - (ends - n), n) + np.arange(int(ends[-1]))
        return self.sa[at], np.repeat(words, n), np.repeat(item, n)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size: the driver never holds more than one."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text") + F.octet_length("name") + 16)).first()[0] or 0
    n = max(1, -(-2 * total // MAX_BLOCK_BYTES)) if total > MAX_BLOCK_BYTES else 1
    if n == 1:
        yield [(r["name"], r["text"]) for r in own.collect()]
        return
    own = own.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["name"], r["text"]) for r in own.where(F.col("block") == k).collect()]


def _mark(texts: pa.Array, bench: Benchmark, spans: list[list[int]], items: list[list[str]]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Words per text, and spans and items with those of this block added."""
    shard = Shard(texts, bench)
    place, words, item = shard.occurrences()
    doc = shard.doc_at[place]
    if place.size:
        pairs = np.unique(doc * len(bench.names) + item)
        for d, k in zip((pairs // len(bench.names)).tolist(), (pairs % len(bench.names)).tolist(), strict=True):
            items[d] = [*items[d], bench.names[k]]
        delta = np.zeros(len(shard.seq) + 1, np.int64)
        np.add.at(delta, place, 1)
        np.add.at(delta, place + words, -1)
        for d in np.unique(doc).tolist():
            a = shard.first[d]
            for s, e in zip(spans[d][::2], spans[d][1::2], strict=True):
                delta[a + s] += 1
                delta[a + e] -= 1
        cover = (np.cumsum(delta) > 0).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]])))
        found: dict[int, list[int]] = {}
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(shard.doc_at[s])
            found.setdefault(d, []).extend((s - int(shard.first[d]), e - int(shard.first[d])))
        for d, x in found.items():
            spans[d] = x
    return shard.counts, spans, items


def mark_documents(docs: DataFrame, benchmark: DataFrame, window: int = 8) -> DataFrame:
    """row (all columns of ``docs`` but text), text, n_words, spans (word bounds of what the benchmark covers: start, end, ...) and items (their names)."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(packed(docs, "text"), "text")
    own = own.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for items in _blocks(benchmark):
        sent = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value, window)
            for batch in batches:
                for start, end in portions(batch.column("text"), SHARD_BYTES):
                    part = batch.slice(start, end - start)
                    counts, spans, names = _mark(part.column("text"), bench, part.column("spans").to_pylist(), part.column("items").to_pylist())
                    new = [part.column("row"), part.column("text"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(new, names=["row", "text", "n_words", "spans", "items"])

        own = map_batches(own, run, own.schema)
    return own.select("row", "text", "n_words", "spans", F.array_distinct("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = mark_documents(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    n_items = F.size("items").cast("long")
    return m.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that hold fewer than ``min_items`` items."""
    return mark_documents(docs, benchmark, window).where(F.size("items") < min_items).select(*unpacked(docs, "text"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 8) -> DataFrame:
    """Per item and word of it: the longest verbatim match over all shards (item_id, item_word, n_words, doc_id, doc_word)."""
    sc = docs.sparkSession.sparkContext
    out = None
    for items in _blocks(benchmark):
        sent = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value, min_words)
            names = np.array(bench.names, object)
            order = np.searchsorted(bench.start_of_item, bench.starts, side="right") - 1
            word = bench.starts - bench.start_of_item[order] if len(bench.starts) else bench.starts
            for batch in batches:
                for start, end in portions(batch.column("text"), SHARD_BYTES):
                    shard = Shard(batch.column("text").slice(start, end - start), bench)
                    size, where = shard.longest()
                    k = np.flatnonzero(size >= min_words)
                    d = shard.doc_at[where[k]]
                    ids = batch.column("doc_id").slice(start, end - start).take(pa.array(d))
                    cols = [pa.array(names[bench.item[k]].tolist(), pa.string()), pa.array(word[k]), pa.array(size[k]), ids, pa.array(where[k] - shard.first[d])]
                    yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        part = map_batches(docs.select("doc_id", "text"), run, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
        out = part if out is None else out.unionByName(part)
    best = F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w"))
    top = out.groupBy("item_id", "item_word").agg(F.max(best).alias("b"))
    return top.select("item_id", "item_word", "b.n_words", (-F.col("b.d")).alias("doc_id"), (-F.col("b.w")).alias("doc_word"))
