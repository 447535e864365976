"""Sharding: best-fit-decreasing packing of indivisible groups, law ``bytes`` (sizes near equal).

Rows of equal text are a group. Sorted by falling size, a group enters the open bin whose remaining
capacity is the tightest that holds it; a balanced tree (treap) over remaining capacities finds it.

Packing runs on two levels, so that neither a task nor the driver meets all groups. Each task packs
its share of the groups into blocks of fixed capacity, best fit decreasing; the driver then packs
the blocks, whose number is bounded by total size / block size plus the number of tasks, into
shards of fixed capacity the same way. Blocks that no shard has room for go to the emptiest one.

A group larger than a block (or of more than ``max_rows`` rows) skips the first level: its rows are dealt by a hash into pieces of about
a block, so that no task holds it whole, and its pieces move as one item of the second level. Only
a group above the capacity of a shard is divided, into as few items as hold it, since no law of
equal sizes could hold with a third of all rows in one group.

Defined cases: a null text has 16 bytes, checksum 0, and is grouped with empty texts; repeated rows
are placed each; equal sizes pack in the order of their text's digest; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

OVERHEAD = 16
_PACKED = "block long, doc_id long, size long, text_crc32 long, slot_in_block long"


class Capacities:
    """A treap of (remaining capacity, bin): insert, and take the least that is at least a need."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._random = random.Random(1)

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, capacity: int, name: int) -> None:
        low, high = self._split(self._root, (capacity, name))
        self._root = self._merge(self._merge(low, [(capacity, name), self._random.random(), None, None]), high)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the tightest (capacity, bin) with capacity >= need."""
        low, high = self._split(self._root, (need, -1))
        if high is None:
            self._root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(low, high)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each size, given in falling order. A size above the capacity gets a bin of its own.

    With ``bins``, no more are opened: what fits in none goes to the bin with the least in it.
    """
    tree, out, opened, load = Capacities(), [], 0, []
    for size in sizes:
        got = tree.take(size)
        if got is not None:
            left, name = got
        elif bins is None or opened < bins:
            left, name = max(capacity, size), opened
            opened += 1
            load.append(0)
        else:
            name = min(range(bins), key=lambda b: (load[b], b))
            out.append(name)
            load[name] += size
            continue
        out.append(name)
        load[name] += size
        if left > size:
            tree.insert(left - size, name)
    return out


def _level(sizes: list[int], bins: int) -> list[int]:
    """Best fit decreasing into ``bins`` bins that share the total evenly; overflow goes to the emptiest."""
    return best_fit_decreasing(sizes, max(1, -(-sum(sizes) // bins)), bins)


def _pack_partition(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    tree, opened = Capacities(), 0
    filled: dict[int, int] = {}
    for batch in batches:
        cols: list[list[int]] = [[], [], [], [], []]
        for r in batch.to_pylist():
            if r["fixed"] is not None:
                name = r["fixed"]
            else:
                got = tree.take(r["bytes"])
                left, bin_ = got or (max(capacity, r["bytes"]), opened)
                opened += got is None
                if left > r["bytes"]:
                    tree.insert(left - r["bytes"], bin_)
                name = part + bin_
            start = filled.get(name, 0)
            filled[name] = start + len(r["rows"])
            for k, x in enumerate(r["rows"]):
                for c, v in zip(cols, (name, x["doc_id"], x["size"], x["text_crc32"], start + k), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["block", "doc_id", "size", "text_crc32", "slot_in_block"])


def _items(blocks: list[tuple[int, int, int]], group_of: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(bytes, blocks) in falling order of bytes: a block, or the pieces of a large group as far as a shard holds them."""
    out, grouped = [], {}
    for b in sorted(blocks):
        if b[0] in group_of:
            grouped.setdefault(group_of[b[0]], []).append(b)
        else:
            out.append((b[1], [b]))
    for members in grouped.values():
        item, size = [], 0
        for b in members:
            if item and size + b[1] > capacity:
                out.append((size, item))
                item, size = [], 0
            item.append(b)
            size += b[1]
        out.append((size, item))
    return sorted(out, key=lambda x: (-x[0], x[1][0]))


def shard_documents(docs: DataFrame, n_shards: int = 40, blocks_per_shard: int = 128, max_block_bytes: int = 256 << 20, max_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in each shard), grown_shard (null: the law isn't ``key``)."""
    spark = docs.sparkSession
    data = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(data, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(data, "UTF-8"), 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    base = staged(base, "shard-rows")
    total = base.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(total // (n_shards * blocks_per_shard), max_block_bytes))
    # At most total / block groups are larger than a block, and rows / max_rows longer: few enough for the driver and for a broadcast.
    large = base.groupBy("key").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).where(((F.col("t") > block) & (F.col("n") > 1)) | (F.col("n") > max_rows))
    pieces, before, group_of = [], 1, {}
    for r in sorted(large.collect(), key=lambda r: bytes(r["key"])):
        n = max(-(-r["t"] // block), -(-r["n"] // max_rows))
        pieces.append((bytes(r["key"]), n, before))
        group_of |= dict.fromkeys(range(-before - n + 1, -before + 1), before)
        before += n
    known = spark.createDataFrame(pieces, "key binary, pieces long, before long")
    salted = base.join(F.broadcast(known), "key", "left").withColumn("fixed", -F.col("before") - F.pmod(F.xxhash64("row"), F.col("pieces")))
    units = salted.groupBy("key", "fixed").agg(F.sum("size").alias("bytes"), F.array_sort(F.collect_list(F.struct("doc_id", "size", "text_crc32"))).alias("rows"))
    units = units.sortWithinPartitions(F.desc("bytes"), "key", "fixed").select("bytes", "fixed", "rows")
    packed = staged(map_batches(units, lambda it: _pack_partition(it, block), _PACKED), "shard-blocks")
    blocks = packed.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    items = _items([(b["block"], b["bytes"], b["n"]) for b in blocks], group_of, -(-total // n_shards))
    used, placed = [0] * n_shards, []
    for (_, members), shard in zip(items, _level([i[0] for i in items], n_shards), strict=True):
        for name, _, n in members:
            placed.append((name, shard, used[shard]))
            used[shard] += n
    places = spark.createDataFrame(placed, "block long, shard int, before long")
    out = packed.join(F.broadcast(places), "block")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("slot_in_block")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
