"""MinHash near-dedup with an LSH forest.

Documents are sets of word shingles. Rows of equal sets form a class, represented by its least
doc_id; the forest holds representatives alone. Each tree orders them by its own sequence of minhash
values: four that a region has in common, then four more. Rows of a region of at most ``NEAR + 1`` rows are compared
with all others of it. In a crowded region the depth adapts to each row: it is compared with those next to it in the order,
one of which has the longest prefix in common with it. Pairs whose one-bit sketches are close are candidates.

Candidates are confirmed on full shingle sets in rounds: first the best of each document, whose links
already join most components, then four times as many, until no candidate has its ends in two
components.

Deeper prefixes miss links that the four common values would hold, so crowded regions that
still have several components are completed exactly (``rest``): of the shingles of each of their rows the rarest fifth
and one (for a similarity of 0.8) are its keys, and two similar rows share a key, at a place that leaves
enough shingles behind it. Rows of different components that share such a key are candidates too. Keys that many
rows share are dealt to tasks as blocks: rows outside the key's largest component against all its rows. No result depends
on a size: ``PIECE`` deals work alone.

All of it is distributed: the orders are dealt by range over (prefix, deeper values, id), which splits
regions of any size; what lies across the edge of two ranges is compared too. Components come from
alternating large-star and small-star steps, or, for up to ``ONE_TASK`` links of a round, from a
union-find in one task. Nothing about all documents reaches the driver.

Defined cases: null or wordless texts have empty sets, are linked with nothing and are their own
component; a text of fewer words than a shingle is one shingle; repeated rows are a class; where doc_ids are
null or repeated, rows are numbered in their order (nulls last) and linked by number, so that each text takes
part; an empty table gives no rows; other columns pass, whatever their names.
A link of similarity 0.8 shares no region with a probability below 1e-7, and its sketches are too far apart
in less than one case of 10**7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, inner_name, map_batches, staged
from .words import LOWER, portions, word_names

TREES, DEPTH, NEAR, BITS = 32, 4, 16, 128
#: Values of 16 bits that order a region.
LANES = 4
#: Sketches of similarity 0.8 differ in 12.8 of 128 bits on average; more than this many, less than once in 10**7.
FAR = 34
ONE_TASK = 500_000
#: Rows of one key that a task compares with as many others.
PIECE = 8192
#: Bytes of sets of one component that a task compares with as many of rows that ask.
PIECE_BYTES = 8 << 20
#: Keys of up to this many rows are compared whole, many at once.
SMALL = 64
#: Shingles are ordered by counts in so many buckets, whatever their number.
BUCKETS = 1 << 18
#: Text that a task hashes at once, unless one document is longer.
SLICE_BYTES = 2 << 20
MAX_BROADCAST_IDS = 500_000
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, TREES * DEPTH, np.uint64) * _U(2) + _U(1)
_B = _rng.integers(1, 2**63, TREES * DEPTH, np.uint64)
#: The deeper values of each tree are those of the tree after it.
_DEEPER = (np.arange(TREES)[:, None] * DEPTH + DEPTH + np.arange(LANES)) % (TREES * DEPTH)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, one text after another; how many each has)."""
    h, _, counts = word_names(texts, LOWER)
    each = np.zeros(0, np.uint64) if len(h) < words else h[: len(h) - words + 1].copy()
    for k in range(1, words):
        each = mix(each * _U(_P)) + h[k : len(h) - words + 1 + k] if len(each) else each
    each = mix(each)
    out, sizes, at = [], [], 0
    for n in counts.tolist():
        if n >= words:
            own = np.unique(each[at : at + n - words + 1])
        elif n:
            own = np.array([hash_sequence(h[at : at + n])], np.uint64)
        else:
            own = each[:0]
        out.append(own)
        sizes.append(len(own))
        at += n
    return np.concatenate(out) if out else each[:0], np.array(sizes, np.int64)


def hash_sequence(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0xD6E8FEB86659FD93 + v + 1) & (2**64 - 1)
    return x


def minhashes(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of TREES * DEPTH values for each non-empty set."""
    own = sizes[sizes > 0]
    ends = np.cumsum(own)
    out = np.zeros((len(own), len(_A)), np.uint64)
    first = 0
    while first < len(own):  # chunks that stay in the processor's cache
        base = int(ends[first] - own[first])
        last = max(first + 1, int(np.searchsorted(ends, base + 32768, side="right")))
        chunk = elements[base : int(ends[last - 1])]
        cut = (ends[first:last] - own[first:last]) - base
        tmp = np.empty_like(chunk)
        for j in range(len(_A)):
            np.multiply(chunk, _A[j], out=tmp)
            np.add(tmp, _B[j], out=tmp)
            out[first:last, j] = np.minimum.reduceat(tmp, cut)
        first = last
    return out


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys binary, deeper binary, sketch_a long, sketch_b long"


def _sign(texts: pa.Array, words: int) -> list[pa.Array]:
    elements, sizes = shingles(texts, words)
    some = np.flatnonzero(sizes > 0)
    m = minhashes(elements, sizes)
    ends = np.cumsum(sizes[some])
    cut = ends - sizes[some]
    a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if some.size:
        a[some], b[some] = np.add.reduceat(mix(elements), cut), np.add.reduceat(mix(elements ^ _U(_P)), cut)
    top = (m >> _U(32)).reshape(len(some), TREES, DEPTH)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(some), TREES)).copy()
    for k in range(DEPTH):
        key = mix(key * _U(_P) + top[:, :, k] + _U(1))
    deeper = np.zeros((len(some), TREES), np.uint64)
    for k in range(LANES):
        deeper = (deeper << _U(16)) | (m[:, _DEEPER[:, k]] >> _U(48))
    bits = np.packbits((mix(m[:, :BITS]) & _U(1)).astype(np.uint8), axis=1).view(np.uint64).reshape(len(some), 2) if some.size else np.zeros((0, 2), np.uint64)
    blank: list[bytes | None] = [None] * len(texts)
    keys, deep = blank.copy(), blank.copy()
    for r, d in enumerate(some.tolist()):
        keys[d], deep[d] = key[r].tobytes(), deeper[r].tobytes()
    sketch = np.zeros((len(texts), 2), np.uint64)
    sketch[some] = bits
    i64 = lambda x: pa.array(x.view(np.int64))
    return [pa.array(sizes), i64(a), i64(b), pa.array(keys, pa.binary()), pa.array(deep, pa.binary()), i64(np.ascontiguousarray(sketch[:, 0])), i64(np.ascontiguousarray(sketch[:, 1]))]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in portions(batch.column("text"), SLICE_BYTES):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_sign(part.column("text"), words)], names=[x.split()[0] for x in _SIGNED.split(", ")])

    return map_batches(docs.select("doc_id", "text"), run, _SIGNED)


# -- the forest ------------------------------------------------------------------------------

_ORDER = ["key", "deeper", "sketch_a", "sketch_b", "id"]
_ENTRY = "key long, deeper long, sketch_a long, sketch_b long, id long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            n = batch.num_rows
            cols = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("keys", "deeper")]
            cols += [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), TREES) for c in ("sketch_a", "sketch_b", "id")]
            assert len(cols[0]) == n * TREES
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in _ENTRY.split(", ")])


_PAIR = "a long, b long, differ int, edge int, part int, " + ", ".join(f"e_{x}" for x in _ENTRY.split(", "))


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(p[:, 0] ^ q[:, 0]).astype(np.int32) + np.bitwise_count(p[:, 1] ^ q[:, 1])


def _neighbours(rows: np.ndarray, near: int) -> np.ndarray:
    """(a, b, bits that differ) of the pairs of one region to compare whose sketches are close. Rows in their order."""
    found = [np.zeros((0, 3), np.int64)]
    if len(rows) < 2:
        return found[0]
    key, sketch, ids = rows[:, 0], rows[:, 2:4].view(np.uint64), rows[:, 4]
    # Rows of a small region meet all others of it. In a crowded one the depth adapts to each row: of those next to it in
    # the order one has the longest prefix in common with it, however long that is, and they alone are compared.
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    small = np.repeat(np.diff(cut) <= near + 1, np.diff(cut))
    for step in range(1, min(near, len(rows) - 1) + 1):
        i = np.flatnonzero((key[step:] == key[:-step]) & (small[step:] | (step == 1)))
        if not i.size:
            break
        d = _differ(sketch[i], sketch[i + step])
        close, j = d <= FAR, i + step
        found.append(np.stack([np.minimum(ids[i], ids[j])[close], np.maximum(ids[i], ids[j])[close], d[close]], 1))
    return np.concatenate(found)


def _scan(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Neighbours within a range of the order, and the rows at its edges (edge 0: first, 1: last)."""
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _PAIR.split(", ")]
    kept = np.zeros((0, 5), np.int64)
    head: np.ndarray | None = None

    def pairs(p: np.ndarray) -> pa.RecordBatch:
        p = np.unique(p, axis=0) if len(p) else p
        null = [pa.nulls(len(p), pa.int32())] * 2 + [pa.nulls(len(p), pa.int64())] * 5
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2].astype(np.int32)), *null], names=names)

    def edges(rows: np.ndarray, which: int) -> pa.RecordBatch:
        n = len(rows)
        cols = [pa.nulls(n, pa.int64())] * 2 + [pa.nulls(n, pa.int32()), pa.array(np.full(n, which, np.int32)), pa.array(np.full(n, part, np.int32))]
        return pa.RecordBatch.from_arrays(cols + [pa.array(rows[:, k]) for k in range(5)], names=names)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if not len(rows):
            continue
        if head is None or len(head) < near:
            head = rows[:near] if head is None else np.concatenate([head, rows])[:near]
        rows = np.concatenate([kept, rows])
        # ``kept`` is compared with itself again; equal pairs fall away later.
        yield pairs(_neighbours(rows, near))
        kept = rows[-near:]
    if head is not None:
        yield edges(head, 0)
        yield edges(kept, 1)


def candidates(entries: DataFrame, near: int = NEAR) -> DataFrame:
    """Distinct pairs (a < b) of neighbours with close sketches, and the bits that differ; staged."""
    spark = entries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER)
    out = staged(map_batches(ranged, lambda it: _scan(it, near), _PAIR), "neighbours")
    # At most 2 * near rows for each range, whatever the number of documents.
    edge = out.where("edge is not null").select("part", "edge", *[f"e_{x.split()[0]}" for x in _ENTRY.split(", ")]).collect()
    across = []
    rows: dict[tuple[int, int], list[tuple]] = {}
    for r in edge:
        rows.setdefault((r["part"], r["edge"]), []).append(tuple(r)[2:])
    ends = {k: np.array(sorted(v), np.int64) for k, v in rows.items()}
    parts = sorted({p for p, _ in ends})
    for p, q in zip(parts, parts[1:], strict=False):
        across += _neighbours(np.concatenate([ends[p, 1], ends[q, 0]]), near).tolist()
    pairs = out.where("edge is null").select("a", "b", "differ")
    if across:
        pairs = pairs.unionByName(spark.createDataFrame(across, "a long, b long, differ long").withColumn("differ", F.col("differ").cast("int")))
    return staged(pairs.groupBy("a", "b").agg(F.min("differ").alias("differ")), "candidates")


# -- confirmation ----------------------------------------------------------------------------


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, items (sorted shingle hashes, 8 bytes each) of the documents in ``ids`` (staged, distinct)."""
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    own = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in portions(batch.column("text"), SLICE_BYTES):
                part = batch.slice(start, end - start)
                elements, sizes = shingles(part.column("text"), words)
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                items = [elements[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(items, pa.binary())], names=["id", "items"])

    return map_batches(own, run, "id long, items binary")


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        keep = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(p) * 100 < percent * len(q) or len(q) * 100 < percent * len(p):
                continue
            both = np.concatenate([p, q])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * inter >= percent * (len(both) - inter)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; staged."""
    x, y = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return staged(map_batches(both, lambda it: _confirm(it, percent), "a long, b long"), "links")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "comp"])


# -- crowded regions -------------------------------------------------------------------------


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for items in batch.column("items"):
            np.add.at(total, (np.frombuffer(items.as_buffer(), np.uint64) & _U(BUCKETS - 1)).astype(np.int64), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


_KEYED = "token long, id long, comp long, size int, place int, sketch_a long, sketch_b long"


def _keys(batches: Iterator[pa.RecordBatch], commonness: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The keys of each row: its rarest shingles, so many that of two similar sets one key is common to both."""
    for batch in batches:
        token, place, n, sizes = [], [], [], []
        for items in batch.column("items"):
            own = np.frombuffer(items.as_buffer(), np.uint64)
            order = np.lexsort((own, commonness[(own & _U(BUCKETS - 1)).astype(np.int64)]))
            first = order[: len(own) * (100 - percent) // 100 + 1]
            token.append(own[first])
            place.append(np.arange(len(first)))
            n.append(len(first))
            sizes.append(len(own))
        if not n:
            continue
        times = lambda c, n=n, batch=batch: pa.array(np.repeat(batch.column(c).to_numpy(), n))
        cols = [pa.array(np.concatenate(token).view(np.int64)), times("id"), times("comp"), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.concatenate(place).astype(np.int32))]
        out = pa.RecordBatch.from_arrays([*cols, times("sketch_a"), times("sketch_b")], names=[x.split()[0] for x in _KEYED.split(", ")])
        for k in range(0, out.num_rows, 1 << 16):
            yield out.slice(k, 1 << 16)


def _asked(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """(id, component) of pairs of rows of one key that may be a link: a row that asks and the component of the other.

    A pair may be one by its sizes, by what the key's places leave, and by its sketches; where both ask, the greater id does.
    """
    si, sj = rows["size"][i], rows["size"][j]
    left = np.minimum(si - rows["place"][i], sj - rows["place"][j])
    fit = (rows["comp"][i] != rows["comp"][j]) & (rows["asks"][i] | rows["asks"][j])
    fit &= (100 * np.minimum(si, sj) >= percent * np.maximum(si, sj)) & ((100 + percent) * left >= percent * (si + sj))
    k = np.flatnonzero(fit)
    k = k[_differ(rows["sketch"][i[k]], rows["sketch"][j[k]]) <= FAR]
    i, j = i[k], j[k]
    swap = rows["asks"][j] & (~rows["asks"][i] | (rows["id"][j] > rows["id"][i]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return np.unique(np.stack([rows["id"][i], rows["comp"][j]], 1), axis=0)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin and end) of rows that come sorted by ``keys``, never a part of a group."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        same = np.ones(max(0, table.num_rows - 1), bool)
        for c in keys:
            x = table.column(c).to_numpy()
            same &= x[1:] == x[:-1]
        return table, np.flatnonzero(np.concatenate([[True], ~same, [True]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], 1)
        last = np.flatnonzero((key != key[-1]).any(1))
        stop = int(last[-1]) + 1 if last.size else 0  # the batch's last group may go on in the next one
        if stop or (held and any(held[-1].column(c)[-1].as_py() != key[0, k] for k, c in enumerate(keys))):
            if stop:
                held.append(batch.slice(0, stop))
            yield out()
            held = []
        held.append(batch.slice(stop))
    if held:
        yield out()


def _meet(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """(id, comp): which rows may have a link to which other component, of every group (token, piece, block)."""
    for table, cut in _whole_groups(batches, ["token", "piece", "block"]):
        rows = {c: table.column(c).to_numpy().astype(np.int64) for c in ("id", "comp", "size", "place")}
        rows["asks"] = table.column("asks").to_numpy()
        rows["sketch"] = np.stack([table.column(c).to_numpy() for c in ("sketch_a", "sketch_b")], 1).view(np.uint64)
        n = np.diff(cut)
        left = np.repeat(cut[1:], n)
        few = np.repeat(n <= most, n)
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, int(n[n <= most].max(initial=1))):
            i = np.flatnonzero(few & (np.arange(len(left)) + step < left))
            if not i.size:
                break
            found.append(_asked(rows, i, i + step, percent))
        for g in np.flatnonzero(n > most).tolist():
            every = np.arange(cut[g], cut[g + 1])
            asking = every[rows["asks"][every]]
            step = max(1, (1 << 20) // len(every))
            for k in range(0, len(asking), step):
                some = asking[k : k + step]
                found.append(_asked(rows, np.repeat(some, len(every)), np.tile(every, len(some)), percent))
        out = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["id", "comp"])


def _answers(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, c_a, c_b): the first link of each row that asks among the rows of a component, of every group (comp, piece, block)."""
    for table, cut in _whole_groups(batches, ["comp", "piece", "block"]):
        asks, ids, own, comp = (table.column(c).to_numpy() for c in ("asks", "id", "own", "comp"))
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        found = []
        for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            held = lo + np.flatnonzero(~asks[lo:hi])
            if not held.size or held.size == hi - lo:
                continue
            size = np.array([len(items[h]) for h in held.tolist()])
            starts = np.cumsum(size) - size
            distinct, codes = np.unique(np.concatenate([items[h] for h in held.tolist()]), return_inverse=True)
            mark = np.zeros(len(distinct), np.int64)
            for q in (lo + np.flatnonzero(asks[lo:hi])).tolist():
                at = np.searchsorted(distinct, items[q])
                at = at[(at < len(distinct)) & (distinct[np.minimum(at, len(distinct) - 1)] == items[q])]
                mark[at] = 1
                inter = np.add.reduceat(mark[codes], starts)
                mark[at] = 0
                hit = np.flatnonzero(100 * inter >= percent * (size + len(items[q]) - inter))
                if hit.size:
                    found.append((ids[q], ids[held[hit[0]]], own[q], comp[q]))
        rows = np.array(found, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["a", "b", "c_a", "c_b"])


def rest(rows: DataFrame, percent: int, small: int = SMALL, piece: int = PIECE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """a, b, c_a, c_b: links between the components of ``rows`` (id, comp, sketch_a, sketch_b, items; staged), so that every two with a link have one. Staged.

    First keys tell which rows may have a link to which components, then full sets say which have.
    """
    spark = rows.sparkSession
    counts = map_batches(rows.select("items"), _bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    commonness = np.zeros(BUCKETS, np.uint16)
    for r in counts:
        commonness[r["bucket"]] = int(8 * np.log2(r["n"]))
    sent = spark.sparkContext.broadcast(commonness)
    keyed = staged(map_batches(rows, lambda it: _keys(it, sent.value, percent), _KEYED), "keys")
    by_comp = keyed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    groups = by_comp.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    asking = F.col("n") - F.col("most.n")
    groups = groups.select("token", "n", F.col("most.comp").alias("most"), F.ceil(F.col("n") / piece).cast("int").alias("pieces"), F.ceil(asking / piece).cast("int").alias("blocks"))
    both = keyed.join(staged(groups, "mixed-keys"), "token")
    names = ["token", "piece", "block", "id", "comp", "size", "place", "sketch_a", "sketch_b", "asks"]
    zero, yes, dealt = F.lit(0), F.lit(True), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    few = both.where(F.col("n") <= small).withColumns({"piece": zero, "block": zero, "asks": yes}).select(*names)
    large = both.where(F.col("n") > small)
    asks = large.where("comp <> most").withColumns({"block": dealt("blocks"), "piece": every("pieces"), "asks": yes}).select(*names)
    held = large.withColumns({"piece": dealt("pieces"), "block": every("blocks"), "asks": ~yes}).select(*names)
    met = few.unionByName(asks).unionByName(held).repartition("token", "piece", "block").sortWithinPartitions("token", "piece", "block")
    asked = staged(map_batches(met, lambda it: _meet(it, percent, small), "id long, comp long").distinct(), "asked")
    drop_staged(keyed)
    # Rows that ask a component and its own rows, in blocks and pieces of bounded bytes.
    own = rows.select("id", F.col("comp").alias("own"), "items")
    size = F.sum(F.octet_length("items"))
    width = lambda c: F.ceil(F.col(c) / piece_bytes).cast("int")
    queries = asked.join(own, "id")
    sizes = queries.groupBy("comp").agg(size.alias("q")).join(own.groupBy(F.col("own").alias("comp")).agg(size.alias("h")), "comp")
    sizes = staged(sizes.select("comp", width("h").alias("pieces"), width("q").alias("blocks")), "asked-sizes")
    names = ["comp", "piece", "block", "id", "own", "items", "asks"]
    asks = queries.join(sizes, "comp").withColumns({"block": dealt("blocks"), "piece": every("pieces"), "asks": yes}).select(*names)
    held = own.withColumn("comp", F.col("own")).join(sizes, "comp").withColumns({"piece": dealt("pieces"), "block": every("blocks"), "asks": ~yes}).select(*names)
    met = asks.unionByName(held).repartition("comp", "piece", "block").sortWithinPartitions("comp", "piece", "block", "asks", "id")
    return staged(map_batches(met, lambda it: _answers(it, percent), "a long, b long, c_a long, c_b long"), "rest")


# -- components ------------------------------------------------------------------------------


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id, comp (least id of its component) for every end of ``links`` (a, b; staged)."""
    if links.count() <= one_task:
        return map_batches(links.select("a", "b").coalesce(1), _union_find, "id long, comp long")
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Large-star keeps u > v. Small-star joins u and its lesser neighbours to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "stars")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are in different components, with both (c_a, c_b)."""
    for end in ("a", "b"):
        named = comp.select(F.col("id").alias(end), F.col("comp").alias(f"c_{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return pairs.where("c_a <> c_b")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after the components that ``links`` (c_a, c_b) name are joined; ids without a row are their own."""
    new = staged(components(staged(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), "merges")), "merged")
    old = comp.join(new.select(F.col("id").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("id", F.coalesce("now", "comp").alias("comp"))
    fresh = new.join(comp, "id", "left_anti")
    return staged(old.unionByName(fresh), "components")


def _plain_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is null or occurs twice."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number (and its name) that rises with doc_id, nulls last; staged."""
    row = inner_name(docs, "__row")
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    return staged(docs.orderBy(*order).withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def cluster(docs: DataFrame, words: int = 5, percent: int = 80, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``. ``sizes``: near, small, piece, piece_bytes.

    Of rows without a doc_id one of each component is kept that has no doc_id at all.
    """
    if _plain_ids(docs):
        return _cluster(docs, words, percent, **sizes)
    rows, row = _numbered(docs.select("doc_id", "text"))
    own = _cluster(rows.select(F.col(row).alias("doc_id"), "text"), words, percent, **sizes)
    own = own.select(F.col("doc_id").alias(row), "n_shingles", F.col("component_id").alias("__first"), F.col("kept").alias("__kept"))
    first = rows.select(F.col(row).alias("__first"), F.col("doc_id").alias("component_id"))
    out = own.join(rows.select(row, "doc_id"), row).join(first, "__first")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("__kept") | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def _settled(comp: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``comp`` after all links among ``pairs`` (a, b, differ; staged): best first, as long as a pair's ends are apart."""
    most = 1
    while not pairs.isEmpty():
        ends = pairs.select("a", "b", "differ", F.explode(F.array("a", "b")).alias("own"))
        rank = F.row_number().over(Window.partitionBy("own").orderBy("differ", "a", "b"))
        chosen = staged(ends.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b").distinct(), "chosen")
        comp = _merged(comp, _across(confirm(chosen, sets, percent), comp))
        pairs = staged(_across(pairs.join(chosen, ["a", "b"], "left_anti"), comp).select("a", "b", "differ"), "apart")
        most *= 4
    return comp


def _cluster(docs: DataFrame, words: int, percent: int, near: int = NEAR, small: int = SMALL, piece: int = PIECE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The same where every row has a doc_id of its own."""
    spark = docs.sparkSession
    signed = staged(signatures(docs, words), "minhash")
    same = ["n_shingles", "set_a", "set_b"]
    filled = signed.where("n_shingles > 0")
    classes = staged(filled.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, same).where(F.col("doc_id") == F.col("rep"))
    reps = reps.groupBy(F.col("doc_id").alias("id")).agg(*[F.first(c).alias(c) for c in ("keys", "deeper", "sketch_a", "sketch_b")])
    entries = staged(map_batches(reps, _entries, _ENTRY), "forest")
    comp = spark.createDataFrame([], "id long, comp long")
    pairs = candidates(entries, near)
    if not pairs.isEmpty():
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
        sets = staged(full_sets(docs, ids, words).dropDuplicates(["id"]), "sets")
        comp = _settled(comp, pairs, sets, percent)
        drop_staged(sets)
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > near + 1).select("key")
    crowded = entries.select("key", "id", "sketch_a", "sketch_b").join(crowded, "key", "left_semi")
    crowded = staged(crowded.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "crowded")
    mixed = crowded.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    apart = crowded.join(mixed, "key", "left_semi").groupBy("id").agg(*[F.first(c).alias(c) for c in ("comp", "sketch_a", "sketch_b")])
    apart = staged(apart, "crowded-apart")
    if not apart.isEmpty():
        sets = full_sets(docs, apart.select("id"), words).dropDuplicates(["id"])
        rows = staged(apart.join(sets, "id"), "crowded-sets")
        comp = _merged(comp, rest(rows, percent, small, piece, piece_bytes))
        drop_staged(rows)
    drop_staged(entries, crowded)
    classes = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = signed.select("doc_id", *same).join(classes, same, "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, that of the least doc_id, all columns; rows without words stay.

    A row goes only if another of its component stays, whatever their doc_ids.
    """
    if _plain_ids(docs):
        kept = staged(_cluster(docs, words, percent).where("kept").select("doc_id"), "kept")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows, row = _numbered(docs)
    kept = _cluster(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).where("kept")
    return rows.join(staged(kept.select(F.col("doc_id").alias(row)), "kept"), row, "left_semi").select(*docs.columns)
