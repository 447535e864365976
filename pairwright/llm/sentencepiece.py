"""SentencePiece encoding and decoding with numpy: Viterbi, words of equal length advancing together.

``Encoder`` reads a model file itself. Texts are cut into words that no piece can span; the distinct
words of a batch are grouped by length, and each group advances as one matrix (``viterbi``): rolling hashes of all
substrings probe the sorted piece keys, what is found is compared with the piece itself, and at each place vectorised
maxima over all pieces that end there keep the best score and a backpointer; then all words step back together.
Characters without a piece become byte pieces.

No public unigram vocabulary is at hand. ``unigram_model`` gives the public BPE vocabulary the scores of a unigram model by a
rule, without training: the k-th merge has probability in proportion to 1 / (k + ``ZIPF_SHIFT``). It returns a model file, which
the public library reads too, so that its ids can be compared. (``kind=BPE`` encodes with the file's own merges
in rank order instead, which Viterbi over its ranks doesn't give: ``merge``.)

Defined cases: a null text has null ids and no round trip; an empty text has no ids; words longer
than ``LONG`` characters are probed in the same way, but advance one by one; other columns are ignored.
Decoding gives back the text exactly, but for the meta symbol U+2581, which decodes to a space.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .words import portions

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
LONG = 200
#: Words and ids that a worker remembers within a task.
MAX_WORDS, MAX_IDS = 250_000, 3_000_000
#: Cells of a matrix of words (each with all pieces that may end there).
CELLS = 60_000
ZIPF_SHIFT = 2.7
SLICE_BYTES = 1 << 20
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
_MUL = 0x9E3779B97F4A7C15


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def read_model(path: str) -> bytes:
    """The model file, read on the driver; refused above ``MAX_MODEL_BYTES``, since it goes to every task."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return data


def _message(fields: list[tuple[int, object]]) -> bytes:
    """The protocol-buffer message of (number, value): int, float or bytes."""

    def varint(x: int) -> bytes:
        out = bytearray()
        x &= 2**64 - 1
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
        return bytes(out)

    out = []
    for number, value in fields:
        if isinstance(value, float):
            out.append(varint(number << 3 | 5) + struct.pack("<f", value))
        elif isinstance(value, int):
            out.append(varint(number << 3) + varint(value))
        else:
            out.append(varint(number << 3 | 2) + varint(len(value)) + value)
    return b"".join(out)


def unigram_model(model: bytes, shift: float = ZIPF_SHIFT) -> bytes:
    """``model`` (a BPE model file) as a unigram model: scores are log-probabilities that fall with the rank of a piece."""
    fields = list(_fields(model))
    pieces = {k: dict(_fields(v)) for k, (number, v) in enumerate(fields) if number == 1}
    own = sorted((k for k, p in pieces.items() if p.get(3, NORMAL) == NORMAL), key=lambda k: (-pieces[k].get(2, 0.0), k))
    whole = float(np.log(np.sum(1 / (np.arange(len(own)) + shift))))
    score = {k: float(-np.log(rank + shift)) - whole for rank, k in enumerate(own)}
    out = []
    for k, (number, value) in enumerate(fields):
        if number == 1:
            value = _message([*((n, v) for n, v in _fields(value) if n != 2), (2, score.get(k, 0.0))])
        elif number == 2:
            value = _message([*((n, v) for n, v in _fields(value) if n != 3), (3, UNIGRAM)])
        out.append((number, value))
    return _message(out)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of character codes: out[:, e] covers the first e."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * np.uint64(_MUL) + (codes[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


class Encoder:
    def __init__(self, model: bytes, kind: int | None = None) -> None:
        self.pieces: list[str] = []
        scores, types = [], []
        prefix, extra, charsmap = True, True, b""
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(p.get(2, 0.0))
                types.append(p.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                prefix, extra, charsmap = spec.get(3, 1), spec.get(4, 1), spec.get(2, b"")
        self.kind = kind or self.kind_of(model)
        if charsmap or extra:
            raise ValueError("only models without normalisation are supported")
        self.prefix = bool(prefix)
        self.scores, self.types = np.array(scores, np.float64), np.array(types)
        own = [i for i, t in enumerate(types) if t in (NORMAL, USER)]
        self.ids = {self.pieces[i]: i for i in own}
        if any(a != META == b for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece spans words")
        self.unknown = types.index(UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, t in enumerate(types):
            if t == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.is_byte = self.types == BYTE
        chars = sorted({c for p in self.ids for c in p})
        self.n_ids = len(self.pieces)
        #: Symbols: the pieces, then characters that only occur inside pieces, then any other character as itself.
        self.symbols = {c: self.ids.get(c, self.n_ids + k) for k, c in enumerate(chars)}
        # A word starts at a run of meta symbols; a line break that is in no longer piece stands alone.
        lone = "" if any(len(p) > 1 and "\n" in p for p in self.ids) else "\n"
        self._split = re.compile(rf"{META}*[^{META}{lone}]+|{META}+" + ("|\n" if lone else "")).findall
        self._build_pairs() if self.kind == BPE else self._build_keys()
        self.forget()
        raw = [bytes([int(self.pieces[i][3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(META, " ").encode() if t != UNKNOWN else " ⁇ ".encode() for i, (p, t) in enumerate(zip(self.pieces, types, strict=True))]
        self._raw = np.frombuffer(b"".join(raw), np.uint8)
        self._raw_lens = np.array([len(r) for r in raw], np.int64)
        self._raw_starts = np.concatenate([[0], np.cumsum(self._raw_lens)])[:-1]

    @staticmethod
    def kind_of(model: bytes) -> int:
        return next((dict(_fields(v)).get(3, UNIGRAM) for number, v in _fields(model) if number == 2), UNIGRAM)

    # -- BPE ---------------------------------------------------------------------------------

    def _build_pairs(self) -> None:
        keys, ranked = [], sorted(self.ids.items(), key=lambda x: (-self.scores[x[1]], x[1]))
        for rank, (p, i) in enumerate(ranked):
            for k in range(1, len(p)):
                a, b = (self.ids.get(x, self.symbols.get(x)) for x in (p[:k], p[k:]))
                if a is not None and b is not None:
                    keys.append(((a << 24) | b, rank, i))
        keys.sort()
        self._keys = np.array([k[0] for k in keys] + [1 << 62], np.int64)
        self._ranks = np.array([k[1] for k in keys] + [1 << 30], np.int32)
        self._merged = np.array([k[2] for k in keys] + [0], np.int32)
        self._pairs = {k: (r, m) for k, r, m in keys}

    def _probe(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or a large number, merged id) of each pair; symbols below 0 pair with nothing."""
        key = (left.astype(np.int64) << 24) | right
        at = np.searchsorted(self._keys, key)
        hit = (self._keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self._ranks[at], 1 << 30), self._merged[at]

    def _start_symbols(self, words: list[str]) -> np.ndarray:
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        distinct, back = np.unique(codes, return_inverse=True)
        own = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
        return own[back].reshape(codes.shape)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols after all merges, a row per word of one length; how many each has). Characters without a symbol are -1 - code point."""
        cur = self._start_symbols(words)
        m, n = cur.shape
        none = 1 << 30
        if n == 1:
            return cur, np.ones(m, np.int64)
        out, counts = np.zeros((m, n), np.int64), np.zeros(m, np.int64)
        rows, lens, col = np.arange(m), np.full(m, n), np.arange(n)
        # One column more than pairs, always without a merge: what moves in from the right edge.
        ranks, merged = np.full((m, n), none, np.int32), np.zeros((m, n), np.int32)
        ranks[:, :-1], merged[:, :-1] = self._probe(cur[:, :-1], cur[:, 1:])
        while rows.size:
            at = ranks.argmin(1)
            k = np.arange(rows.size)
            going = ranks[k, at] < none
            if not going.all():
                out[rows[~going]], counts[rows[~going]] = cur[~going], lens[~going]
                cur, ranks, merged, rows, lens, at = (x[going] for x in (cur, ranks, merged, rows, lens, at))
                k = np.arange(rows.size)
                if not rows.size:
                    break
            cur[k, at] = merged[k, at]
            # Close the gap: what stands right of the merged pair moves one place left.
            src = np.minimum(col + (col > at[:, None]), n - 1)
            cur, ranks, merged = (np.take_along_axis(x, src, 1) for x in (cur, ranks, merged))
            lens = lens - 1
            for p in (at - 1, at):
                q = np.flatnonzero((p >= 0) & (p + 1 < lens))
                ranks[q, p[q]], merged[q, p[q]] = self._probe(cur[q, p[q]], cur[q, p[q] + 1])
            q = np.flatnonzero(at + 1 >= lens)
            ranks[q, at[q]] = none
        return out, counts

    def _merge_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        sym: list[int | None] = [self.symbols.get(c, -1 - ord(c)) for c in word]
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (got := self._pairs.get((sym[i] << 24) | sym[j])):
                heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = to, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        own = np.array([[s for s in sym if s is not None]], np.int64)
        return own, np.array([own.shape[1]])

    # -- UNIGRAM -----------------------------------------------------------------------------

    def _build_keys(self) -> None:
        self._longest = max(map(len, self.ids))
        own = list(self.ids.values())
        self._codes = np.zeros((self.n_ids, self._longest), np.uint32)
        keys = np.zeros(len(own), np.uint64)
        for n in {len(p) for p in self.ids}:
            k = [x for x, i in enumerate(own) if len(self.pieces[i]) == n]
            codes = np.frombuffer("".join(self.pieces[own[x]] for x in k).encode("utf-32-le"), np.uint32).reshape(len(k), n)
            self._codes[np.array(own)[k], :n] = codes
            keys[k] = _hashes(codes)[:, n]
        order = np.argsort(keys)
        self._keys, self._key_ids = keys[order], np.array(own, np.int32)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("piece hashes collide")
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[self._slot(keys)] = True
        self._power = np.array([pow(_MUL, k, 1 << 64) for k in range(self._longest + 1)], np.uint64)
        # As the public library does: the least score of a piece less ten, for a character of no piece.
        self._unknown_score = min(self.scores[i] for i in self.ids.values()) - 10

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)

    def _found(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, row, start, piece) of all pieces in rows of character codes, by length."""
        h = _hashes(codes)
        n = codes.shape[1]
        for length in range(1, min(n, self._longest) + 1):
            probe = h[:, length:] - h[:, :-length] * self._power[length]
            row, start = np.nonzero(self._maybe[self._slot(probe)])
            probe = probe[row, start]
            at = np.minimum(np.searchsorted(self._keys, probe), len(self._keys) - 1)
            k = np.flatnonzero(self._keys[at] == probe)
            row, start, piece = row[k], start[k], self._key_ids[at[k]]
            same = np.ones(len(k), bool)
            for c in range(length):
                same &= codes[row, start + c] == self._codes[piece, c]
            if length < self._longest:
                same &= self._codes[piece, length] == 0
            yield length, row[same], start[same], piece[same]

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the segmentation of the best total score, a row per word of one length; how many each has). Characters of no piece are -1 - code point."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        if n > LONG:
            return self._viterbi_long(codes)
        most = min(n, self._longest)
        # At [row, end, k]: the piece of most - k characters that ends there, so that of equal scores the longest is first.
        score, which = np.full((m, n + 1, most), -np.inf, np.float32), np.zeros((m, n + 1, most), np.int32)
        lone = np.ones((m, n), bool)
        for length, row, start, piece in self._found(codes):
            score[row, start + length, most - length], which[row, start + length, most - length] = self.scores[piece], piece
            if length == 1:
                lone[row, start] = False
        row, start = np.nonzero(lone)
        score[row, start + 1, -1], which[row, start + 1, -1] = self._unknown_score, -1 - codes[row, start].astype(np.int32)
        best, back = np.zeros((m, n + 1)), np.zeros((m, n + 1), np.int64)
        every = np.arange(m)
        for e in range(1, n + 1):
            k = min(e, most)
            total = best[:, e - k : e] + score[:, e, most - k :]
            pick = total.argmax(1)
            best[:, e], back[:, e] = total[every, pick], pick + most - k
        out, counts = np.zeros((m, n), np.int64), np.zeros(m, np.int64)
        e, rows = np.full(m, n), np.arange(m)
        while rows.size:  # all words step back together
            k = back[rows, e[rows]]
            out[rows, n - 1 - counts[rows]] = which[rows, e[rows], k]
            counts[rows] += 1
            e[rows] -= most - k
            rows = rows[e[rows] > 0]
        left = np.minimum(np.arange(n) + (n - counts)[:, None], n - 1)
        return np.take_along_axis(out, left, 1), counts

    def _viterbi_long(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: pieces are looked up in stretches of it."""
        n, step = codes.shape[1], 1 << 14
        best, back, which = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for first in range(0, n, step):
            part = codes[:, first : first + step + self._longest - 1]
            found = [(start + first, length, piece) for length, _, start, piece in self._found(part)]
            start = np.concatenate([f[0] for f in found])
            length = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
            piece = np.concatenate([f[2] for f in found])
            own = start < first + step
            start, length, piece = start[own], length[own], piece[own]
            lone = np.setdiff1d(np.arange(first, min(n, first + step)), start[length == 1])
            start, length = np.concatenate([start, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
            score = np.concatenate([self.scores[piece], np.full(len(lone), self._unknown_score)])
            piece = np.concatenate([piece.astype(np.int64), -1 - codes[0, lone].astype(np.int64)])
            order = np.argsort(start, kind="stable")
            for s, size, x, p in zip(*(c[order].tolist() for c in (start, length, score, piece)), strict=True):
                e, total = s + size, best[s] + x
                if back[e] == 0 or total > best[e]:
                    best[e], back[e], which[e] = total, size, p
        out, e = [], n
        while e:
            out.append(which[e])
            e -= back[e]
        return np.array([out[::-1]], np.int64), np.array([len(out)])

    # -- both --------------------------------------------------------------------------------

    def _finish(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: those that aren't pieces become byte pieces."""
        if symbols.size and symbols.min() >= 0 and symbols.max() < self.n_ids:
            return symbols.astype(np.int32)
        chars = {v: k for k, v in self.symbols.items()} if (symbols >= self.n_ids).any() else {}
        out: list[int] = []
        for s in symbols.tolist():
            if 0 <= s < self.n_ids:
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else chars[s]
                out.extend(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't in the cache yet, group by group of equal length."""
        by_len: dict[int, list[str]] = {}
        for w in words:
            by_len.setdefault(len(w), []).append(w)
        for n, group in by_len.items():
            step = max(1, CELLS // n) if n <= LONG else 1
            for k in range(0, len(group), step):
                some = group[k : k + step]
                if self.kind == BPE:
                    self._keep(some, *(self.merge(some) if n <= LONG else self._merge_long(some[0])))
                else:
                    self._keep(some, *self.viterbi(some))

    def _keep(self, words: list[str], symbols: np.ndarray, counts: np.ndarray) -> None:
        inside = np.arange(symbols.shape[1]) < counts[:, None]
        odd = ((symbols < 0) | (symbols >= self.n_ids)) & inside
        rows = np.flatnonzero(odd.any(1))
        if rows.size:  # words with byte pieces
            for r in rows.tolist():
                self._append([words[r]], self._finish(symbols[r, : counts[r]]), None)
            plain = ~odd.any(1)
            words = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
            symbols, counts, inside = symbols[plain], counts[plain], inside[plain]
        self._append(words, symbols[inside].astype(np.int32), counts)

    def _append(self, words: list[str], ids: np.ndarray, counts: np.ndarray | None) -> None:
        k, m = len(self._cache), len(words)
        counts = np.array([len(ids)]) if counts is None else counts
        while k + m > len(self._starts):
            self._starts, self._lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._lens))
        while self._used + len(ids) > len(self._store):
            self._store = np.concatenate([self._store, np.zeros_like(self._store)])
        self._store[self._used : self._used + len(ids)] = ids
        ends = self._used + np.cumsum(counts)
        self._starts[k : k + m], self._lens[k : k + m] = ends - counts, counts
        self._used += len(ids)
        self._cache.update(zip(words, range(k, k + m), strict=True))

    def forget(self) -> None:
        """Drop the words remembered."""
        self._cache: dict[str, int] = {}
        self._store = np.zeros(1 << 16, np.int32)
        self._starts, self._lens = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._used = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        """The cache slot of each word."""
        if len(self._cache) > MAX_WORDS or self._used > MAX_IDS:
            self.forget()
        get = self._cache.get
        out = [get(w, -1) for w in words]
        slots = np.array(out, np.int64)
        miss = np.flatnonzero(slots < 0)
        if miss.size:
            new = [words[i] for i in miss]
            self._learn(list(dict.fromkeys(new)))
            slots[miss] = [self._cache[w] for w in new]
        return slots

    def tokens(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word)."""
        lens = self._lens[slots]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self._starts[slots] - (ends - lens), lens) + np.arange(total)
        return self._store[at], lens

    def words(self, text: str) -> list[str]:
        text = text.replace(" ", META)
        if self.prefix and text:
            text = META + text
        return self._split(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets: one more than texts)."""
        words, counts = [], []
        for t in texts:
            own = self.words(t)
            words += own
            counts.append(len(own))
        ids, lens = self.tokens(self.lookup(words))
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lens = self._raw_lens[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(self._raw_starts[ids] - ends[:-1], lens) + np.arange(int(ends[-1]))
        data = self._raw[at].tobytes()
        cut = ends[offsets].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        return [t.removeprefix(" ") for t in out] if self.prefix else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_BUILT: dict[bytes, Encoder] = {}


def encoder(model: bytes, kind: int | None = None) -> Encoder:
    """The encoder of the worker process; another model takes its place."""
    key = blake2b(model + bytes([kind or 0])).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(model, kind)
    return _BUILT[key]


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, kind: int = UNIGRAM) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (decoding gives the text back), in one pass without shuffle.

    A BPE model is read as the unigram model of its vocabulary unless ``kind`` is BPE.
    """
    data = read_model(model_path)
    if kind == UNIGRAM and Encoder.kind_of(data) == BPE:
        data = unigram_model(data)
    model = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for start, end in portions(batch.column("text"), SLICE_BYTES):
                texts = batch.column("text").slice(start, end - start).to_pylist()
                own = [t or "" for t in texts]
                ids, offsets = enc.encode_batch(own)
                same = [a == b for a, b in zip(enc.decode_batch(ids, offsets), own, strict=True)]
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(own)), pa.array(np.diff(offsets), pa.int64(), mask=null), lists, pa.array(np.array(same), mask=null)],
                    names=["doc_id", "n_tokens", "token_ids", "round_trip"],
                )
        enc.forget()

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")
