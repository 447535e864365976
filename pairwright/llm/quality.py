"""Quality rules: tokeniser fertility.

Public vocabularies measure each whole text: characters per token under two vocabularies (a
SentencePiece BPE with byte fallback and a byte-level BPE), the share of byte-fallback tokens, and
the entropy of the tokens. A document is rejected where a measure leaves the band of its language
(or, with no language given, of its script), on the side that the measure's rule names, or where
characters per token and entropy are both low, though each within its band (``joint``).

Words are runs of ``[^\\x20\\x09-\\x0D]+``; each is tokenised with a space before it (the distinct ones of a portion of text
once), and characters and tokens are those of the words. Bands are
``median -+ reach * IQR`` of all documents of the group, from exact counts of binned values, so they
cover all data, cost one small shuffle, and come out alike whatever the partitioning. They are taken
per length class (powers of two of the token count): entropy grows with length, and short texts vary
more, so that a short clean text with a long number or address in it stays.

Defined cases: a null text has no words; a text of no words has null measures and is rejected by the
base rule; a null or empty language is grouped by script; where fewer than ``min_group`` documents of a group
have a length, its band over all lengths holds (not for entropy), then that of all documents of the
length, then that of all documents; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, staged
from .sentencepiece import MODEL_PATH, read_model
from .words import portions, split

RANKS_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = "#*$%&|<>"
#: measure: (bins per unit, sides that reject, least half-width of the band)
MEASURES = {
    "chars_per_piece": (64, "low high", 0.25),
    "chars_per_byte_bpe": (64, "low high", 0.25),
    "byte_share": (1024, "high", 0.02),
    "entropy_ratio": (1024, "low", 0.06),
}
REACH = 4.0
#: The length class that stands for all lengths.
ANY_SIZE = -1
#: Measures that junk lowers together: the sum of their distances below the median, in IQRs, has a bound of its own.
JOINT, JOINT_REACH = ("chars_per_byte_bpe", "entropy_ratio"), 4.5
#: Text that a task measures at once, unless one document is longer.
SLICE_BYTES = 2 << 20
_SCHEMA = (
    "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, script string, chars_per_piece double, chars_per_byte_bpe double, byte_share double, entropy_ratio double"
)
_SCRIPTS = [("han", r"[㐀-鿿豈-﫿]"), ("kana", r"[぀-ヿ]"), ("hangul", r"[가-힯]"), ("cyrillic", r"[Ѐ-ӿ]"), ("arabic", r"[؀-ۿ]"), ("greek", r"[Ͱ-Ͽ]"), ("devanagari", r"[ऀ-ॿ]")]
_SCRIPTS = [(name, re.compile(p).findall) for name, p in _SCRIPTS]
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def script_of(text: str) -> str:
    """The script that most of the text's non-Latin letters belong to, or latin if they are few."""
    if text.isascii():
        return "latin"
    counts = [(len(find(text)), name) for name, find in _SCRIPTS]
    most, name = max(counts)
    return name if most * 4 > len(text) else "latin"


def repeated_words(codes: np.ndarray) -> int:
    """Positions covered by three-word windows that occur twice or more in one text; codes below 2**21."""
    if len(codes) < 4:
        return 0
    key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    hit = np.zeros(len(codes), bool)
    for k in range(3):
        hit[k : k + len(key)] |= twice[:-1]
    return int(hit.sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


class Measurer:
    """The columns of ``measure`` for a batch of texts."""

    def __init__(self, model: bytes, ranks: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_ids = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.n_ids)])
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary

    def __call__(self, texts: pa.Array, langs: pa.Array) -> list[np.ndarray | list]:
        distinct, codes, n = split(texts)
        words = [w.decode("utf-8", "replace") for w in distinct]
        m = len(texts)
        cut = np.concatenate([[0], np.cumsum(n)])

        def per_text(per_word: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(per_word[codes])])
            return total[cut[1:]] - total[cut[:-1]]

        own = [t or "" for t in texts.to_pylist()]
        chars = per_text(np.array([len(w) for w in words], np.int64))
        symbols = per_text(np.add.reduceat(_IS_SYMBOL[np.frombuffer(b"".join(distinct), np.uint8)], np.cumsum([0, *map(len, distinct)])[:-1], dtype=np.int64) if distinct else np.zeros(0, np.int64))
        dups = np.array([dup_lines(t) if "\n" in t else 0 for t in own], np.int64)
        if len(distinct) < 1 << 21:
            repeats = [repeated_words(codes[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        else:  # codes of its own for each text
            repeats = [repeated_words(np.unique(codes[a:b], return_inverse=True)[1].astype(np.int64)) for a, b in zip(cut, cut[1:], strict=False)]
        ids = self.pieces.encode(words, num_threads=1) if words else []
        per_piece = np.array([len(x) for x in ids], np.int64)
        ids = np.fromiter(chain.from_iterable(ids), np.int64, int(per_piece.sum()))
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        byte_sum = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        bpe = self.bpe
        tokens, fallback = per_text(per_piece), per_text(byte_sum[ends[1:]] - byte_sum[ends[:-1]])
        byte_bpe = per_text(np.array([len(bpe(" " + w)) for w in words], np.int64))
        entropy = np.zeros(m)
        first = 0
        while first < m:  # as many texts at once as have about a million tokens
            last = max(first + 1, int(np.searchsorted(np.cumsum(tokens[first:]), 1 << 20, side="right")) + first)
            some = codes[cut[first] : cut[last]]
            width = per_piece[some]
            stop = np.cumsum(width)
            at = np.repeat(ends[:-1][some] - (stop - width), width) + np.arange(int(stop[-1]) if len(stop) else 0)
            key = np.sort(np.repeat(np.repeat(np.arange(first, last), n[first:last]), width) * self.n_ids + ids[at])
            if len(key):
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                times = np.diff(np.concatenate([edge, [len(key)]]))
                doc = key[edge] // self.n_ids
                share = times / tokens[doc]
                entropy += np.bincount(doc, -share * np.log2(share), minlength=m)
            first = last
        known = tokens > 0
        div = lambda a, b: np.divide(a, b, out=np.full(m, np.nan), where=known & (b > 0))
        ratio = div(entropy, np.maximum(1.0, np.log2(np.maximum(tokens, 1))))
        # Scripts stand in where no language is given.
        scripts = [None if (lang or "").strip(" ") else script_of(t) for lang, t in zip(langs.to_pylist(), own, strict=True)]
        return [n, chars, symbols, dups, np.array(repeats, np.int64), tokens, scripts, div(chars, tokens), div(chars, byte_bpe), div(fallback, tokens), ratio]


def measure(docs: DataFrame, model_path: str = MODEL_PATH, ranks_path: str = RANKS_PATH) -> DataFrame:
    """doc_id, lang, text_hash, base counts and fertility measures of each row, in one pass without shuffle."""
    model, ranks = (docs.sparkSession.sparkContext.broadcast(read_model(p)) for p in (model_path, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Measurer(model.value, ranks.value)
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for start, end in portions(batch.column("text"), SLICE_BYTES):
                part = batch.slice(start, end - start)
                cols = of(part.column("text"), part.column("lang"))
                arrays = [pa.array(c, pa.string()) if isinstance(c, list) else pa.array(c, from_pandas=True) for c in cols]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "lang", "text_hash")] + arrays, names=names)

    return map_batches(docs.select("doc_id", F.col("lang").cast("string"), F.xxhash64("text").alias("text_hash"), "text"), run, _SCHEMA)


def _groups(m: DataFrame) -> DataFrame:
    lang = F.when(F.trim("lang") != "", F.concat(F.lit("lang:"), F.lower("lang")))
    size = F.when(F.col("n_tokens") > 0, F.floor(F.log2(F.col("n_tokens").cast("double")))).cast("int")
    return m.withColumns({"grp": F.coalesce(lang, F.concat(F.lit("script:"), "script")), "size_class": size})


def bands(measured: DataFrame, reach: float = REACH, min_group: int = 50, min_words: int = 50) -> DataFrame:
    """grp, size_class, measure, low, high, mid, unit; grp ``*`` holds for groups that are too small."""
    own = _groups(measured).where(F.col("n_words") >= min_words)
    each = [
        F.named_struct(
            F.lit("measure"), F.lit(k), F.lit("bin"), F.floor(F.col(k) * bins).cast("int"), F.lit("bins"), F.lit(bins), F.lit("least"), F.lit(least),
            F.lit("size_class"), F.col("size_class"),
        )
        for k, (bins, _, least) in MEASURES.items()
    ]
    rows = own.select(F.explode(F.array(F.col("grp"), F.lit("*"))).alias("grp"), F.array(*each).alias("m")).select("grp", F.explode("m").alias("m")).select("grp", "m.*")
    rows = rows.withColumn("size_class", F.explode(F.array(F.col("size_class"), F.lit(ANY_SIZE))))
    # At most a few thousand bins a group: what follows sees counts, not documents.
    counts = rows.where("bin is not null").groupBy("grp", "measure", "size_class", "bin", "bins", "least").agg(F.count(F.lit(1)).alias("n"))
    key = ["grp", "measure", "size_class"]
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
    counts = counts.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*key))})
    quant = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, (F.col("bin") + 0.5) / F.col("bins")))
    out = counts.groupBy(*key).agg(F.max("total").alias("total"), F.max("least").alias("least"), quant(0.25).alias("q1"), quant(0.5).alias("q2"), quant(0.75).alias("q3"))
    unit = F.greatest(F.col("least") / REACH, F.col("q3") - F.col("q1"))
    half = F.greatest(F.col("least"), reach * (F.col("q3") - F.col("q1")))
    return out.where(F.col("total") >= min_group).select(*key, (F.col("q2") - half).alias("low"), (F.col("q2") + half).alias("high"), F.col("q2").alias("mid"), unit.alias("unit"))


def _outside(bounds: Column, k: str, of: Column) -> Column:
    sides = MEASURES[k][1].split()
    low, high = bounds["low"], bounds["high"]
    out = F.lit(False)
    if "low" in sides:
        out = out | (of < low)
    if "high" in sides:
        out = out | (of > high)
    return F.coalesce(out, F.lit(False))


def judge(measured: DataFrame, reach: float = REACH, min_group: int = 50, min_words: int = 50) -> DataFrame:
    """``measured`` (a staged table: it is read twice) with base_failed, rejected_by (array of measures) and kept."""
    all_bands = bands(measured, reach, min_group, min_words)
    bound = F.struct("size_class", "measure", "low", "high", "mid", "unit")
    per = all_bands.groupBy("grp").agg(F.collect_list(bound).alias("bounds"))
    own = _groups(measured)
    default = per.where("grp = '*'").select(F.col("bounds").alias("common"))
    own = own.join(per, "grp", "left").join(F.broadcast(default.limit(1)), F.lit(True), "left")
    rejected, below = [], F.lit(0.0)
    for k in MEASURES:
        def pick(from_: str, size: Column, k: str = k) -> Column:
            fit = F.filter(from_, lambda b: (b["measure"] == k) & (b["size_class"] == size))
            return F.get(fit, F.lit(0))

        own_size, any_size = F.col("size_class"), F.lit(ANY_SIZE)
        if k == "entropy_ratio":
            bounds = F.coalesce(pick("bounds", own_size), pick("common", own_size))
        else:
            bounds = F.coalesce(pick("bounds", own_size), pick("bounds", any_size), pick("common", own_size), pick("common", any_size))
        rejected.append(F.when(_outside(bounds, k, F.col(k)), F.lit(k)))
        if k in JOINT:
            below = below + F.greatest(F.lit(0.0), (bounds["mid"] - F.col(k)) / bounds["unit"])
    rejected.append(F.when(below > JOINT_REACH, F.lit("joint")))
    own = own.withColumn("rejected_by", F.array_compact(F.array(*rejected)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = own.withColumn("base_failed", failed)
    return own.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("bounds", "common", "grp", "size_class")


def score_documents(docs: DataFrame, **kw) -> DataFrame:
    """All measures and the verdict of each row of ``docs``."""
    return judge(staged(measure(docs), "fertility"), **kw)


def keep_documents(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    good = score_documents(docs, **kw).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["__id"]) & (F.xxhash64(docs["text"]) == good["__hash"]), "left_semi")
