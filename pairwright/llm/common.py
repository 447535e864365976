"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}
#: Bytes of rows that Spark puts into one Arrow batch: its own default, 64 MB, is much for workers of small executors.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors share.

    A temporary folder stands in only where that setting is unset and all runs on one machine (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        base = _UNSET.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="pairwright-"))
    return f"{base.rstrip('/')}/pairwright/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: what was written survives lost executors, and rows that depend on task order
    (batch boundaries, generated ids) stay as they were written. An empty table reads back empty.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def _give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most about ``BATCH_BYTES``, unless one row is longer.

    The session's bound on Arrow batches is lowered if it is larger.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(df.sparkSession.conf.get(name, "64m")).rstrip("bkmg") or 0) != BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def inner_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many more underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, apart: str) -> Column:
    """``row``: all columns of ``df`` but ``apart`` as one, so that no inner name clashes with them."""
    return F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in df.columns if c != apart]).alias("row")


def unpacked(df: DataFrame, apart: str) -> list[Column]:
    """The columns of ``df`` in their order, from ``row`` and ``apart``."""
    return [F.col(apart) if c == apart else F.col(f"row.`{c}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

