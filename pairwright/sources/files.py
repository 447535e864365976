"""Readers and writers of attempt logs and result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines as typed rows; bad lines are an error, blank lines and a byte-order mark are skipped, a missing file is empty."""
    paths = [path] if isinstance(path, str) else path
    here = [p for p in paths if exists(spark, p)]
    if len(here) < len(paths) and not missing_ok:
        raise FileNotFoundError(str(sorted(set(paths) - set(here))))
    if not here:
        return spark.createDataFrame([], schema)
    text = spark.read.text(here).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_jsonl_located(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """As ``read_jsonl`` with ``file`` and a permissive parse: rows that don't parse have ``corrupt`` text."""
    text = spark.read.text(paths).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = text.withColumn("x", F.from_json("value", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    return parsed.select("file", "x.*")


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header or JSON lines, by suffix; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    return read_jsonl(spark, path, schema, missing_ok=False)


def read_env(text: str, known: dict[str, str] | None = None, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines: comments are skipped, quotes trimmed; what is known stays unless it is to be overridden."""
    out = dict(known or {})
    for line in text.splitlines():
        name, eq, value = (x.strip() for x in line.partition("="))
        if eq and name and not name.startswith("#") and (override or name not in out):
            out[name] = value.strip("\"'")
    return out


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in a fixed order, others dropped; an empty table is refused."""
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_all_or_none(outputs: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> None:
    """Write several CSV folders so that all of them change or none does.

    Each is staged beside its target and counted again; then targets move to a backup and the staged
    folders into place. If a move fails, what was moved goes back.
    """
    paths = [p.rstrip("/") for p in outputs]
    if len(set(paths)) < len(paths):
        raise ValueError("two outputs have one destination")
    spark = next(iter(outputs.values())).sparkSession
    tag = uuid.uuid4().hex
    staged, moved = {}, []
    try:
        for path, df in outputs.items():
            path = path.rstrip("/")
            staged[path] = f"{path}.new-{tag}"
            own = df.select(*(columns or {}).get(path, df.columns))
            rows = own.count()
            write_csv(own, staged[path])
            if spark.read.option("header", True).schema(own.schema).csv(staged[path]).count() != rows:
                raise OSError(f"{path}: not all rows were written")
        for path, new in staged.items():
            p, fs = _path(spark, path)
            old, _ = _path(spark, f"{path}.old-{tag}")
            had = fs.exists(p)
            if had and not fs.rename(p, old):
                raise OSError(f"{path} can't be moved away")
            moved.append((p, old, had, fs))
            if not fs.rename(_path(spark, new)[0], p):
                raise OSError(f"{path} can't be put in place")
    except BaseException:
        for p, old, had, fs in reversed(moved):
            fs.delete(p, True)
            if had:
                fs.rename(old, p)
        raise
    finally:
        for new in staged.values():
            p, fs = _path(spark, new)
            fs.delete(p, True)
    for _, old, had, fs in moved:
        if had:
            fs.delete(old, True)


def sparse_union(*frames: DataFrame) -> DataFrame:
    """Tables of different columns under one another, columns in the order they are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
