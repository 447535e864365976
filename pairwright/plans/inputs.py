"""Stand-ins over the driver's tables for attempt logs, score panels, ratings and text pairs, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.pairs import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles to so many decimals, ties as in SQL, no zero below nothing: sums hang on their order in the last bits."""
    return df.select(*[(nearest(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name for f in df.schema])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, a and b: two judges' scores of every cell.

    A mean's last bit hangs on the order of its sum, and floors, ranks and roundings hang on that bit: values are added in
    the order of the log, however its rows are split, as an engine that reads the log from its start adds them. The window
    reads a cell's rows one by one and spills; a cell is one user's events of one type. Its frame is the whole cell, so that
    each row has the cell's sum: ids may stand more than once or be null.
    """
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value").withColumn("__sum", F.sum("value").over(w))
    return own.groupBy("user_id", "event_type").agg((F.max("__sum") / F.count("value")).alias("a"), F.max("value").alias("b"))


def floored(c: Column) -> Column:
    """SQL's floor of a double, a double: Spark's is a long, in which NaN, infinities and large values have no place. From 2**53 on all are whole."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


PANEL = "panel AS (SELECT user_id, event_type, avg(value) AS a, max(value) AS b FROM events GROUP BY user_id, event_type)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_id, record_id, seq, latency_seconds, k, status, output_text, prompt_version, error."""
    k = F.get_json_object("props", "$.k").cast("long")
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("system_id"), F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.col("value").alias("latency_seconds"), k.alias("k"))
    k = F.col("k")
    own = own.withColumn("status", F.when(k % 7 == 0, "error").when(k % 11 == 0, "timeout").otherwise("ok"))
    return own.withColumns(
        {
            "output_text": F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("text "), k.cast("string"))),
            "prompt_version": F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("v"), (k % 3).cast("string"))),
            "error": F.when(F.col("status") != "ok", F.concat(F.lit("e"), k.cast("string"))).otherwise(""),
        }
    )


ATT = r"""raw AS (SELECT event_type AS system_id, user_id AS record_id, event_id AS seq, value AS latency_seconds, regexp_extract(props, '"k": ?(-?[0-9]+)', 1)::BIGINT AS k FROM events),
att AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'error' WHEN k % 11 = 0 THEN 'timeout' ELSE 'ok' END AS status,
  CASE WHEN k % 5 = 0 THEN ' ' ELSE 'text ' || k END AS output_text, CASE WHEN k % 4 = 0 THEN '' ELSE 'v' || (k % 3) END AS prompt_version,
  CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'e' || k ELSE '' END AS error FROM raw),
latest AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY system_id, record_id ORDER BY seq DESC) = 1)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, record, system, rater, dim, score: a whole grid of six dimensions."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rater"), F.concat("l_returnflag", "l_linestatus").alias("dim")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return own.select("item", F.floor(F.col("item") / 4).alias("record"), F.concat(F.lit("s"), (F.col("item") % 4).cast("string")).alias("system"), "rater", "dim", (1 + F.col("q") % 6).alias("score"))


RATE = """rate AS (SELECT l_suppkey AS item, l_suppkey // 4 AS record, 's' || (l_suppkey % 4) AS system, l_linenumber AS rater, l_returnflag || l_linestatus AS dim,
  1 + (sum(l_quantity)::BIGINT % 6) AS score FROM lineitem GROUP BY ALL)"""
DIMS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, system, h (assistant turn), r (the user turn before it)."""
    own = table(spark, sf_dir, "conversations")
    said = own.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("h"))
    asked = own.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("r"))
    return said.join(asked, ["conv_id", "turn"]).withColumn("system", F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")))


PAIR = """pair AS (SELECT h.conv_id, h.turn, h.text AS h, r.text AS r, 'g' || (h.conv_id % 3) AS system FROM conversations h JOIN conversations r
  ON h.conv_id = r.conv_id AND h.turn = r.turn + 1 WHERE h.role = 'assistant' AND r.role = 'user')"""


def answers(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """record, expected, mapping and a judge's JSON answer over the panel's systems; with ``faults`` some are broken."""
    p = panel(spark, sf_dir).select("user_id", F.col("event_type").alias("system_id"), "a")
    w = Window.partitionBy("user_id").orderBy("system_id")  # a record has five systems
    p = p.withColumn("candidate_id", F.chr(F.lit(64) + F.row_number().over(w)))
    x = F.least(F.lit(10.0), F.floor(F.col("a") / 5) / 2)
    quarter = F.when(x < 10, 0.25).otherwise(-0.25)  # off the steps, not out of the range as well
    off = F.when(F.lit(faults) & (F.col("user_id") % 5 == 1) & (F.col("candidate_id") == "B"), quarter).otherwise(0.0)
    scores = F.create_map(F.lit("form"), x + off, F.lit("sense"), F.lit(10.0) - x)
    reasons = F.create_map(F.lit("form"), F.when(F.lit(faults) & (F.col("user_id") % 5 == 2), " ").otherwise("good"), F.lit("sense"), F.lit("fine"))
    one = F.struct("candidate_id", scores.alias("scores"), reasons.alias("reasons"), F.lit(0.0).alias("average_score"), F.array(F.lit("none")).alias("major_errors"))
    rows = p.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", "system_id"))).alias("m"), F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("k"), "candidate_id"))).alias("rank"), F.collect_list(one).alias("c")
    )
    ranking = F.transform("rank", lambda r: r["candidate_id"])
    ranking = F.when(F.lit(faults) & (F.col("user_id") % 5 == 3), F.concat(F.slice(ranking, 1, 4), F.slice(ranking, 1, 1))).otherwise(ranking)
    body = F.to_json(F.struct(F.array_sort("c", lambda a, b: F.when(a["candidate_id"] < b["candidate_id"], -1).otherwise(1)).alias("candidate_scores"), ranking.alias("ranking"), F.lit("because").alias("ranking_reason")))
    fenced = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    raw = F.when(F.lit(faults) & (F.col("user_id") % 5 == 4), F.concat(F.lit("Here it is: "), fenced)).otherwise(fenced)
    return rows.select("user_id", F.transform("m", lambda x: x["candidate_id"]).alias("expected"), F.col("m").alias("mapping"), raw.alias("raw"))
