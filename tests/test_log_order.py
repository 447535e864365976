"""Queries over cell means against their SQL, where the log's rows lie in many files and means stand at the steps of a floor."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pairwright import catalog

TYPES = ["click", "error", "purchase", "signup", "view"]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """120 users; means are whole multiples of five by exact numbers, some with 0.05 more, and 100 to 120 for every tenth user."""
    rng, rows = random.Random(4), []
    for u in range(120):
        for t in TYPES:
            n = rng.randrange(3, 12)
            while True:
                cents = [rng.randrange(1, 9000) + (5000 if u % 10 == 1 else 0) for _ in range(n - 1)]
                goal = 100 * n * 5 * rng.randrange(20 if u % 10 == 1 else 1, 24 if u % 10 == 1 else 18)
                goal += 5 * n * (u % 2 and t in ("click", "purchase"))  # differences at the half of a decimal
                if 0 < goal - sum(cents) < 30000:
                    break
            rows += [(u, t, c / 100) for c in (*cents, goal - sum(cents))]
    rng.shuffle(rows)
    rows = [(k, *r) for k, r in enumerate(rows)]
    folder = tmp_path_factory.mktemp("log")
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("props", F.lit('{"k": 3}'))
    df.repartition(7, F.hash("event_id")).write.parquet(f"{folder}/events.parquet")
    sql = duckdb.connect(config={"threads": 1})
    sql.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet') ORDER BY event_id")
    return str(folder), sql


@pytest.mark.parametrize("name", ["i_wilcoxon_pratt", "q_judge_json", "v_judge_explode", "w_average_rank", "w_extremes", "w_holm", "w_holm_declared"])
def test_equals_sql_at_the_steps(spark, log, name):
    folder, sql = log
    df = catalog.queries()[name](spark, folder)
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.fixture(scope="module")
def odd_ids(spark, tmp_path_factory):
    """60 users whose values are quarters, so that sums are exact in any order; ids stand for two rows, or for none."""
    rng = random.Random(9)
    rows = [(None if u % 10 == 7 else k // 2, u, t, rng.randrange(4, 500) / 4) for u in range(60) for t in TYPES for k in range(4 + u % 3)]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("odd_ids")
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("props", F.lit('{"k": 3}'))
    df.repartition(5).write.parquet(f"{folder}/events.parquet")
    sql = duckdb.connect(config={"threads": 1})
    sql.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return str(folder), sql


@pytest.mark.parametrize("name", ["v_judge_explode", "w_average_rank", "w_extremes", "w_holm", "w_holm_declared"])
def test_cells_are_whole_where_ids_repeat(spark, odd_ids, name):
    folder, sql = odd_ids
    df = catalog.queries()[name](spark, folder)
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.fixture(scope="module")
def odd_values(spark, tmp_path_factory):
    """40 users; some cells hold NaN, an infinity, values beyond a long or less than nothing, or no value at all."""
    rng = random.Random(1)
    rows = [(k, u, t, rng.randrange(1, 9000) / 100) for k, (u, t) in enumerate((u, t) for u in range(40) for t in TYPES for _ in range(3))]
    odd = {(4, "view"): None, (5, "click"): float("nan"), (6, "click"): float("inf"), (7, "click"): -12.5, (8, "error"): 1e30, (10, "error"): -1e300}
    rows = [(k, u, t, None if u == 3 else float("nan") if u == 12 else odd.get((u, t), v)) for k, u, t, v in rows]
    folder = tmp_path_factory.mktemp("odd_values")
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("props", F.lit('{"k": 3}'))
    df.repartition(5).write.parquet(f"{folder}/events.parquet")
    sql = duckdb.connect(config={"threads": 1})
    sql.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet') ORDER BY event_id")
    return str(folder), sql


@pytest.mark.parametrize("name", ["w_average_rank", "w_extremes", "w_holm", "w_holm_declared"])
def test_equals_sql_on_odd_values(spark, odd_values, name):
    folder, sql = odd_values
    df = catalog.queries()[name](spark, folder)
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def written_log(spark, folder, cells):
    """A log of (user_id, event_type, value), shuffled, and DuckDB on one thread over it."""
    rows = [(k, *r) for k, r in enumerate(random.Random(2).sample(cells, len(cells)))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("props", F.lit('{"k": 3}'))
    df.repartition(3).write.parquet(f"{folder}/events.parquet")
    sql = duckdb.connect(config={"threads": 1})
    sql.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet') ORDER BY event_id")
    return sql


def small_logs():
    """Rows without a user, with users or alone; p-values at the half of the last decimal, from single values and from cells of 64 rows."""
    rng = random.Random(5)
    cells = lambda users, n, value: [(u, t, value()) for u in users for t in TYPES for _ in range(n)]
    cents = lambda: rng.randrange(9000) / 100
    return {
        "null user": cells([None, *range(40)], 5, cents),
        "null user alone": cells([None], 5, cents),
        "ties": cells(range(100), 1, lambda: (2 * rng.randrange(2_000_000) + 1) * 2.5e-7),
        "ties above one": cells(range(100), 1, lambda: rng.randrange(50) + (2 * rng.randrange(2_000_000) + 1) * 2.5e-7),
        "cells of 64": cells(range(60), 64, lambda: rng.randrange(100) / 100),
    }


@pytest.mark.parametrize("case", sorted(small_logs()))
@pytest.mark.parametrize("name", ["w_holm", "w_holm_declared"])
def test_p_values_equal_sql(spark, tmp_path, name, case):
    sql = written_log(spark, tmp_path, small_logs()[case])
    df = catalog.queries()[name](spark, str(tmp_path))
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["v_pair_pivot", "j12_joined_whole"])
def test_results_are_rounded_as_by_sql(spark, tmp_path, name):
    rng = random.Random(6)
    sql = written_log(spark, tmp_path, [(u, t, (2 * rng.randrange(2_000_000) + 1) * 0.5e-8) for u in range(60) for t in TYPES] + [(60, t, 1e301) for t in TYPES])
    df = catalog.queries()[name](spark, str(tmp_path))
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(df.collect())) == sorted(tuple(r[k] for k in at) for r in want.fetchall())
