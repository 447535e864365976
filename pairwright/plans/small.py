"""Queries of joins, labels, layouts, gates and requests, each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import gates, judge, latest, pairs, registry, stages, summary
from ..sources import files
from ..sources.staging import shared_path
from . import inputs as i
from .inputs import ATT, PANEL, RATE, rounded
from .queries import query

SYSTEMS = registry.Registry(
    [
        registry.System("view", "View (plain)", "m1", "plain", "one"), registry.System("click", "Click (thinking)", "m1", "thinking", "one"),
        registry.System("signup", "Signup (plain)", "m2", "plain", "two"), registry.System("purchase", "Purchase (thinking)", "m2", "thinking", "two"), registry.System("error", "Error", "m3", "plain", "three"),
    ],
    {"paired": ["view", "click", "signup", "purchase"]},
)
_SYSTEMS = "sys(system_id, place, name, family) AS (VALUES ('view', 0, 'View (plain)', 'one'), ('click', 1, 'Click (thinking)', 'one'), ('signup', 2, 'Signup (plain)', 'two'), ('purchase', 3, 'Purchase (thinking)', 'two'), ('error', 4, 'Error', 'three'))"


@query(f"WITH {PANEL}, c AS (SELECT * FROM panel WHERE user_id % 3 <> 0) SELECT p.user_id, p.event_type, round(c.b, 8) AS composite FROM panel p LEFT JOIN c USING (user_id, event_type)")
def j11_with_composites(spark, d):
    p = i.panel(spark, d)
    return rounded(latest.with_values(p.select("user_id", "event_type"), p.where("user_id % 3 <> 0").select("user_id", "event_type", F.col("b").alias("composite")), ["user_id", "event_type"]))


@query(f"WITH {PANEL} SELECT user_id, event_type, round(a, 8) AS a, n::BIGINT AS n FROM panel JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)")
def j12_joined_whole(spark, d):
    sizes = i.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(latest.joined_whole(i.panel(spark, d).select("user_id", "event_type", "a"), sizes, ["user_id"]))


@query("""WITH c(doc_id) AS (VALUES (1::BIGINT), (5), (987654321)) SELECT doc_id, coalesce('{"lang":"' || lang || '","source":"' || source || '"}', '{}') AS manifest, coalesce('{"quality":' || quality || '}', '{}') AS label FROM c LEFT JOIN documents USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def j19_case_lookups(spark, d):
    cases = spark.createDataFrame([(1,), (5,), (987654321,)], "doc_id long")
    labels = i.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return latest.looked_up(cases, {"manifest": i.table(spark, d, "documents").select("doc_id", "lang", "source"), "label": labels}, "doc_id")


@query(f"WITH {PANEL}, {_SYSTEMS}, m AS (SELECT event_type, avg(a) AS a FROM panel GROUP BY event_type) SELECT (row_number() OVER (ORDER BY place) - 1)::BIGINT AS line, event_type, name, family, round(a, 8) AS a FROM m JOIN sys ON system_id = event_type")
def w_ordered_output(spark, d):
    m = i.panel(spark, d).groupBy("event_type").agg(F.avg("a").alias("a"))
    own = m.join(F.broadcast(SYSTEMS.table(spark)), m["event_type"] == F.col("system_id"))
    lines = registry.in_order(own, "event_type", SYSTEMS.expand(["all"])).coalesce(1)  # a row per system
    return rounded(lines.select(F.monotonically_increasing_id().alias("line"), "event_type", "name", "family", "a"))


@query(f"WITH {_SYSTEMS} SELECT system_id, place, name, family FROM sys WHERE family <> 'three'")
def c_registry(spark, d):
    own = SYSTEMS.table(spark).where(F.col("system_id").isin(SYSTEMS.expand(["paired", "click"])))
    return own.select("system_id", "place", "name", "family")


@query("SELECT source, CASE source WHEN 'web' THEN 'The web' WHEN 'books' THEN 'Books' ELSE source END AS label, count(*) AS n FROM documents GROUP BY source")
def p_labels(spark, d):
    return i.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", registry.label(F.col("source"), {"web": "The web", "books": "Books"}).alias("label"), "n")


def _layers(spark, d):
    p = i.panel(spark, d).groupBy("event_type").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    one = lambda name, c: p.select(F.lit(name).alias("layer"), F.col("event_type").alias("family"), F.lit("score").alias("measure"), F.col(c).alias("least"))
    return one("human", "a"), one("judge", "b")


@query(f"WITH {PANEL} SELECT 'human' AS layer, event_type AS family, 'score' AS measure, round(avg(a), 8) AS least FROM panel GROUP BY event_type UNION ALL SELECT 'judge', event_type, 'score', round(avg(b), 8) FROM panel GROUP BY event_type")
def u_merged_layers(spark, d):
    human, own = _layers(spark, d)
    both, faults = gates.merged_layers({"human": human, "judge": own}, ["layer", "family", "measure"])
    gates.enforce(faults)
    return rounded(both)


@query(f"""WITH {PANEL}, n AS (SELECT count(DISTINCT event_type) AS n FROM panel)
SELECT 'empty_layer' AS "check", 0::BIGINT AS n UNION ALL SELECT 'several_layers', 1 UNION ALL SELECT 'no_layer', 0 UNION ALL SELECT 'human_wrong_layer', n FROM n UNION ALL SELECT 'human_duplicates', 0 UNION ALL SELECT 'judge_wrong_layer', 0 UNION ALL SELECT 'judge_duplicates', n FROM n UNION ALL SELECT 'duplicates_across_layers', n FROM n""")
def q_layers(spark, d):
    human, own = _layers(spark, d)
    mixed = human.unionByName(own)
    # The judge's file repeats its rows, and the human one holds the judge's.
    twice = own.unionByName(own)
    _, faults = gates.merged_layers({"human": own, "judge": twice}, ["layer", "family", "measure"])
    return gates.union(gates.one_layer(mixed), faults)


@query("SELECT conv_id, turn, 'm' AS model, 0.0::DOUBLE AS temperature, 'disabled' AS thinking, 'high' AS effort, 'json_object' AS format, text AS asked FROM conversations WHERE role = 'user'")
def s_judge_requests(spark, d):
    own = i.table(spark, d, "conversations").where("role = 'user'")
    own = own.withColumns({k: judge.request(F.col("text"), "m", k) for k in judge.SERVICES})
    get = F.get_json_object
    return own.select(
        "conv_id", "turn", get("plain", "$.model").alias("model"), get("plain", "$.temperature").cast("double").alias("temperature"), get("plain", "$.thinking.type").alias("thinking"),
        get("reasoning", "$.reasoning_effort").alias("effort"), get("reasoning", "$.response_format.type").alias("format"), get("reasoning", "$.messages[0].content").alias("asked"),
    )


@query(f"WITH {PANEL} SELECT user_id, 'ok' AS status, count(*)::INT AS n_candidates FROM panel WHERE user_id % 5 <> 4 AND user_id % 4 <> 1 GROUP BY user_id UNION ALL SELECT user_id, 'invalid', 0 FROM panel WHERE user_id % 5 = 4 AND user_id % 4 <> 1 GROUP BY user_id")
def s_judge_run(spark, d):
    """Judges what a log hasn't; answers that hold more than JSON are kept as invalid."""
    a = i.answers(spark, d, faults=True)
    done = a.where("user_id % 4 = 1").select("user_id", F.lit("ok").alias("status"))
    out = judge.run(a.select("user_id", "expected"), "user_id", lambda work: work.join(a.select("user_id", "raw"), "user_id"), done)
    return out.select("user_id", "status", F.when(F.col("status") == "ok", F.size("answer.candidate_scores")).otherwise(0).alias("n_candidates"))


@query(f"""WITH {ATT} SELECT seq, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN k / 2.0::DOUBLE END AS number, system_id || ';' AS listed, 'http://h/v1/chat' AS url, CASE WHEN system_id = 'error' THEN -latency_seconds ELSE latency_seconds END AS oriented FROM att""")
def p_scalars(spark, d):
    """Numbers out of texts, lists out of settings, addresses, and differences in which more is better."""
    a = i.attempts(spark, d)
    raw = F.when(F.col("k") % 3 == 0, F.lit("nan")).when(F.col("k") % 3 == 1, (F.col("k") / 2).cast("string")).otherwise("none")
    metric = F.when(F.col("system_id") == "error", F.lit("ter_line")).otherwise("chrf")
    listed = F.concat(F.element_at(t.env_list(F.concat_ws(";", F.lit(" "), F.col("system_id"), F.lit(","))), 1), F.lit(";"))
    return a.select("seq", t.finite_or_null(raw).alias("number"), listed.alias("listed"), t.endpoint(F.lit("http://h/v1/"), "/chat").alias("url"), t.oriented_delta(metric, F.col("latency_seconds")).alias("oriented"))


@query("""SELECT conv_id, turn, 'be brief' || chr(10) || chr(10) || 'be kind' AS system, 2 AS n_messages, 'user' AS last_role, coalesce(text, '') AS content, coalesce(text, '') || 'end' AS block_text, 'first' || chr(10) || 'then' AS thinking FROM conversations""")
def p_chat_parts(spark, d):
    """System parts apart from the others, and a service's content blocks as text and thinking."""
    own = i.table(spark, d, "conversations").withColumn("x", t.text(F.col("text")))
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.array(said("system", F.lit("be brief")), said("assistant", F.col("x")), said("system", F.lit("be kind")), said("tool", F.col("x")))
    kinds = [("text", F.col("x")), ("thinking", F.lit("first")), ("text", F.lit("end")), ("thinking", F.lit("then"))]
    blocks = F.to_json(F.array(*[F.struct(F.lit(k).alias("type"), (c if k == "text" else F.lit(None).cast("string")).alias("text"), (c if k == "thinking" else F.lit(None).cast("string")).alias("thinking")) for k, c in kinds]))
    parts, cut = judge.split_system(chat), judge.content_blocks(blocks)
    own = own.withColumns({"p": parts, "c": cut})
    return own.select("conv_id", "turn", "p.system", F.size("p.messages").alias("n_messages"), F.element_at("p.messages", -1)["role"].alias("last_role"), F.element_at("p.messages", -1)["content"].alias("content"), F.col("c.text").alias("block_text"), "c.thinking")


@query(f"WITH {PANEL} SELECT user_id AS record_id, string_agg(event_type, ',' ORDER BY event_type) AS systems, CASE WHEN user_id % 2 = 0 THEN 'own' ELSE 'private' END AS whose FROM panel GROUP BY user_id")
def j8_private_mapping(spark, d):
    """An answer's own mapping of candidates, or else the private one of its record."""
    a = i.answers(spark, d).select(F.col("user_id").alias("record_id"), "mapping")
    own = a.select("record_id", F.when(F.col("record_id") % 2 == 0, F.transform("mapping", lambda m: F.struct(m["candidate_id"].alias("c"), m["system_id"].alias("s"), F.lit("own").alias("w")))).alias("candidate_map"))
    private = a.select("record_id", F.transform("mapping", lambda m: F.struct(m["candidate_id"].alias("c"), m["system_id"].alias("s"), F.lit("private").alias("w"))).alias("candidate_map"))
    out = stages.with_mapping(own, private)
    return out.select("record_id", F.array_join(F.array_sort(F.transform("candidate_map", lambda m: m["s"])), ",").alias("systems"), F.element_at("candidate_map", 1)["w"].alias("whose"))


@query(f"WITH {PANEL} SELECT user_id, event_type, round(a, 6) AS a FROM panel")
def s_csv_scan(spark, d):
    """A panel written as CSV and read again with its types."""
    path = f"{shared_path(spark, 'csv')}.csv"
    files.write_csv(rounded(i.panel(spark, d).select("user_id", "event_type", "a"), 6), path)
    return files.read_rows(spark, path, "user_id long, event_type string, a double")


@query(f"WITH {RATE} SELECT item, rater, dim, score FROM rate")
def s_jsonl_scan(spark, d):
    """Ratings written as JSON lines and read again with their types."""
    path = shared_path(spark, "jsonl")
    files.write_jsonl(i.ratings(spark, d).select("item", "rater", "dim", "score"), path)
    return files.read_jsonl(spark, path, "item long, rater long, dim string, score long", missing_ok=False)


_CONFIG = {"seed": 7, "systems": [{"id": "one", "shards": 24, "tags": ["a", "b"]}, {"id": "two", "shards": 3, "tags": []}]}


@query("""SELECT * FROM (VALUES (7::BIGINT, 'one', 24::BIGINT, 2), (7, 'two', 3, 0)) t(seed, id, shards, n_tags)""")
def s_config(spark, d):
    """A nested configuration file, read and flattened."""
    path = f"{shared_path(spark, 'config')}-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(_CONFIG, indent=1),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    own = files.read_config(spark, path)
    return own.select("seed", F.explode("systems").alias("s")).select("seed", "s.id", "s.shards", F.size("s.tags").alias("n_tags"))


@query(f"WITH {ATT}, m AS (SELECT DISTINCT record_id FROM att ORDER BY record_id LIMIT 7) SELECT system_id, record_id, seq FROM latest WHERE record_id IN (SELECT record_id FROM m) AND status = 'ok' AND trim(output_text) <> ''")
def s_head_outputs(spark, d):
    a = i.attempts(spark, d)
    ok = (F.col("status") == "ok") & (F.trim("output_text") != "")
    return latest.head_outputs(a.select("record_id").distinct(), a, "record_id", "record_id", 7, ok).select("system_id", "record_id", "seq")


@query(f"WITH {PANEL} SELECT user_id, event_type, round(a, 8) AS human, round(b, 8) AS judge FROM panel WHERE user_id % 4 <> 0 AND user_id % 5 <> 0")
def j10_one_to_one(spark, d):
    p = i.panel(spark, d)
    human, own = p.where("user_id % 4 <> 0").select("user_id", "event_type", F.col("a").alias("human")), p.where("user_id % 5 <> 0").select("user_id", "event_type", F.col("b").alias("judge"))
    return rounded(latest.joined_one_to_one(human, own, ["user_id", "event_type"]))


@query(f"""WITH {PANEL}, prs AS (SELECT x.user_id % 7 AS g, x.a AS x, CASE WHEN x.user_id % 7 < 2 THEN x.a + x.user_id % 7 ELSE y.a END AS y FROM panel x JOIN panel y ON x.user_id = y.user_id AND x.event_type = 'view' AND y.event_type = 'click')
SELECT g, count(*) AS n, round(CASE WHEN stddev_samp(round(y - x, 9)) > 0 THEN avg(round(y - x, 9)) / stddev_samp(round(y - x, 9)) ELSE 0 END, 8) AS dz FROM prs GROUP BY g""")
def i_dz_zero(spark, d):
    p = pairs.paired(i.panel(spark, d), "user_id", "event_type", "a", "view", "click").withColumn("g", F.col("user_id") % 7)
    y = F.when(F.col("g") < 2, F.col("x") + F.col("g")).otherwise(F.col("y"))
    whole = p.select("g", F.lit(0.0).alias("x"), F.round(y - F.col("x"), 9).alias("y"))
    return rounded(pairs.effects(whole, ["g"], zero_variance=0.0).select("g", "n", "dz"))


@query(f"WITH {RATE} SELECT item, count(score) AS cells, round(avg(score), 8) AS mean FROM rate GROUP BY item")
def a_cell_means(spark, d):
    return rounded(summary.cell_means(i.ratings(spark, d), ["item"], "score"))


@query(f"WITH {ATT}, t(system_id, target) AS (VALUES ('view', 1), ('click', 1000000), ('none', 1)), c AS (SELECT system_id, count(*) FILTER (status = 'ok') AS o, count(*) FILTER (status <> 'ok') AS f FROM latest GROUP BY system_id) SELECT system_id, target, coalesce(o, 0) AS ok_count, coalesce(f, 0) AS failed_count, coalesce(o, 0) >= target AS reached FROM t LEFT JOIN c USING (system_id)")
def a_against_targets(spark, d):
    rows = latest.latest_wins(i.attempts(spark, d), ["system_id", "record_id"], "seq")
    targets = spark.createDataFrame([("view", 1), ("click", 1_000_000), ("none", 1)], "system_id string, target int")
    return summary.against_targets(rows, targets, "system_id", F.col("status") == "ok")


_STAT = "round(avg(x), 8) AS {p}mean, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE stddev_samp(x) END, 8) AS {p}sd, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE 1.96 * stddev_samp(x) / sqrt(count(x)) END, 8) AS {p}ci95"


@query(f"""WITH {ATT}, x AS (SELECT *, record_id % 3 AS source, CASE WHEN status = 'ok' AND trim(output_text) <> '' THEN k::DOUBLE END AS x FROM latest),
s AS (SELECT source, system_id, count(*) AS n_total, count(*) FILTER (status = 'ok' AND trim(output_text) <> '') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed,
  coalesce(string_agg(DISTINCT nullif(prompt_version, ''), ';' ORDER BY nullif(prompt_version, '')), '') AS prompt_version, round(sum(latency_seconds), 8) AS runtime_seconds_total, {_STAT.format(p='k_')}, min_by(error, seq) FILTER (status <> 'ok') AS fe FROM x GROUP BY source, system_id)
SELECT * EXCLUDE fe, CASE WHEN n_ok > 0 THEN 'ok' ELSE 'not_available_or_failed' END AS status, CASE WHEN n_ok > 0 THEN '' ELSE coalesce(fe, '') END AS metric_errors,
  round(CASE WHEN n_ok > 0 THEN 10.0::DOUBLE / (SELECT count(*) FROM (SELECT system_id FROM s GROUP BY system_id HAVING sum(n_ok) > 0)) * n_ok / sum(n_ok) OVER (PARTITION BY system_id) ELSE 0 END, 8) AS scoring_seconds FROM s""")
def a_source_metrics(spark, d):
    rows = latest.latest_wins(i.attempts(spark, d), ["system_id", "record_id"], "seq").withColumn("source", F.col("record_id") % 3)
    return rounded(summary.source_metrics(rows, "source", "system_id", ["k"], 10.0))


@query("SELECT shard, count(*) AS n, max(doc_id) AS last FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)) GROUP BY shard")
def w_limit_before_shards(spark, d):
    rows = latest.head(i.table(spark, d, "documents").select("doc_id"), "doc_id", 50)
    return latest.shard(rows, "doc_id", 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


@query(f"WITH {RATE} SELECT dim, item, string_agg(coalesce(score::VARCHAR, '-'), ',' ORDER BY r) AS scores FROM (SELECT * FROM (SELECT DISTINCT dim, item FROM rate), range(1, 9) t(r)) LEFT JOIN (SELECT dim, item, rater AS r, score FROM rate) q USING (dim, item, r) GROUP BY dim, item")
def v_item_rater(spark, d):
    m = summary.matrix(i.ratings(spark, d), ["dim", "item"], "rater", "score", list(range(1, 9)))
    return m.select("dim", "item", F.array_join(F.transform("scores", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("scores"))


@query("SELECT doc_id, CASE WHEN coalesce(x, '') <> '' THEN x ELSE coalesce(text, '') END AS chosen FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' END AS x FROM documents)")
def p_aliases(spark, d):
    x = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " ")
    return i.table(spark, d, "documents").select("doc_id", t.first_filled(x, F.col("text")).alias("chosen"))


@query(f"WITH {PANEL}, n AS (SELECT count(DISTINCT user_id) FILTER (user_id % 5 IN (3, 4)) AS r, count(DISTINCT user_id) FILTER (user_id % 5 = 4) AS c FROM panel) SELECT 'ranking_differs' AS \"check\", r AS n FROM n UNION ALL SELECT 'candidates_differ', c FROM n")
def q_ranking(spark, d):
    a = i.answers(spark, d, faults=True).withColumnRenamed("user_id", "record_id")
    mapping = a.select("record_id", F.explode("mapping").alias("m")).select("record_id", "m.candidate_id")
    return stages.ranking_faults(judge.parse(a, "raw").select("record_id", "answer"), mapping)


@query("SELECT 'k_boolean' AS \"check\", count(*) FILTER (event_id % 6 = 0) AS n FROM events UNION ALL SELECT 'k_quoted', count(*) FILTER (event_id % 6 = 1) FROM events UNION ALL SELECT 'tokens_not_finite', count(*) FILTER (event_id % 6 IN (0, 1)) FROM events UNION ALL SELECT 'missing_columns', 1")
def q_resource_fields(spark, d):
    """Token fields as services give them: booleans and quoted numbers aren't numbers."""
    e = i.table(spark, d, "events")
    rows = e.select(F.when(F.col("event_id") % 6 == 0, "true").when(F.col("event_id") % 6 == 1, '"12"').otherwise("12").alias("k"))
    number = rows.select(F.when(F.col("k").rlike(r"^-?[0-9.]+$"), F.col("k").cast("double")).alias("tokens"))
    return gates.union(gates.numeric_kinds(rows, "k"), gates.row_checks(number, {"tokens_not_finite": gates.finite("tokens")}), gates.missing_columns(rows, ["k", "usage"]))
