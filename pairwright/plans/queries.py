"""The engine's queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ngram, report, ter
from ..functions import text as t
from ..functions.tails import signed_rank_p, signed_rank_p_sql
from ..operators import gates, judge, latest, models, pairs, providers, resample, sampling, scoring, stages, summary
from ..sources.staging import shared_path
from . import inputs as i
from .inputs import ATT, DIMS, PAIR, PANEL, RATE, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FAMILIES = {"one": ("view", "click"), "two": ("signup", "purchase")}
FAMILY_SQL = "fam(family, sx, sy) AS (VALUES ('one', 'view', 'click'), ('two', 'signup', 'purchase'))"
PAIRED_SQL = f"""{PANEL}, {FAMILY_SQL}, prs AS (SELECT family, x.user_id, x.a AS x, y.a AS y FROM fam JOIN panel x ON x.event_type = sx JOIN panel y ON y.event_type = sy AND y.user_id = x.user_id)"""
#: A trim of what counts as white space, for RE2.
_SP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
_LINES = r"list_filter(list_transform(regexp_split_to_array({c}, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{sp}+|{sp}+$', '', 'g')), lambda x: x <> '')"
_HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
SEED = 20260706


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def lines_sql(c: str) -> str:
    return _LINES.format(c=c, sp=_SP)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- logs ------------------------------------------------------------------------------------


@query(f"WITH {ATT} SELECT system_id, record_id, seq, status, latency_seconds FROM latest")
def j1_latest_wins(spark, d):
    return latest.latest_wins(i.attempts(spark, d).select("system_id", "record_id", "seq", "status", "latency_seconds"), ["system_id", "record_id"], "seq")


@query(f"WITH {ATT} SELECT system_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM latest WHERE record_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY system_id")
def j2_semi_manifest(spark, d):
    rows = latest.latest_wins(i.attempts(spark, d), ["system_id", "record_id"], "seq")
    manifest = i.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("record_id"))
    return latest.in_manifest(rows, manifest, "record_id").groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query(f"WITH {ATT} SELECT system_id, record_id, source, lang, status FROM latest JOIN documents ON record_id = doc_id")
def j3_enrich(spark, d):
    rows = latest.latest_wins(i.attempts(spark, d), ["system_id", "record_id"], "seq")
    manifest = i.table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "source", "lang")
    return latest.enrich(rows, manifest, "record_id").select("system_id", "record_id", "source", "lang", "status")


@query(f"""WITH {ATT}, work AS (SELECT DISTINCT a.system_id, b.record_id FROM att a, att b)
SELECT system_id, record_id FROM work ANTI JOIN (SELECT * FROM att WHERE status = 'ok' AND seq % 2 = 0) d USING (system_id, record_id)""")
def j4_resume_anti(spark, d):
    a = i.attempts(spark, d)
    work = a.select("record_id").distinct().join(F.broadcast(a.select("system_id").distinct()), how="cross")  # a few systems
    return latest.remaining(work.select("system_id", "record_id"), a.where("seq % 2 = 0"), ["system_id", "record_id"], retry_failed=True)


@query(f"""WITH {ATT}, grid AS (SELECT DISTINCT a.system_id, b.record_id FROM att a, att b)
SELECT g.system_id, count(*) FILTER (coalesce(l.status = 'ok' AND trim(output_text) <> '', false)) AS matched, count(*) FILTER (NOT coalesce(l.status = 'ok' AND trim(output_text) <> '', false)) AS missing
FROM grid g LEFT JOIN latest l USING (system_id, record_id) GROUP BY g.system_id""")
def j6_candidates(spark, d):
    a = i.attempts(spark, d)
    rows = latest.latest_wins(a, ["system_id", "record_id"], "seq")
    out = judge.candidates(a.select("record_id").distinct(), a.select("system_id").distinct(), rows, "record_id", "system_id")
    return out.groupBy("system_id").agg(F.count(F.when(F.col("matched"), 1)).alias("matched"), F.count(F.when(~F.col("matched"), 1)).alias("missing"))


# -- text ------------------------------------------------------------------------------------


@query(f"""WITH {PAIR} SELECT conv_id, turn, abs(len({lines_sql('h')}) - len({lines_sql('r')}))::INT AS line_count_diff,
  round(CASE WHEN length({strip_sql('r')}) = 0 THEN 0 ELSE length({strip_sql('h')})::DOUBLE / length({strip_sql('r')}) END, 8) AS length_ratio,
  round(coalesce(len(regexp_extract_all(h, '[A-Za-z]'))::DOUBLE / nullif(len(regexp_extract_all(h, '[A-Za-z]')) + len(regexp_extract_all(h, '{_HAN}')), 0), 0), 8) AS english_ratio, ({strip_sql('h')} = '')::INT AS empty_output,
  round(abs(CASE WHEN length({strip_sql('r')}) = 0 THEN 0 ELSE length({strip_sql('h')})::DOUBLE / length({strip_sql('r')}) END - 1), 8) AS length_deviation FROM pair""")
def p_form_diagnostics(spark, d):
    h, r = F.col("h"), F.col("r")
    return rounded(i.pairs(spark, d).select("conv_id", "turn", t.line_count_difference(h, r).alias("line_count_diff"), t.length_ratio(h, r).alias("length_ratio"), t.english_ratio(h).cast("double").alias("english_ratio"), t.empty_output(h).alias("empty_output"), F.abs(t.length_ratio(h, r) - 1).alias("length_deviation")))


_ELIGIBLE = [("zh-en", "诗歌", "a poem", ""), ("zh-en", "诗歌", "诗 poem", ""), ("en-zh", "诗歌", "a poem", ""), ("zh-en", "  ", "a poem", ""), ("zh-en", "風", "wind", '["ocr", ""]'), ("zh-en", "雨", "rain", "ocr"), ("zh-en", "雪", " ", "[]"), ("zh-en", "月", "moon", "[]")]


@query(r"""WITH lit(language_pair, src, ref, flags) AS (VALUES ('zh-en', '诗歌', 'a poem', ''), ('zh-en', '诗歌', '诗 poem', ''), ('en-zh', '诗歌', 'a poem', ''), ('zh-en', '  ', 'a poem', ''), ('zh-en', '風', 'wind', '["ocr", ""]'), ('zh-en', '雨', 'rain', 'ocr'), ('zh-en', '雪', ' ', '[]'), ('zh-en', '月', 'moon', '[]')),
x AS (SELECT language_pair = 'zh-en' AND trim(src) <> '' AND trim(ref) <> '' AND regexp_matches(src, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AND NOT regexp_matches(ref, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AS ok, flags IN ('', '[]') AS clean FROM lit)
SELECT 'literals' AS source, count(*) AS n, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND clean) AS clean FROM x
UNION ALL SELECT source, count(*), count(*) FILTER (regexp_matches(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')), 0 FROM documents GROUP BY source""")
def p_eligibility(spark, d):
    lit = spark.createDataFrame(_ELIGIBLE, "language_pair string, src string, ref string, flags string").withColumn("source", F.lit("literals"))
    docs = i.table(spark, d, "documents").select(F.lit("zh-en").alias("language_pair"), F.col("text").alias("src"), F.lit("x").alias("ref"), F.lit("x").alias("flags"), "source")
    ok = t.eligible(F.col("language_pair"), F.col("src"), F.col("ref"))
    count = lambda c: F.count(F.when(c, 1))
    return lit.unionByName(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), count(ok).alias("eligible"), count(ok & (F.size(t.flag_list(F.col("flags"))) == 0)).alias("clean"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z'']+'))::INT AS n_words FROM documents")
def p_word_count(spark, d):
    return i.table(spark, d, "documents").select("doc_id", t.count_words(F.col("text")).alias("n_words"))


@query(r"""WITH lit(x) AS (VALUES ('Internal  workflow first'), ('line' || chr(10) || '## My Translation'), ('modernity and' || chr(10) || 'poeticity'), ('Modernity, then poeticity'), ('before translating it'), ('a plain poem'), ('final English poem')),
u AS (SELECT 'literals' AS source, x FROM lit UNION ALL SELECT source, text FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(x, '(?im)internal\s+(understanding|workflow)|understanding\s+workflow|\btranslation\s+planning\b|\bthought\s+and\s+emotion\b|\bmodernity\b.*\bpoeticity\b|^\s*#{1,6}\s+.*(content|expression|translation|workflow)|\bI''ll\s+work\s+through\b|\bI\s+will\s+work\s+through\b|\bbefore\s+translat(?:ing|e)\b|\bfinal\s+english\s+poem\b')) AS contaminated FROM u GROUP BY source""")
def p_contamination(spark, d):
    lit = [("Internal  workflow first",), ("line\n## My Translation",), ("modernity and\npoeticity",), ("Modernity, then poeticity",), ("before translating it",), ("a plain poem",), ("final English poem",)]
    both = spark.createDataFrame(lit, "x string").withColumn("source", F.lit("literals")).unionByName(i.table(spark, d, "documents").select(F.col("text").alias("x"), "source"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(t.contaminated(F.col("x")), 1)).alias("contaminated"))


@query("SELECT doc_id, ('0x' || substr(sha256('20260513:' || doc_id), 1, 15))::BIGINT AS seed FROM documents")
def p_stable_seed(spark, d):
    return i.table(spark, d, "documents").select("doc_id", t.hash_rank_key(20260513, F.col("doc_id")).alias("seed"))


@query(f"""WITH {PAIR}, x AS (SELECT conv_id, turn, {lines_sql('h')} AS hs, {lines_sql('r')} AS rs FROM pair)
SELECT conv_id, turn, (k - 1)::INT AS line, coalesce(hs[k], '') AS h, coalesce(rs[k], '') AS r FROM x, unnest(range(1, greatest(len(hs), len(rs)) + 1)) u(k)""")
def p_line_pairs(spark, d):
    own = i.pairs(spark, d).select("conv_id", "turn", F.posexplode(t.line_pairs(F.col("h"), F.col("r"))).alias("line", "x"))
    return own.select("conv_id", "turn", "line", "x.h", "x.r")


@query("""SELECT event_type, count(*) AS n, round(avg(regexp_extract(props, '"k": ?(-?[0-9]+)', 1)::DOUBLE), 8) AS k_mean FROM events GROUP BY event_type""")
def p_token_json(spark, d):
    return rounded(i.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(judge.token_number(F.col("props"), "k")).alias("k_mean")))


@query("""WITH x(n, status, body) AS (VALUES (1, 429, 'slow down'), (2, 402, 'Insufficient Balance'), (3, 503, 'quota is used up'), (4, 200, ''), (5, 500, NULL))
SELECT n, status IN (408, 409, 425, 429, 500, 502, 503, 504) AND NOT regexp_matches(lower(coalesce(body, '')), 'insufficient|balance|quota|arrears') AS retryable FROM x""")
def p_retryable(spark, d):
    x = spark.createDataFrame([(1, 429, "slow down"), (2, 402, "Insufficient Balance"), (3, 503, "quota is used up"), (4, 200, ""), (5, 500, None)], "n int, status int, body string")
    return x.select("n", t.retryable(F.col("status"), F.col("body")).alias("retryable"))


TEMPLATES = {"direct": ("Translate faithfully. Answer with the translation alone.", "Text:\n\n"), "plan": ("Think about the text first, then translate it. Answer with the translation alone.", "Text:\n\n")}


@query("""SELECT conv_id, turn, 2 AS n_messages, 'Text:' || chr(10) || chr(10) || trim(text) AS user_text, false AS leaks FROM conversations WHERE role = 'user'""")
def p_messages(spark, d):
    own = i.table(spark, d, "conversations").where("role = 'user'")
    version = F.when(F.col("turn") % 4 == 0, "direct").otherwise("plan")
    own = own.withColumn("m", judge.messages(F.col("text"), TEMPLATES, version))
    return own.select("conv_id", "turn", F.size("m").alias("n_messages"), F.element_at("m", 2)["content"].alias("user_text"), judge.leaks(F.col("m"), F.lit("no such text"), ["reference_en"]).alias("leaks"))


# -- similarity ------------------------------------------------------------------------------

_TOK = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace({c}, '-' || chr(10), ''), chr(10), ' ') || ' ', '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '')"""
_CHARS = r"list_filter(string_split(regexp_replace({c}, '\s+', '', 'g'), ''), lambda x: x <> '')"
_PU = r"[!-/:-@\[-`{{-~]"
_SPLIT = r"flatten(list_transform(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''), lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '" + _PU + r"$') THEN [left(w, -1), right(w, 1)] WHEN length(w) > 1 AND regexp_matches(w, '^" + _PU + r"') THEN [left(w, 1), w[2:]] ELSE [w] END))"


def _ngram_sql(units: list[tuple[str, str, int]], by: list[str], final: str) -> str:
    """Statistics by ``by`` (and per pair below it), then ``final`` over columns m_, h_, r_."""
    parts = []
    for side in ("h", "r"):
        for name, sql, n in units:
            parts.append(f"SELECT conv_id, turn, system, '{side}' AS side, '{name}' AS name, list_aggregate(u[p : p + {n - 1}], 'string_agg', chr(2)) AS gram FROM (SELECT conv_id, turn, system, {sql.format(c=side)} AS u FROM pair), unnest(range(1, len(u) - {n} + 2)) t(p)")
    cols = ", ".join(f"coalesce(sum(CASE WHEN name = '{n}' THEN least(hh, rr) END), 0) AS m_{n}, coalesce(sum(CASE WHEN name = '{n}' THEN hh END), 0) AS h_{n}, coalesce(sum(CASE WHEN name = '{n}' THEN rr END), 0) AS r_{n}" for n, _, _ in units)
    keys = ", ".join(by)
    return f"""WITH {PAIR}, g AS ({' UNION ALL '.join(parts)}),
c AS (SELECT conv_id, turn, system, name, gram, count(*) FILTER (side = 'h') AS hh, count(*) FILTER (side = 'r') AS rr FROM g GROUP BY ALL),
s0 AS (SELECT {keys}, {cols} FROM c GROUP BY {keys}),
s AS (SELECT * FROM (SELECT DISTINCT {keys} FROM pair) LEFT JOIN s0 USING ({keys}))
SELECT {keys}, {final} FROM s"""


def _bleu_sql(sentence: bool) -> str:
    names = ["w1", "w2", "w3", "w4"]
    z = [" + ".join(f"(m_{x} = 0 AND h_{x} > 0)::INT" for x in names[: k + 1]) for k in range(4)]
    logs = " + ".join(f"CASE WHEN {' AND '.join(f'h_{x} > 0' for x in names[: k + 1])} THEN ln(100 * CASE WHEN m_{n} = 0 THEN 1.0 / (pow(2.0, {z[k]}) * h_{n}) ELSE m_{n}::DOUBLE / h_{n} END) ELSE 0 END" for k, n in enumerate(names))
    order = "(CASE WHEN h_w1 = 0 THEN 0 WHEN h_w2 = 0 THEN 1 WHEN h_w3 = 0 THEN 2 WHEN h_w4 = 0 THEN 3 ELSE 4 END)"
    some = "greatest(m_w1, m_w2, m_w3, m_w4) > 0" + ("" if sentence else f" AND {order} = 4")
    return f"round(CASE WHEN {some} THEN CASE WHEN h_w1 >= r_w1 THEN 1 WHEN h_w1 > 0 THEN exp(1 - r_w1::DOUBLE / h_w1) ELSE 0 END * exp(({logs}) / {order}) ELSE 0 END, 8) AS bleu"


def _chrf_sql() -> str:
    n = list(ngram.CHRF_ORDERS)
    both = {k: f"(h_{k} > 0 AND r_{k} > 0)" for k in n}
    p, r = (" + ".join(f"CASE WHEN {both[k]} THEN m_{k}::DOUBLE / {s}_{k} ELSE 0 END" for k in n) for s in ("h", "r"))
    order = " + ".join(f"{both[k]}::INT" for k in n)
    p, r = f"(({p}) / nullif({order}, 0))", f"(({r}) / nullif({order}, 0))"
    return f"round(coalesce(100 * 5 * {p} * {r} / nullif(4 * {p} + {r}, 0), 0), 8) AS chrf"


_BLEU_UNITS = [(f"w{n}", _TOK, n) for n in range(1, 5)]
_CHRF_UNITS = [(f"c{n}", _CHARS, n) for n in range(1, 7)] + [(f"w{n}", _SPLIT, n) for n in range(1, 3)]
PAIR_KEYS = ["conv_id", "turn", "system"]


def _scored(spark, d, orders, formula, name, corpus):
    stats = ngram.statistics(i.pairs(spark, d), PAIR_KEYS, "h", "r", orders)
    stats = ngram.add_up(stats, ["system"], PAIR_KEYS) if corpus else stats
    return rounded(stats.select(*(["system"] if corpus else PAIR_KEYS), formula.alias(name)))


@query(_ngram_sql(_BLEU_UNITS, PAIR_KEYS, _bleu_sql(True)))
def t_bleu_sentence(spark, d):
    return _scored(spark, d, ngram.BLEU_ORDERS, ngram.bleu(True), "bleu", False)


@query(_ngram_sql(_BLEU_UNITS, ["system"], _bleu_sql(False)))
def t_bleu_corpus(spark, d):
    return _scored(spark, d, ngram.BLEU_ORDERS, ngram.bleu(False), "bleu", True)


@query(_ngram_sql(_CHRF_UNITS, PAIR_KEYS, _chrf_sql()))
def t_chrfpp_sentence(spark, d):
    return _scored(spark, d, ngram.CHRF_ORDERS, ngram.chrf(), "chrf", False)


@query(_ngram_sql(_CHRF_UNITS, ["system"], _chrf_sql()))
def t_chrfpp_corpus(spark, d):
    return _scored(spark, d, ngram.CHRF_ORDERS, ngram.chrf(), "chrf", True)


@query()
def t_ter_line(spark, d):
    e = ter.line_edits(i.pairs(spark, d), PAIR_KEYS, t.line_pairs(F.col("h"), F.col("r")))
    return rounded(e.select(*PAIR_KEYS, "edits", "ref_words", ter.ter(F.col("edits"), F.col("ref_words")).alias("ter")))


@query()
def t_ter_corpus(spark, d):
    e = ter.line_edits(i.pairs(spark, d), ["system"], t.line_pairs(F.col("h"), F.col("r")))
    return rounded(e.select("system", "edits", "ref_words", ter.ter(F.col("edits"), F.col("ref_words")).alias("ter")))


# -- summaries -------------------------------------------------------------------------------

_OK = "(status = 'ok' AND trim(output_text) <> '')"
_STAT = "round(avg(x), 8) AS {p}mean, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE stddev_samp(x) END, 8) AS {p}sd, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE 1.96 * stddev_samp(x) / sqrt(count(x)) END, 8) AS {p}ci95"


@query(f"""WITH {ATT}, x AS (SELECT *, CASE WHEN {_OK} THEN k::DOUBLE END AS x FROM latest),
s AS (SELECT system_id, count(*) AS n_total, count(*) FILTER {_OK.replace('(status', '(WHERE status', 1)} AS n_ok, count(*) FILTER (WHERE status <> 'ok') AS n_failed,
  coalesce(string_agg(DISTINCT nullif(prompt_version, ''), ';' ORDER BY nullif(prompt_version, '')), '') AS prompt_version, round(sum(latency_seconds), 8) AS runtime_seconds_total, {_STAT.format(p='k_')} FROM x GROUP BY system_id)
SELECT *, CASE WHEN n_ok > 0 THEN 'ok' ELSE 'not_available_or_failed' END AS status, '' AS metric_errors, round(CASE WHEN n_ok > 0 THEN 10.0::DOUBLE / sum((n_ok > 0)::INT) OVER () ELSE 0 END, 8) AS scoring_seconds FROM s""")
def a_system_summary(spark, d):
    rows = latest.latest_wins(i.attempts(spark, d), ["system_id", "record_id"], "seq")
    return rounded(summary.share_time(summary.system_summary(rows, ["system_id"], ["k"]), 10.0))


@query(f"""WITH s AS (SELECT source, lang, count(x) AS n, {_STAT.format(p='')} FROM (SELECT *, n_chars::DOUBLE AS x FROM documents) GROUP BY source, lang)
SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 8)::DOUBLE AS share FROM s""")
def a_source_summary(spark, d):
    return rounded(summary.source_summary(i.table(spark, d, "documents"), "source", "lang", "n_chars"))


@query(f"""WITH {PANEL}, x AS (SELECT CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'other' END AS source, * FROM panel),
p AS (SELECT source, event_type, count(*) AS n, avg(a) AS a, avg(b) AS b FROM x GROUP BY source, event_type)
SELECT source, event_type, n, round(a, 8) AS a, round(b, 8) AS b FROM p UNION ALL SELECT 'overall', event_type, sum(n)::BIGINT, round(avg(a), 8), round(avg(b), 8) FROM p WHERE source <> 'other' GROUP BY event_type""")
def a_macro_average(spark, d):
    m = F.col("user_id") % 4
    rows = i.panel(spark, d).withColumn("source", F.when(m == 0, "alpha").when(m == 1, "beta").when(m == 2, "gamma").otherwise("other"))
    return rounded(summary.macro_average(rows, "source", "event_type", ["a", "b"], ["alpha", "beta", "gamma"]))


@query(f"""WITH {ATT}, rows AS (SELECT * FROM att WHERE seq % 3 = 0), ex AS (SELECT DISTINCT record_id FROM att WHERE record_id % 10 <> 7),
per AS (SELECT system_id, record_id, count(*) AS c, max_by({_OK}, seq) AS ok FROM rows GROUP BY ALL),
f AS (SELECT coalesce(g.system_id, p.system_id) AS system_id, g.record_id IS NOT NULL AS wanted, p.record_id IS NOT NULL AS seen, coalesce(ok, false) AS ok, coalesce(c, 0) AS c FROM (SELECT * FROM (SELECT DISTINCT system_id FROM att), ex) g FULL JOIN per p ON g.system_id = p.system_id AND g.record_id = p.record_id)
SELECT system_id, sum(c)::BIGINT AS row_count, count(*) FILTER (seen) AS unique_count, count(*) FILTER (seen AND ok) AS ok_count, count(*) FILTER (seen AND NOT ok) AS not_ok_count, sum(CASE WHEN seen THEN c - 1 ELSE 0 END)::BIGINT AS duplicate_key_count,
  count(*) FILTER (wanted AND NOT seen) AS missing_count, count(*) FILTER (seen AND NOT wanted) AS unexpected_count, count(*) FILTER (wanted) AS expected_count, false AS complete FROM f GROUP BY system_id""")
def a_completeness(spark, d):
    a = i.attempts(spark, d)
    ok = (F.col("status") == "ok") & (F.trim("output_text") != "")
    return summary.completeness(a.where("seq % 3 = 0"), a.where("record_id % 10 <> 7").select("record_id"), a.select("system_id").distinct(), "record_id", "system_id", ok)


@query(f"""WITH {ATT} SELECT system_id, count(*) AS attempts, count(*) FILTER (status = 'ok') AS successes, count(DISTINCT CASE WHEN status = 'ok' THEN record_id END) AS unique_finals,
  round(avg(CASE WHEN status = 'ok' THEN latency_seconds END), 8) AS latency_seconds_mean, round(quantile_cont(CASE WHEN status = 'ok' THEN latency_seconds END, 0.5), 8) AS latency_seconds_median, round(sum(CASE WHEN status = 'ok' THEN latency_seconds END), 8) AS latency_seconds_total,
  round(avg(CASE WHEN status = 'ok' THEN k END)::DOUBLE, 8) AS k_mean, round(quantile_cont(CASE WHEN status = 'ok' THEN k::DOUBLE END, 0.5), 8) AS k_median, round(sum(CASE WHEN status = 'ok' THEN k END)::DOUBLE, 8) AS k_total,
  round(1 - count(*) FILTER (status = 'ok')::DOUBLE / count(*), 8) AS failure_rate FROM att GROUP BY system_id""")
def a_resources(spark, d):
    return rounded(summary.resources(i.attempts(spark, d), "system_id", "record_id", F.col("status") == "ok", ["latency_seconds", "k"]))


_COMPLETE = "comp AS (SELECT item, rater, avg(score) AS composite FROM part GROUP BY item, rater HAVING count(*) = 6 AND count(DISTINCT dim) = 6)"
_PART = "part AS (SELECT * FROM rate WHERE NOT (item % 10 = 3 AND rater = 7 AND dim = 'AF') AND NOT (item % 10 = 4 AND rater >= 6))"


def _part(spark, d):
    return i.ratings(spark, d).where("NOT (item % 10 = 3 AND rater = 7 AND dim = 'AF') AND NOT (item % 10 = 4 AND rater >= 6)")


@query(f"WITH {RATE}, {_PART}, {_COMPLETE} SELECT item, count(*) AS raters, round(avg(composite), 8) AS composite, count(*) >= 6 AS enough FROM comp GROUP BY item")
def a_complete_composite(spark, d):
    return rounded(summary.rater_composites(_part(spark, d), ["item"], "rater", "dim", "score", 6, 6))


@query(f"""WITH {RATE}, {_PART}, p AS (SELECT item, dim, count(DISTINCT rater) AS raters, avg(score) AS x FROM part GROUP BY item, dim)
SELECT item, round(avg(x), 8) AS composite, (42 - sum(raters))::BIGINT AS missing_cells, min(raters) >= 6 AND count(*) = 6 AS valid FROM p GROUP BY item""")
def a_dim_first_composite(spark, d):
    return rounded(summary.dimension_composites(_part(spark, d), ["item"], "rater", "dim", "score", 7, 6, 6))


@query(f"""WITH {RATE}, cell AS (SELECT rater, record, system, avg(score) AS x FROM rate GROUP BY ALL), fam(family, sx, sy) AS (VALUES ('one', 's0', 's1'), ('two', 's2', 's3')),
p AS (SELECT family, x.rater, count(*) AS n, avg(x.x - y.x) AS delta FROM fam JOIN cell x ON x.system = sx JOIN cell y ON y.system = sy AND y.record = x.record AND y.rater = x.rater GROUP BY ALL)
SELECT family, rater, n, round(delta, 8) AS delta, sum((delta > 0)::INT) OVER w::BIGINT AS positive_raters, round(min(delta) OVER w, 8) AS least, round(max(delta) OVER w, 8) AS most FROM p WINDOW w AS (PARTITION BY family)""")
def a_rater_direction(spark, d):
    return rounded(summary.rater_direction(i.ratings(spark, d), "rater", "record", "system", "score", {"one": ("s0", "s1"), "two": ("s2", "s3")}))


@query(f"""WITH {PANEL}, t AS (SELECT event_type, sum(a) AS s, count(*) AS n FROM panel GROUP BY event_type),
e AS (SELECT event_type, n, s / n AS mean, abs((s - a) / (n - 1) - s / n) AS shift FROM panel JOIN t USING (event_type))
SELECT event_type, max(n) AS n, round(max(mean), 8) AS mean, round(max(shift), 8) AS max_shift, round(min(shift), 8) AS min_shift FROM e GROUP BY event_type""")
def a_leave_one_out(spark, d):
    return rounded(summary.leave_one_out(i.panel(spark, d), "event_type", "user_id", "a"))


# -- shape -----------------------------------------------------------------------------------


@query(f"WITH {PANEL} SELECT x.user_id, round(x.a, 8) AS nt, round(y.a, 8) AS t, round(y.a - x.a, 8) AS delta FROM panel x JOIN panel y ON x.user_id = y.user_id WHERE x.event_type = 'view' AND y.event_type = 'click'")
def v_pair_pivot(spark, d):
    p = pairs.paired(i.panel(spark, d), "user_id", "event_type", "a", "view", "click", how="raise")
    return rounded(p.select("user_id", F.col("x").alias("nt"), F.col("y").alias("t"), (F.col("y") - F.col("x")).alias("delta")))


@query(f"""WITH {PANEL}, c AS (SELECT user_id, event_type, a, least(10.0, floor(a / 5) / 2) AS x FROM panel)
SELECT user_id, event_type AS system_id, row_number() OVER (PARTITION BY user_id ORDER BY -a, event_type)::INT AS rank_position, round(x, 8)::DOUBLE AS form, round(10.0 - x, 8)::DOUBLE AS sense, 5.0::DOUBLE AS average_score FROM c""")
def v_judge_explode(spark, d):
    a = i.answers(spark, d)
    mapping = a.select("user_id", F.explode("mapping").alias("m")).select("user_id", "m.candidate_id", "m.system_id")
    return rounded(judge.explode_scores(judge.parse(a, "raw"), "user_id", mapping, ["form", "sense"]))


_FAULT_SQL = {"unparsed": "user_id % 5 = 4", "candidates": "user_id % 5 = 4", "off_step": "user_id % 5 = 1", "ranking": "user_id % 5 IN (3, 4)"}


@query("WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _FAULT_SQL.items()) + ", 5 * count(*) FILTER (user_id % 5 = 2) AS blank_reasons FROM u) " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", " + (f"{k} FROM n" if k in (*_FAULT_SQL, "blank_reasons") else "0 FROM n") for k in judge.FAULTS).replace('AS "check", unparsed', 'AS "check", unparsed AS n', 1))
def q_judge_json(spark, d):
    f = judge.faults(judge.parse(i.answers(spark, d, faults=True), "raw"), "expected", ["form", "sense"])
    one = f.agg(*[F.sum(k).cast("long").alias(k) for k in judge.FAULTS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in judge.FAULTS])).alias("x")).select("x.*")


@query(f"""WITH {PANEL}, {RATE}, odd AS (SELECT item, rater, dim, CASE WHEN item % 10 = 1 AND rater = 1 THEN score + 6 WHEN item % 10 = 2 AND rater = 2 THEN score + 0.5 ELSE score END AS s FROM rate UNION ALL SELECT item, rater, dim, score FROM rate WHERE item % 10 = 5 AND rater = 3)
SELECT 'not_whole' AS "check", count(*) FILTER (s <> floor(s)) AS n FROM odd UNION ALL SELECT 'out_of_range', count(*) FILTER (NOT s BETWEEN 1 AND 6) FROM odd UNION ALL SELECT 'unknown_dimension', count(*) FILTER (dim NOT IN ('AF', 'AO', 'NF', 'NO', 'RF')) FROM odd
UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM odd GROUP BY item, rater, dim HAVING count(*) > 1) UNION ALL SELECT 'panel_not_finite', 0 UNION ALL SELECT 'panel_duplicate_keys', 0 UNION ALL SELECT 'panel_panel_size', (count(DISTINCT user_id) <> 150)::BIGINT FROM panel
UNION ALL SELECT 'missing_keys', count(*) FROM (SELECT DISTINCT user_id FROM panel WHERE user_id % 2 = 0) UNION ALL SELECT 'unexpected_keys', 0""")
def q_panel_gate(spark, d):
    r = i.ratings(spark, d).select("item", "rater", "dim", F.when((F.col("item") % 10 == 1) & (F.col("rater") == 1), F.col("score") + 6.0).when((F.col("item") % 10 == 2) & (F.col("rater") == 2), F.col("score") + 0.5).otherwise(F.col("score").cast("double")).alias("s"))
    r = r.unionByName(i.ratings(spark, d).where("item % 10 = 5 AND rater = 3").select("item", "rater", "dim", F.col("score").cast("double").alias("s")))
    p = i.panel(spark, d)
    own = gates.panel(p, "user_id", "event_type", "a", 150, 5).withColumn("check", F.concat(F.lit("panel_"), "check"))
    return gates.union(gates.ratings(r, ["item", "rater"], "dim", "s", DIMS[:5], 1, 6), own, gates.key_sets(p.where("user_id % 2 = 1"), p, ["user_id"]))


@query(f"""WITH {PANEL}, n AS (SELECT count(*) FILTER (user_id % 3 = 0) AS p, count(*) FILTER (user_id % 4 = 0) AS iv, count(*) FILTER (user_id % 5 = 0) AS nan, count(*) FILTER (user_id % 6 = 0) AS url, count(*) FILTER (user_id % 6 = 1) AS hex, count(*) FILTER (user_id % 6 = 2) AS mark FROM panel)
SELECT 'not_finite' AS "check", nan AS n FROM n UNION ALL SELECT 'probability', p FROM n UNION ALL SELECT 'private_place', url FROM n UNION ALL SELECT 'digest', hex FROM n UNION ALL SELECT 'mark', mark FROM n UNION ALL SELECT 'forbidden_column', 2 FROM n
UNION ALL SELECT 'duplicate_column', 0 FROM n UNION ALL SELECT 'blank_in_name', 1 FROM n UNION ALL SELECT 'interval', iv FROM n UNION ALL SELECT 'empty', 0 FROM n""")
def q_release_audit(spark, d):
    u = F.col("user_id")
    table = i.panel(spark, d).select(
        F.col("event_type").alias("analysis"), F.when(u % 5 == 0, F.lit("nan").cast("double")).otherwise(1.5).alias("effect "), F.when(u % 3 == 0, 1.1).otherwise(0.5).alias("p_holm"),
        F.when(u % 4 == 0, 2.0).otherwise(0.0).alias("ci_low"), F.lit(1.0).alias("ci_high"), u.alias("record_id"), u.alias("input_hash"),
        F.when(u % 6 == 0, "https://x.example/").when(u % 6 == 1, "0a" * 20).when(u % 6 == 2, "made by a Robot").otherwise("fine").alias("note"),
    )
    return gates.release_audit(table, ["robot"])


# -- order and samples -----------------------------------------------------------------------

_ALLOC = """cnt AS (SELECT {g} AS g, count(*) AS c, min(doc_id) AS f FROM documents GROUP BY {g}),
al AS (SELECT g, c, f, least(({n} * c) // sum(c) OVER ()::BIGINT, c) AS base, ({n} * c) % (sum(c) OVER ())::BIGINT AS rest FROM cnt),
q AS (SELECT g, c, base + (row_number() OVER (ORDER BY rest DESC, c DESC, f) <= {n} - sum(base) OVER () AND base < c)::INT AS quota FROM al)"""


@query(f"WITH {_ALLOC.format(g='lang', n=97)} SELECT g AS lang, c AS count, quota::BIGINT AS quota FROM q")
def w_largest_remainder(spark, d):
    counts = i.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("first"))
    return sampling.allocate(counts, "lang", 97, "first")


@query(f"WITH {_ALLOC.format(g='lang', n=97)}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) SELECT doc_id, lang FROM r JOIN q ON g = lang WHERE k <= quota")
def w_manifest_head(spark, d):
    return sampling.head_manifest(i.table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 97).select("doc_id", "lang")


@query(f"WITH {_ALLOC.format(g='lang', n=60)}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(sha256('7:' || doc_id), 1, 15))::BIGINT, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r JOIN q ON g = lang WHERE k <= quota")
def w_hash_sample(spark, d):
    return sampling.hash_sample(i.table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, 7).select("doc_id", "lang")


@query(f"WITH {PANEL} SELECT user_id, event_type, chr((64 + row_number() OVER (PARTITION BY user_id ORDER BY ('0x' || substr(sha256('7:' || user_id || ':' || event_type), 1, 15))::BIGINT, event_type))::INT) AS letter FROM panel")
def w_hash_shuffle(spark, d):
    return sampling.hash_letters(i.panel(spark, d).select("user_id", "event_type"), "user_id", "event_type", 7)


@query()
def w_seeded_letters(spark, d):
    return sampling.seeded_letters(i.panel(spark, d), "user_id", "event_type", 20260513)


@query("SELECT shard, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents) GROUP BY shard")
def w_shards(spark, d):
    return latest.shard(i.table(spark, d, "documents").select("doc_id"), "doc_id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


_P = f"{PANEL}, ps AS (SELECT event_type, user_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE round((a - floor(a)) / 50, 8) END AS p FROM panel)"
_HOLM = "SELECT event_type, user_id, p, round(CASE WHEN p IS NOT NULL THEN max(least(1.0, ({m} - k + 1) * p)) OVER (PARTITION BY event_type, p IS NULL ORDER BY k) END, 8) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY event_type, p IS NULL ORDER BY p) AS k, count(p) OVER (PARTITION BY event_type) AS cnt FROM ps)"


def _p_values(spark, d):
    p = pairs.nearest((F.col("a") - i.floored(F.col("a"))) / 50, 8)
    return i.panel(spark, d).select("event_type", "user_id", F.when(F.col("user_id") % 9 == 0, None).otherwise(p).alias("p"))  # a null id has a p


@query(f"WITH {_P} {_HOLM.format(m='cnt')}")
def w_holm(spark, d):
    return rounded(pairs.holm(_p_values(spark, d), "p", ["event_type"]))


@query(f"WITH {_P} {_HOLM.format(m='(SELECT count(DISTINCT user_id) FROM panel)')}")
def w_holm_declared(spark, d):
    users = i.panel(spark, d).agg(F.count_distinct("user_id")).first()[0]  # a test was planned for each of them
    return rounded(pairs.holm(_p_values(spark, d), "p", ["event_type"], family_size=users))


_RANKED = f"{PANEL}, v AS (SELECT event_type, user_id, floor(a / 10) AS v FROM panel)"


@query(f"WITH {_RANKED} SELECT event_type, user_id, v::DOUBLE AS v, (rank() OVER (PARTITION BY event_type ORDER BY v DESC) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0)::DOUBLE AS avg_rank FROM v")
def w_average_rank(spark, d):
    return pairs.average_ranks(i.panel(spark, d).select("event_type", "user_id", i.floored(F.col("a") / 10).alias("v")), ["event_type"], "v")


@query(f"""WITH {_RANKED}, x AS (SELECT *, max(v) OVER (PARTITION BY user_id) AS hi, min(v) OVER (PARTITION BY user_id) AS lo FROM v)
SELECT user_id, string_agg(CASE WHEN v = hi THEN event_type END, '|' ORDER BY event_type) AS top, string_agg(CASE WHEN v = lo THEN event_type END, '|' ORDER BY event_type) AS bottom, round(1.0::DOUBLE / count(*) FILTER (v = hi), 8) AS top_weight FROM x GROUP BY user_id""")
def w_extremes(spark, d):
    return rounded(pairs.extremes(i.panel(spark, d).select("event_type", "user_id", i.floored(F.col("a") / 10).alias("v")), ["user_id"], "event_type", "v"))


@query("SELECT source, tertile, count(*) AS n, round(avg(n_chars), 8) AS mean_chars FROM (SELECT *, (ntile(3) OVER (PARTITION BY source ORDER BY n_chars, doc_id::VARCHAR) - 1)::INT AS tertile FROM documents) GROUP BY source, tertile")
def w_tertiles(spark, d):
    out = pairs.tertiles(i.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", "doc_id", ["source"])
    return rounded(out.groupBy("source", "tertile").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars")))


@query(f"""WITH {ATT}, u AS (SELECT 0 AS log, seq, system_id, CASE WHEN record_id % 11 <> 0 THEN record_id END AS record_id, status FROM att WHERE seq % 2 = 1 UNION ALL SELECT 1, seq, system_id, CASE WHEN record_id % 11 <> 0 THEN record_id END, status FROM att WHERE seq % 2 = 0)
SELECT system_id, record_id, seq, status FROM u WHERE record_id IS NULL UNION ALL (SELECT system_id, record_id, seq, status FROM u WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY system_id, record_id ORDER BY log DESC, seq DESC) = 1)""")
def u_merge_latest(spark, d):
    a = i.attempts(spark, d).select("seq", "system_id", F.when(F.col("record_id") % 11 != 0, F.col("record_id")).alias("record_id"), "status")
    return latest.merge_logs([a.where("seq % 2 = 1"), a.where("seq % 2 = 0")], ["system_id", "record_id"], "seq").select("system_id", "record_id", "seq", "status")


@query("""WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 20), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value < 5)
SELECT (SELECT count(*) FROM l ANTI JOIN r USING (user_id)) AS only_left, (SELECT count(*) FROM r ANTI JOIN l USING (user_id)) AS only_right, (SELECT count(*) FROM l SEMI JOIN r USING (user_id)) AS common""")
def u_set_equality(spark, d):
    e = i.table(spark, d, "events")
    return latest.set_differences(e.where("event_type = 'view' AND value > 20"), e.where("event_type = 'click' AND value < 5"), "user_id")


# -- inference -------------------------------------------------------------------------------

_DZ = "round(CASE WHEN max(abs({d})) = 0 THEN 0.0 WHEN stddev_samp({d}) > 0 THEN avg({d}) / stddev_samp({d}) END, 8) AS dz, CASE WHEN max(abs({d})) = 0 THEN 'all_zero' WHEN stddev_samp({d}) > 0 THEN 'ok' ELSE 'zero_variance_nonzero' END AS dz_status"


def _families(spark, d):
    return pairs.families(i.panel(spark, d), "user_id", "event_type", "a", FAMILIES)


@query(f"WITH {PAIRED_SQL} SELECT family, count(*) AS n, round(avg(x), 8) AS mean_x, round(avg(y), 8) AS mean_y, round(avg(y - x), 8) AS delta, {_DZ.format(d='(y - x)')}, CASE WHEN avg(y - x) > 0 THEN 'up' WHEN avg(y - x) < 0 THEN 'down' ELSE 'tie' END AS direction FROM prs GROUP BY family")
def i_paired_effect(spark, d):
    return rounded(pairs.effects(_families(spark, d), ["family"]))


def _wilcoxon_sql(where: str) -> str:
    return f"""WITH {PAIRED_SQL}, dd AS (SELECT family, round(y - x, 1) AS d FROM prs WHERE {where}),
rk AS (SELECT family, d, rank() OVER (PARTITION BY family ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, abs(d)) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY family, abs(d)) AS t FROM dd)
SELECT family, count(*) FILTER (d <> 0) AS n, coalesce(sum(k) FILTER (d > 0), 0)::DOUBLE AS r_plus, coalesce(sum(k) FILTER (d < 0), 0)::DOUBLE AS r_minus, coalesce(sum(t * t - 1) FILTER (d <> 0), 0)::DOUBLE AS ties, count(*) FILTER (d = 0) AS zeros,
least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0))::DOUBLE AS w FROM rk GROUP BY family"""


@query(_wilcoxon_sql("round(y - x, 1) <> 0"))
def i_wilcoxon_stat(spark, d):
    return pairs.signed_ranks(_families(spark, d), ["family"], "wilcox", decimals=1)


@query(_wilcoxon_sql("true"))
def i_wilcoxon_pratt(spark, d):
    return pairs.signed_ranks(_families(spark, d), ["family"], "pratt", decimals=1)


@query(f"WITH s AS ({_wilcoxon_sql('true')}), p AS (SELECT family, n, w, {signed_rank_p_sql('w', 'n', 'ties', 'zeros')} AS p FROM s) SELECT family, n, w, round(p, 8) AS p, round(max(least(1.0, (cnt - k + 1) * p)) OVER (ORDER BY k), 8) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS cnt FROM p)")
def i_wilcoxon_p(spark, d):
    r = pairs.signed_ranks(_families(spark, d), ["family"], "pratt", decimals=1)
    return rounded(pairs.holm(r.select("family", "n", "w", signed_rank_p(F.col("w"), F.col("n"), F.col("ties"), F.col("zeros")).alias("p")), "p", []))


@query(f"WITH {PANEL}, c AS (SELECT user_id, avg(b - a) FILTER (event_type IN ('view', 'click')) - avg(b - a) FILTER (event_type NOT IN ('view', 'click')) AS d FROM panel GROUP BY user_id) SELECT count(d) AS n, round(avg(d), 8) AS contrast, {_DZ.format(d='d')} FROM c")
def i_did_contrast(spark, d):
    return rounded(pairs.contrast(i.panel(spark, d), "user_id", "event_type", "a", "b", ["view", "click"]))


_H = "('0x' || substr(sha256({s}), 1, 15))::BIGINT"
_DRAWS = 200


_W = resample.weight_sql(_H.format(s=f"'{SEED}:' || d || ':' || user_id"))


@query(f"""WITH {PANEL}, v AS (SELECT user_id, b - a AS x FROM panel WHERE event_type = 'view'), dr AS (SELECT d, x, {_W} AS k FROM v, range({_DRAWS}) t(d)), m AS (SELECT d, sum(k * x) / sum(k) AS m FROM dr GROUP BY d)
SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(x) FROM v), 8) AS mean, round(quantile_cont(m, 0.025), 8) AS ci_low, round(quantile_cont(m, 0.975), 8) AS ci_high, count(m) AS n_valid FROM m""")
def i_hash_bootstrap(spark, d):
    v = i.panel(spark, d).where("event_type = 'view'").select("user_id", (F.col("b") - F.col("a")).alias("x"))
    return rounded(resample.hash_bootstrap(v, "user_id", "x", _DRAWS, SEED))


@query(f"""WITH {PANEL}, v AS (SELECT row_number() OVER (ORDER BY {_H.format(s=f"'{SEED}:' || user_id")}, user_id) - 1 AS place, count(*) OVER () AS n, a AS x, b AS y FROM panel WHERE event_type = 'click'),
pm AS (SELECT d, y, (place + {_H.format(s=f"'{SEED}:' || d || ':turn'")}) % n AS place FROM range({_DRAWS}) t(d), v),
r AS (SELECT d, corr(v.x, pm.y) AS r FROM pm JOIN v USING (place) GROUP BY d), e AS (SELECT count(*) AS n, corr(x, y) AS estimate FROM v)
SELECT n, round(estimate, 8) AS estimate, count(r) AS n_valid, round((count(*) FILTER (abs(r) >= abs(estimate) - 1e-12) + 1) / (count(r) + 1), 8)::DOUBLE AS p_perm FROM r, e GROUP BY n, estimate""")
def i_permutation(spark, d):
    return rounded(resample.hash_permutation(i.panel(spark, d).where("event_type = 'click'"), "user_id", "a", "b", _DRAWS, SEED))


_DRAW_MEANS = f"""m AS (SELECT d, event_type, round(sum(k * a) / sum(k), 9) AS a, round(sum(k * b) / sum(k), 9) AS b FROM (SELECT d, event_type, a, b, {_W} AS k FROM panel, range({_DRAWS}) t(d)) GROUP BY d, event_type)"""


@query(f"""WITH {PANEL}, {_DRAW_MEANS}, w AS (SELECT *, (a = max(a) OVER (PARTITION BY d))::INT AS t, (a = min(a) OVER (PARTITION BY d))::INT AS l FROM m),
s AS (SELECT *, t::DOUBLE / sum(t) OVER (PARTITION BY d) AS tt, l::DOUBLE / sum(l) OVER (PARTITION BY d) AS ll FROM w),
p AS (SELECT event_type, avg(a) AS mean FROM panel GROUP BY event_type)
SELECT event_type, round(mean, 8) AS mean, rank() OVER (ORDER BY round(mean, 9) DESC)::INT AS rank, round(top_probability, 8) AS top_probability, round(bottom_probability, 8) AS bottom_probability, n_valid
FROM p JOIN (SELECT event_type, avg(tt) AS top_probability, avg(ll) AS bottom_probability, count(*) AS n_valid FROM s GROUP BY event_type) USING (event_type)""")
def i_rank_stability(spark, d):
    return rounded(resample.rank_stability(i.panel(spark, d), "user_id", "event_type", "a", _DRAWS, SEED))


@query(f"""WITH {PANEL}, {_DRAW_MEANS}, z AS (SELECT * FROM m UNION ALL SELECT -1, event_type, round(avg(a), 9), round(avg(b), 9) FROM panel GROUP BY event_type),
w AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY a DESC) + (count(*) OVER (PARTITION BY d, a) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY d ORDER BY b DESC) + (count(*) OVER (PARTITION BY d, b) - 1) / 2.0::DOUBLE AS ry, (a = max(a) OVER (PARTITION BY d))::INT AS tx, (b = max(b) OVER (PARTITION BY d))::INT AS ty FROM z),
p AS (SELECT d, count(*) AS n, corr(a, b) AS pearson, corr(rx, ry) AS spearman, sum(tx * ty)::DOUBLE / (sum(tx) * sum(ty)) AS same_top FROM w GROUP BY d)
SELECT max(n) FILTER (d = -1) AS n_systems, round(max(pearson) FILTER (d = -1), 8) AS pearson, round(quantile_cont(pearson, 0.025) FILTER (d >= 0), 8) AS pearson_low, round(quantile_cont(pearson, 0.975) FILTER (d >= 0), 8) AS pearson_high,
  round(max(spearman) FILTER (d = -1), 8) AS spearman, round(quantile_cont(spearman, 0.025) FILTER (d >= 0), 8) AS spearman_low, round(quantile_cont(spearman, 0.975) FILTER (d >= 0), 8) AS spearman_high,
  round(avg(same_top) FILTER (d >= 0), 8) AS same_top_probability, count(*) FILTER (d >= 0) AS n_valid FROM p""")
def i_rank_agreement(spark, d):
    return rounded(resample.rank_agreement(i.panel(spark, d), "user_id", "event_type", "a", "b", _DRAWS, SEED))


@query(f"""WITH pop AS (SELECT lang, doc_id, n_chars::DOUBLE AS x FROM documents), panel AS (SELECT * FROM pop WHERE doc_id % 25 = 0), k AS (SELECT lang, count(*) AS k FROM panel GROUP BY lang),
e AS (SELECT sum(k * m) / sum(k) AS expected, sum(k)::BIGINT AS n FROM (SELECT lang, any_value(k) AS k, avg(x) AS m FROM pop JOIN k USING (lang) GROUP BY lang)), o AS (SELECT avg(x) AS observed FROM panel),
rk AS (SELECT d, x, k, row_number() OVER (PARTITION BY d, lang ORDER BY {_H.format(s=f"'{SEED}:' || d || ':' || doc_id")}, doc_id) AS r FROM range(40) t(d), pop JOIN k USING (lang)),
m AS (SELECT d, avg(x) AS m FROM rk WHERE r <= k GROUP BY d)
SELECT round(observed, 8) AS observed, round(expected, 8) AS expected, n, round(quantile_cont(m, 0.025), 8) AS ci_low, round(quantile_cont(m, 0.975), 8) AS ci_high, count(*) AS n_valid,
  round((count(*) FILTER (abs(m - expected) >= abs(observed - expected) - 1e-12) + 1) / (count(*) + 1), 8)::DOUBLE AS p_resample, observed BETWEEN quantile_cont(m, 0.025) AND quantile_cont(m, 0.975) AS inside FROM m, e, o GROUP BY observed, expected, n""")
def i_stratified_resample(spark, d):
    docs = i.table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return rounded(resample.stratified_resample(docs, docs.where("doc_id % 25 = 0"), "lang", "doc_id", "n_chars", 40, SEED))


@query()
def i_numpy_bootstrap(spark, d):
    return rounded(resample.numpy_bootstrap(_families(spark, d), "family", "user_id", 2000, resample.analysis_seed(SEED, "paired")))


@query()
def i_cluster_bootstrap(spark, d):
    return rounded(resample.correlation_bootstrap(i.panel(spark, d), "event_type", "user_id", "a", "b", 2000, resample.analysis_seed(SEED, "correlation")))


_FE = f"""{PANEL}, dd AS (SELECT user_id, event_type, (event_type IN ('view', 'click'))::INT::DOUBLE AS f, b - a AS d FROM panel),
w AS (SELECT avg(d) FILTER (f = 1) AS inside, avg(d) FILTER (f = 0) AS outside, avg(f) AS share, count(*)::DOUBLE AS cells, count(DISTINCT event_type)::DOUBLE AS s, count(DISTINCT user_id)::DOUBLE AS r FROM dd),
u AS (SELECT sum(u * u) AS uu FROM (SELECT user_id, sum(0.5::DOUBLE * (f - share) * (d - outside - (inside - outside) * f)) AS u FROM dd, w GROUP BY user_id))"""


@query(f"WITH {_FE} SELECT round(inside - outside, 8) AS estimate, round(sqrt(uu / pow(0.5 * cells * share * (1 - share), 2) * r / (r - 1) * (2 * r * s - 1) / (2 * r * s - r - s - 1)), 8) AS se, (2 * r * s)::BIGINT AS n_obs, (r - 1)::BIGINT AS df FROM w, u")
def m_fe_interaction(spark, d):
    return rounded(models.fe_interaction(i.panel(spark, d), "user_id", "event_type", "a", "b", ["view", "click"]))


_SL = f"""{PANEL}, dm AS (SELECT user_id, a - avg(a) OVER (PARTITION BY user_id) - avg(a) OVER (PARTITION BY event_type) + avg(a) OVER () AS y, b - avg(b) OVER (PARTITION BY user_id) - avg(b) OVER (PARTITION BY event_type) + avg(b) OVER () AS x FROM panel),
p AS (SELECT user_id, sum(x * y) AS xy, sum(x * x) AS xx FROM dm GROUP BY user_id), f AS (SELECT sum(xy) / sum(xx) AS b, sum(xx) AS sxx, count(*)::DOUBLE AS r FROM p), m AS (SELECT sum(pow(xy - b * xx, 2)) AS m FROM p, f), c AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT event_type)::DOUBLE AS s FROM panel)"""


@query(f"WITH {_SL} SELECT round(b, 8) AS slope, round(sqrt(m / (sxx * sxx) * r / (r - 1) * (n - 1) / (n - r - s)), 8) AS se, n::BIGINT AS n_obs, (r - 1)::BIGINT AS df, round(1 - ((SELECT sum(y * y) FROM dm) - b * b * sxx) / (SELECT var_pop(a) * count(*) FROM panel), 8) AS r_squared FROM f, m, c")
def m_fe_wordcount(spark, d):
    return rounded(models.fe_slope(i.panel(spark, d), "user_id", "event_type", "a", "b"))


@query(f"""WITH {PAIRED_SQL}, o AS (SELECT y - x AS y, x FROM prs WHERE family = 'one'), f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM o),
e AS (SELECT x - mx AS dx, y - my - b * (x - mx) AS e, 1.0::DOUBLE / n + pow(x - mx, 2) / sxx AS h, y - my AS t FROM o, f)
SELECT round(my - b * mx, 8) AS intercept, round(b, 8) AS slope, round((SELECT sqrt(sum(pow(dx * e / (1 - h), 2))) FROM e) / sxx, 8) AS se, round(1 - (SELECT sum(e * e) / sum(t * t) FROM e), 8) AS r_squared, n AS n_obs FROM f""")
def m_hc3_delta(spark, d):
    p = _families(spark, d).where("family = 'one'").select((F.col("y") - F.col("x")).alias("y"), "x")
    return rounded(models.hc3(p, "y", "x"))


@query(f"""WITH {RATE}, rk AS (SELECT dim, item, rater, rank() OVER (PARTITION BY dim, rater ORDER BY score) + (count(*) OVER (PARTITION BY dim, rater, score) - 1) / 2.0 AS k, pow(count(*) OVER (PARTITION BY dim, rater, score), 2) - 1 AS t FROM rate),
p AS (SELECT dim, item, sum(k)::DOUBLE AS r, sum(t) AS t, count(*) AS m FROM rk GROUP BY dim, item), q AS (SELECT dim, count(*)::DOUBLE AS n, max(m)::DOUBLE AS m, var_pop(r) * count(*) AS s, sum(t) AS t FROM p GROUP BY dim)
SELECT dim, n::BIGINT AS n_items, m::BIGINT AS n_raters, round(12 * s / (m * m * (n * n * n - n) - m * t), 8) AS kendall_w FROM q""")
def m_kendall_w(spark, d):
    return rounded(models.kendall_w(i.ratings(spark, d), ["dim"], "item", "rater", "score"))


@query(f"""WITH {RATE}, c AS (SELECT dim, item, score, count(*) AS c FROM rate GROUP BY ALL), p AS (SELECT dim, item, sum(c * (c - 1)) / 42.0::DOUBLE AS p FROM c GROUP BY dim, item HAVING sum(c) = 7),
e AS (SELECT dim, sum(q * q) AS pe FROM (SELECT dim, score, sum(c)::DOUBLE / sum(sum(c)) OVER (PARTITION BY dim) AS q FROM c GROUP BY dim, score) GROUP BY dim)
SELECT dim, count(*) AS n_items, round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 8) AS fleiss_kappa FROM p JOIN e USING (dim) GROUP BY dim""")
def m_fleiss(spark, d):
    return rounded(models.fleiss_kappa(i.ratings(spark, d), ["dim"], "item", "score", 7))


@query(f"""WITH {RATE}, {_PART}, c AS (SELECT dim, item, score AS c, count(*)::DOUBLE AS n FROM part GROUP BY ALL), sz AS (SELECT dim, item, sum(n) AS m FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT l.dim, l.c, r.c AS k, sum(l.n * (r.n - (l.c = r.c)::INT) / (m - 1)) AS o FROM c l JOIN c r ON l.dim = r.dim AND l.item = r.item JOIN sz ON sz.dim = l.dim AND sz.item = l.item GROUP BY ALL),
mg AS (SELECT dim, c, sum(o) AS n FROM o GROUP BY ALL), cu AS (SELECT *, sum(n) OVER (PARTITION BY dim ORDER BY c) AS upto, sum(n) OVER (PARTITION BY dim) AS total FROM mg),
de AS (SELECT l.dim, l.c, r.c AS k, l.n AS nc, r.n AS nk, l.total, pow(r.upto - r.n / 2 - (l.upto - l.n / 2), 2) AS d FROM cu l JOIN cu r ON l.dim = r.dim AND l.c < r.c)
SELECT dim, round(1 - (max(total) - 1) * sum(coalesce(o, 0) * d) / sum(nc * nk * d), 8) AS krippendorff_alpha FROM de LEFT JOIN o USING (dim, c, k) GROUP BY dim""")
def m_krippendorff(spark, d):
    return rounded(models.krippendorff_alpha(_part(spark, d), ["dim"], "item", "score"))


# Least standardised differences of 20 pairs at power 0.80, for alpha 0.05 and 0.05 / 21.
MDE = {"0.05": 0.6604416544, "0.05/21": 0.9888366073}


@query(f"WITH {PAIRED_SQL}, s AS (SELECT family, stddev_samp(y - x) AS sd FROM prs GROUP BY family) SELECT family, alpha, dz::DOUBLE AS dz, round(sd * dz, 8) AS raw FROM s, (VALUES ('0.05', 0.6604416544::DOUBLE), ('0.05/21', 0.9888366073::DOUBLE)) t(alpha, dz)")
def m_mde(spark, d):
    alphas = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(z).alias("dz")) for a, z in MDE.items()])
    s = _families(spark, d).groupBy("family").agg(F.stddev_samp(F.col("y") - F.col("x")).alias("sd"))
    return s.select("family", F.explode(alphas).alias("x"), "sd").select("family", "x.alpha", "x.dz", F.round(F.col("sd") * F.col("x.dz"), 8).alias("raw"))


@query()
def m_mixed(spark, d):
    r = i.ratings(spark, d).where("system IN ('s0', 's1')").withColumn("mode", (F.col("system") == "s1").cast("double"))
    return rounded(resample.mixed_model(r, "dim", "score", "mode", "rater", "record"), 4)


# -- sinks, reports, services, streams -------------------------------------------------------


@query(f"""WITH {PANEL} SELECT 'mean' AS kind, event_type, round(avg(a), 8) AS mean, NULL::BIGINT AS n, NULL::DOUBLE AS top FROM panel GROUP BY event_type UNION ALL SELECT 'count', event_type, NULL, count(*), NULL FROM panel GROUP BY event_type UNION ALL SELECT 'top', NULL, NULL, NULL, round(max(a), 8) FROM panel""")
def k_sparse_union(spark, d):
    from ..sources.files import sparse_union

    p = i.panel(spark, d)
    kind = lambda k: F.lit(k).alias("kind")
    a, b = p.groupBy("event_type").agg(F.avg("a").alias("mean")), p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sparse_union(a.select(kind("mean"), "*"), b.select(kind("count"), "*"), p.agg(F.max("a").alias("top")).select(kind("top"), "*")))


@query(f"""WITH {PANEL}, x AS (SELECT user_id, event_type, round(b, 0)::BIGINT AS b FROM panel)
SELECT user_id, string_agg('| ' || event_type || ' | ' || b || '.00 |', chr(10) ORDER BY event_type) AS "table" FROM x GROUP BY user_id""")
def k_report_table(spark, d):
    p = i.panel(spark, d).select("user_id", "event_type", F.round("b", 0).alias("b"))
    return report.report(p, "user_id", "event_type", [F.col("event_type"), report.number(F.col("b"))])


@query("SELECT conv_id, 'ok' AS status, CASE WHEN contains(text, 'the') THEN 3 ELSE 1 END AS attempts, CASE WHEN contains(text, 'the') THEN 'second' ELSE 'first' END AS client, length(coalesce(text, ''))::INT AS n_chars FROM conversations WHERE role = 'user'")
def s_provider_rows(spark, d):
    rows = i.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "text")
    out = providers.call(rows, "text", providers.Retry([providers.EchoClient("first", "the"), providers.EchoClient("second")], times=2))
    return out.select("conv_id", "status", "attempts", "client", F.length("output_text").alias("n_chars"))


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def s_stream_attempts(spark, d):
    from ..streaming import attempts as stream

    name = shared_path(spark, "stream")
    events = i.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.write.mode("overwrite").parquet(f"{name}/log")
    q = stream.upsert_latest(stream.read_log(spark, f"{name}/log", events.schema), f"{name}/state", f"{name}/checkpoint", ["user_id", "event_type"], "event_id")
    run = q.trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{name}/state/v{(run.lastProgress or {'batchId': 0})['batchId']}")


# -- stages and bundles ----------------------------------------------------------------------


def _pair_log(spark, d):
    """Text pairs as a log of outputs and its manifest."""
    p = i.pairs(spark, d).withColumn("record_id", F.concat_ws("-", "conv_id", "turn"))
    bad = F.col("conv_id") % 7 == 0
    out = p.select(
        F.col("system").alias("system_id"), "record_id", F.col("conv_id").alias("seq"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "").otherwise(F.col("h")).alias("output_text"),
        F.when(bad, "broken").otherwise("").alias("error"), F.lit("v1").alias("prompt_version"), F.lit(0.5).alias("latency_seconds"),
    )
    return out, p.select("record_id", F.col("system").alias("source_id"), F.lit("x").alias("source"), F.col("r").alias("reference"))


@query()
def a_score_systems(spark, d):
    outputs, manifest = _pair_log(spark, d)
    return rounded(scoring.score_systems(scoring.score_rows(outputs, manifest, counts=True).persist(), 1.0))


@query(f"""WITH {PAIR} SELECT system AS system_id, count(*) AS n, count(*) FILTER (conv_id % 7 <> 0) AS n_ok, NULL::DOUBLE AS semantic, 'semantic is not available: no model is installed' AS semantic_error, 'learned is not in profile semantic' AS learned_error FROM pair GROUP BY system""")
def t_model_profile(spark, d):
    p, _ = _pair_log(spark, d)
    rows = scoring.model_scores(p.select("system_id", "status", F.lit("x").alias("source"), F.col("output_text").alias("hypothesis"), F.lit("y").alias("reference")), "semantic", None)
    rows = rows.withColumn("learned_error", F.lit("learned is not in profile semantic"))
    return rows.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "ok", 1)).alias("n_ok"), F.max("semantic").alias("semantic"), F.max("semantic_error").alias("semantic_error"), F.max("learned_error").alias("learned_error"))


@query(f"""WITH {ATT}, {PANEL}, x AS (SELECT system_id, record_id, c = 1 AND ok AS whole FROM (SELECT system_id, record_id, count(*) AS c, max_by({_OK}, seq) AS ok FROM att GROUP BY ALL))
SELECT 'incomplete_systems' AS "check", count(DISTINCT system_id) FILTER (NOT whole) AS n FROM x UNION ALL SELECT 'system_count', 1 UNION ALL SELECT 'score_not_finite', count(*) FILTER (user_id % 10 = 0 AND user_id % 6 <> 5) FROM panel
UNION ALL SELECT 'missing_keys', count(*) FILTER (user_id % 6 = 5) FROM panel UNION ALL SELECT 'unexpected_keys', 0""")
def q_stage_gate(spark, d):
    a = i.attempts(spark, d)
    s = i.panel(spark, d).where("user_id % 6 <> 5").select(F.col("event_type").alias("system_id"), F.col("user_id").alias("record_id"), F.when(F.col("user_id") % 10 == 0, float("nan")).otherwise(F.col("a")).alias("score"))
    return stages.stage_gate(a, s, a.select("record_id"), a.select("system_id").distinct(), 3)


@query(f"""WITH {ATT}, {PANEL}, m AS (SELECT user_id AS record_id, event_type AS system_id FROM panel WHERE NOT (user_id % 9 = 4 AND event_type = 'view') AND user_id % 8 <> 3), good AS (SELECT DISTINCT record_id, system_id FROM att WHERE {_OK})
SELECT 'not_a_bijection' AS "check", count(DISTINCT record_id) FILTER (record_id % 9 = 4) AS n FROM m UNION ALL SELECT 'output_not_ok', count(*) FROM (SELECT * FROM m ANTI JOIN good USING (record_id, system_id)) UNION ALL SELECT 'missing_keys', count(DISTINCT user_id) FILTER (user_id % 8 = 3) FROM panel UNION ALL SELECT 'unexpected_keys', 0""")
def q_mapping(spark, d):
    m = sampling.hash_letters(i.panel(spark, d).select(F.col("user_id").alias("record_id"), F.col("event_type").alias("system_id")), "record_id", "system_id", 3).withColumnRenamed("letter", "candidate_id")
    m = m.where("NOT (record_id % 9 = 4 AND system_id = 'view') AND record_id % 8 <> 3")
    return stages.mapping_faults(m, i.panel(spark, d).select(F.col("user_id").alias("record_id")), i.attempts(spark, d), 5)


@query(f"""WITH {PANEL}, c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k, least(10.0, floor(a / 5) / 2)::DOUBLE AS form, row_number() OVER (PARTITION BY user_id ORDER BY -a, event_type) AS rk FROM panel),
x AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'p' ELSE 'q' END AS source, event_type AS system_id, form, 10.0::DOUBLE - form AS sense, 5.0::DOUBLE AS average_score, rk::DOUBLE AS rank_position FROM c),
p AS (SELECT source, system_id, count(*) AS n, avg(form) AS form, avg(sense) AS sense, avg(average_score) AS average_score, avg(rank_position) AS rank_position FROM x GROUP BY ALL)
SELECT source, system_id, n, round(form, 8) AS form, round(sense, 8) AS sense, round(average_score, 8) AS average_score, round(rank_position, 8) AS rank_position FROM p UNION ALL SELECT 'overall', system_id, sum(n)::BIGINT, round(avg(form), 8), round(avg(sense), 8), round(avg(average_score), 8), round(avg(rank_position), 8) FROM p GROUP BY system_id""")
def a_judge_summary(spark, d):
    a = i.answers(spark, d)
    mapping = a.select("user_id", F.explode("mapping").alias("m")).select("user_id", "m.candidate_id", "m.system_id")
    rows = judge.explode_scores(judge.parse(a, "raw"), "user_id", mapping, ["form", "sense"]).withColumn("source", F.when(F.col("user_id") % 3 == 0, "p").otherwise("q"))
    return rounded(summary.macro_average(rows, "source", "system_id", ["form", "sense", "average_score", "rank_position"], ["p", "q"]))


@query(f"""WITH {PANEL} SELECT user_id, string_agg('Candidate ' || chr((64 + k)::INT) || ':' || chr(10) || event_type, chr(10) || chr(10) ORDER BY k) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k FROM panel) GROUP BY user_id""")
def p_judge_prompt(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_type"))  # a record has five systems
    p = i.panel(spark, d).select("user_id", "event_type", F.chr(F.lit(64) + k).alias("letter"))
    return judge.prompt(p, "user_id", "letter", "event_type")


@query(f"""WITH {PAIRED_SQL}, e AS (SELECT family, count(*) AS n, avg(x) AS nt, avg(y) AS t, avg(y - x) AS delta FROM prs WHERE user_id % 10 <> 3 GROUP BY family) SELECT family, n, round(nt, 8) AS mean_x, round(t, 8) AS mean_y, round(delta, 8) AS delta FROM e""")
def i_small_source_exclusion(spark, d):
    own = pairs.families(i.panel(spark, d).where("user_id % 10 <> 3"), "user_id", "event_type", "a", FAMILIES)
    return rounded(pairs.effects(own, ["family"]).select("family", "n", "mean_x", "mean_y", "delta"))


@query(f"""WITH {PANEL}, prs AS (SELECT j AS judge, family, x.user_id, CASE j WHEN 'a' THEN x.a ELSE x.b END AS x, CASE j WHEN 'a' THEN y.a ELSE y.b END AS y FROM (VALUES ('one', 'view', 'click'), ('two', 'signup', 'purchase')) fam(family, sx, sy), (VALUES ('a'), ('b')) js(j), panel x, panel y WHERE x.event_type = sx AND y.event_type = sy AND y.user_id = x.user_id),
e AS (SELECT judge, family, count(*) AS n, avg(y - x) AS delta, {_DZ.format(d='(y - x)')} FROM prs GROUP BY judge, family)
SELECT judge, family, n, round(delta, 8) AS delta, dz, dz_status, CASE WHEN max(sign(delta)) OVER w = 0 AND min(sign(delta)) OVER w = 0 THEN 'both_tie' WHEN count(*) FILTER (delta = 0) OVER w > 0 THEN 'one_tie' WHEN max(sign(delta)) OVER w = min(sign(delta)) OVER w THEN 'same' ELSE 'opposite' END AS agreement FROM e WINDOW w AS (PARTITION BY family)""")
def i_within_family(spark, d):
    long = i.panel(spark, d).select("user_id", "event_type", F.explode(F.array(F.struct(F.lit("a").alias("judge"), F.col("a").alias("v")), F.struct(F.lit("b").alias("judge"), F.col("b").alias("v")))).alias("j"))
    long = long.select(F.concat_ws(":", "j.judge", F.col("user_id").cast("string")).alias("unit"), "event_type", "j.v")
    e = pairs.families(long, "unit", "event_type", "v", FAMILIES).withColumn("judge", F.substring("unit", 1, 1))
    e = pairs.effects(e, ["judge", "family"]).select("judge", "family", "n", "delta", "dz", "dz_status")
    w, sign = Window.partitionBy("family"), F.signum("delta")  # a family has a row per judge
    ties = F.sum((F.col("delta") == 0).cast("int")).over(w)
    return rounded(e.withColumn("agreement", F.when(ties == 2, "both_tie").when(ties == 1, "one_tie").when(F.max(sign).over(w) == F.min(sign).over(w), "same").otherwise("opposite")))


@query(f"""WITH {PANEL}, pd AS (SELECT x.user_id, x.event_type || '-' || y.event_type AS pair, y.a - x.a AS da, y.b - x.b AS db FROM panel x JOIN panel y ON x.user_id = y.user_id AND x.event_type < y.event_type),
m AS (SELECT event_type, avg(a) AS a, avg(b) AS b FROM panel GROUP BY event_type)
SELECT 'pooled' AS analysis, 'all' AS name, count(*) AS n, round(corr(a, b), 8) AS pearson FROM panel UNION ALL SELECT 'per_system', event_type, count(*), round(corr(a, b), 8) FROM panel GROUP BY event_type
UNION ALL SELECT 'paired_delta', pair, count(*), round(corr(da, db), 8) FROM pd GROUP BY pair UNION ALL SELECT 'system_means', 'all', count(*), round(corr(a, b), 8) FROM m""")
def i_alignment(spark, d):
    p = i.panel(spark, d)
    other = p.select("user_id", F.col("event_type").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    delta = p.join(other, "user_id").where("event_type < o").select(F.concat_ws("-", "event_type", "o").alias("name"), (F.col("oa") - F.col("a")).alias("a"), (F.col("ob") - F.col("b")).alias("b"))  # five systems a user
    means = p.groupBy("event_type").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    parts = [("pooled", p.withColumn("name", F.lit("all"))), ("per_system", p.withColumn("name", F.col("event_type"))), ("paired_delta", delta), ("system_means", means.withColumn("name", F.lit("all")))]
    out = [x.groupBy("name").agg(F.count(F.lit(1)).alias("n"), pairs.pearson(F.col("a"), F.col("b")).alias("pearson")).select(F.lit(k).alias("analysis"), "name", "n", "pearson") for k, x in parts]
    return rounded(gates.union(*out))


@query()
def i_correlation_difference(spark, d):
    p = i.panel(spark, d).withColumn("y", F.col("a") + F.col("b") / 3)
    return rounded(resample.correlation_difference(p, "event_type", "user_id", "a", "b", "y", 2000, resample.analysis_seed(SEED, "difference")))
