"""Queries of whole inference tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import normal_p_sql, signed_rank_p_sql, t_p_sql
from ..operators import analyses, models, pairs, resample, summary
from ..sources.staging import written
from . import inputs as i
from .inputs import PANEL, RATE, rounded
from .queries import _DRAWS, _DZ, _FE, _H, _PART, _SL, FAMILIES, FAMILY_SQL, MDE, SEED, query

COLUMNS = "n, mean_x, mean_y, delta, dz, dz_status, direction, ci_low, ci_high, n_ranked, w, p, p_method"
TABLE = ["family", "measure", *COLUMNS.split(", "), "p_holm"]


def bundle_sql(unit: str, tag: str = "", by: str = "family, measure", prs: str = "prs") -> str:
    """CTEs that end in ``bundle``: pairs ``prs`` (by, unit, x, y) to a row per group, rounded."""
    t, w = tag, resample.weight_sql(_H.format(s=f"'{SEED}:' || d || ':' || {unit}"))
    return f"""eff{t} AS (SELECT {by}, count(*) AS n, round(avg(x), 8) AS mean_x, round(avg(y), 8) AS mean_y, avg(y - x) AS delta, {_DZ.format(d='(y - x)')}, CASE WHEN avg(y - x) > 0 THEN 'up' WHEN avg(y - x) < 0 THEN 'down' ELSE 'tie' END AS direction FROM {prs} GROUP BY {by}),
rk{t} AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY {by}, abs(d)) AS t FROM (SELECT {by}, round(y - x, 9) AS d FROM {prs}) WHERE d <> 0),
st{t} AS (SELECT {by}, count(*) AS n_ranked, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0))::DOUBLE AS w, sum(t * t - 1)::DOUBLE AS ties FROM rk{t} GROUP BY {by}),
pv{t} AS (SELECT {by}, n_ranked, w, {signed_rank_p_sql('w', 'n_ranked', 'ties', '0')} AS p FROM st{t}),
dr{t} AS (SELECT {by}, d, sum(k * (y - x)) / nullif(sum(k), 0) AS m FROM (SELECT {by}, d, x, y, {w} AS k FROM {prs}, range({_DRAWS}) r(d)) GROUP BY {by}, d),
ci{t} AS (SELECT {by}, round(quantile_cont(m, 0.025), 8) AS ci_low, round(quantile_cont(m, 0.975), 8) AS ci_high FROM dr{t} GROUP BY {by}),
bundle{t} AS (SELECT {by}, n, mean_x, mean_y, round(delta, 8) AS delta, dz, dz_status, direction, ci_low, ci_high, coalesce(n_ranked, 0) AS n_ranked, round(w, 8) AS w, coalesce(p, 1.0) AS p, CASE WHEN p IS NULL THEN 'no_differences' ELSE 'approx' END AS p_method
  FROM eff{t} JOIN ci{t} USING ({by}) LEFT JOIN pv{t} USING ({by}))"""


def holm_sql(of: str, by: str, m: str) -> str:
    """The rows of ``of`` with p_holm and p rounded."""
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT * EXCLUDE (p, k, cnt), round(p, 8) AS p, round(max(least(1.0, ({m} - k + 1) * p)) OVER ({part} ORDER BY k), 8) AS p_holm FROM (SELECT *, row_number() OVER ({part} ORDER BY p) AS k, count(*) OVER ({part}) AS cnt FROM {of})"


_RATED = f"""{RATE}, cp AS (SELECT record, system, rater, avg(score) AS c FROM rate GROUP BY ALL HAVING count(*) = 6 AND count(DISTINCT dim) = 6),
long AS (SELECT record, system, dim AS measure, avg(score) AS v FROM rate GROUP BY ALL UNION ALL SELECT record, system, 'COMPOSITE', avg(c) FROM cp GROUP BY ALL),
fam(family, sx, sy) AS (VALUES ('one', 's0', 's1'), ('two', 's2', 's3')),
prs AS (SELECT family, x.measure, x.record, x.v AS x, y.v AS y FROM fam JOIN long x ON x.system = sx JOIN long y ON y.system = sy AND y.record = x.record AND y.measure = x.measure)"""
RATED_FAMILIES = {"one": ("s0", "s1"), "two": ("s2", "s3")}
HOW = {"n_draws": _DRAWS, "seed": SEED, "exact_up_to": 0}


def _rated(spark, d):
    return analyses.rated(i.ratings(spark, d), "record", "system", "rater", "dim", "score", 6)


@query(f"WITH {_RATED}, {bundle_sql('record')} {holm_sql('bundle', '', '21')}")
def i_rated_pairs(spark, d):
    return rounded(analyses.paired_table(_rated(spark, d), "record", "system", RATED_FAMILIES, holm_by=[], family_size=21, **HOW))


@query(f"""WITH {_RATED}, s AS (SELECT family, measure, avg(y - x) AS delta, stddev_samp(y - x) AS sd FROM prs GROUP BY ALL)
SELECT family, measure, round(delta, 8) AS delta, alpha, round(dz_least, 8) AS dz_least, round(sd * dz_least, 8) AS least, abs(delta) >= sd * dz_least AS found FROM s, (VALUES ('0.05', 0.6604416544::DOUBLE), ('0.05/21', 0.9888366073::DOUBLE)) a(alpha, dz_least)""")
def m_least_effects(spark, d):
    p = analyses.measured_pairs(_rated(spark, d), "record", "system", RATED_FAMILIES)
    return rounded(analyses.least_effects(pairs.effects(p, ["family", "measure"]), p, ["family", "measure"], MDE))


_JUDGED = f"""{PANEL}, {FAMILY_SQL}, long AS (SELECT user_id, event_type, 'score' AS measure, a AS v FROM panel UNION ALL SELECT user_id, event_type, 'rank', row_number() OVER (PARTITION BY user_id ORDER BY a DESC, event_type)::DOUBLE FROM panel),
prs AS (SELECT family, x.measure, x.user_id, x.v AS x, y.v AS y FROM fam JOIN long x ON x.event_type = sx JOIN long y ON y.event_type = sy AND y.user_id = x.user_id AND y.measure = x.measure)"""


def _judged(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("a"), "event_type")).cast("double")  # a record has five systems
    each = F.array(F.struct(F.lit("score").alias("measure"), F.col("a").alias("value")), F.struct(F.lit("rank").alias("measure"), F.col("k").alias("value")))
    return i.panel(spark, d).withColumn("k", k).select("user_id", "event_type", F.explode(each).alias("m")).select("user_id", "event_type", "m.*")


@query(f"WITH {_JUDGED}, {bundle_sql('user_id')} {holm_sql('bundle', '', '6')}")
def i_judged_pairs(spark, d):
    return rounded(analyses.paired_table(_judged(spark, d), "user_id", "event_type", FAMILIES, holm_by=[], family_size=6, **HOW))


#: The second judge's scores in sevenths: means of whole cents would lie on the edge of rounding.
PANEL7 = PANEL.replace("max(value) AS b", "max(value) / 7 AS b")


def _panel7(spark, d):
    return i.panel(spark, d).withColumn("b", F.col("b") / 7)


COMPARISONS = {"low": ("view", "click"), "high": ("click", "signup"), "span": ("view", "signup")}
_LONG = f"""{PANEL7}, fam(family, sx, sy) AS (VALUES ('low', 'view', 'click'), ('high', 'click', 'signup'), ('span', 'view', 'signup')), long AS (SELECT user_id, event_type, unnest(['a', 'b', 'mid']) AS measure, unnest([a, b, (a + b) / 2]) AS v FROM panel),
prs AS (SELECT family, x.measure, x.user_id, x.v AS x, y.v AS y FROM fam JOIN long x ON x.event_type = sx JOIN long y ON y.event_type = sy AND y.user_id = x.user_id AND y.measure = x.measure)"""


def _metrics(spark, d):
    p = _panel7(spark, d).withColumn("mid", (F.col("a") + F.col("b")) / 2)
    return p.unpivot(["user_id", "event_type"], ["a", "b", "mid"], "measure", "value")


@query(f"WITH {_LONG} SELECT family, measure, user_id, round(x, 8) AS x, round(y, 8) AS y FROM prs")
def v_metrics_by_comparison(spark, d):
    return rounded(analyses.measured_pairs(_metrics(spark, d), "user_id", "event_type", COMPARISONS))


@query(f"WITH {_LONG}, {bundle_sql('user_id')} {holm_sql('bundle', 'measure', 'cnt')}")
def i_intensity(spark, d):
    return rounded(analyses.paired_table(_metrics(spark, d), "user_id", "event_type", COMPARISONS, holm_by=["measure"], **HOW))


_OPEN = _LONG.replace("), ('high', 'click', 'signup'), ('span', 'view', 'signup')", ")")
assert _OPEN != _LONG


@query(f"""WITH {_OPEN}, auto AS (SELECT * FROM prs WHERE measure <> 'b'), jdg AS (SELECT * FROM prs WHERE measure = 'b'), {bundle_sql('user_id', '1', prs='auto')}, {bundle_sql('user_id', '2', prs='jdg')}
SELECT *, 'automatic' AS layer FROM ({holm_sql('bundle1', '', 'cnt')}) UNION ALL BY NAME SELECT * REPLACE (round(p, 8) AS p), 'judge' AS layer, NULL::DOUBLE AS p_holm FROM bundle2""")
def i_open_weight(spark, d):
    m, one = _metrics(spark, d), {"low": COMPARISONS["low"]}
    table = lambda where: analyses.paired_table(m.where(where), "user_id", "event_type", one, holm_by=[], **HOW)
    return rounded(analyses.layered([("automatic", table("measure <> 'b'"), True), ("judge", table("measure = 'b'"), False)]))


_WITHIN = f"""{PANEL7}, {FAMILY_SQL}, long AS (SELECT user_id, event_type, unnest(['a', 'b']) AS measure, unnest([a, b]) AS v FROM panel),
prs AS (SELECT family, x.measure, x.user_id, x.v AS x, y.v AS y FROM fam JOIN long x ON x.event_type = sx JOIN long y ON y.event_type = sy AND y.user_id = x.user_id AND y.measure = x.measure)"""


@query(f"""WITH {_WITHIN}, {bundle_sql('user_id')}, h AS ({holm_sql('bundle', '', 'cnt')})
SELECT * EXCLUDE measure, measure AS judge, CASE WHEN count(*) FILTER (delta = 0) OVER f = 2 THEN 'both_tie' WHEN count(*) FILTER (delta = 0) OVER f > 0 THEN 'one_tie' WHEN max(sign(delta)) OVER f = min(sign(delta)) OVER f THEN 'same' ELSE 'opposite' END AS agreement FROM h WINDOW f AS (PARTITION BY family)""")
def i_within_family_tests(spark, d):
    return rounded(analyses.within_family(_panel7(spark, d), "user_id", "event_type", ["a", "b"], FAMILIES, **HOW))


_PREFERENCE = f"""{_FE}, est AS (SELECT inside - outside AS estimate, sqrt(uu / pow(0.5 * cells * share * (1 - share), 2) * r / (r - 1) * (2 * r * s - 1) / (2 * r * s - r - s - 1)) AS se, (2 * r * s)::BIGINT AS n_obs, (r - 1)::BIGINT AS df FROM w, u),
loo AS (SELECT o.e AS excluded, avg(d) FILTER (f = 1) - avg(d) FILTER (f = 0) AS estimate FROM dd, (SELECT DISTINCT event_type AS e FROM dd) o WHERE event_type <> o.e GROUP BY o.e),
bo AS (SELECT dr, sum(k * d) FILTER (f = 1) / nullif(sum(k) FILTER (f = 1), 0) - sum(k * d) FILTER (f = 0) / nullif(sum(k) FILTER (f = 0), 0) AS m FROM (SELECT dr, f, d, {resample.weight_sql(_H.format(s=f"'{SEED}:' || dr || ':' || user_id"))} AS k FROM dd, range({_DRAWS}) r(dr)) GROUP BY dr)"""


@query(f"WITH {_PREFERENCE} SELECT excluded, round(estimate, 8) AS estimate FROM loo")
def a_leave_one_system_out(spark, d):
    return rounded(models.leave_one_system_out(i.panel(spark, d), "user_id", "event_type", "a", "b", ["view", "click"]))


@query(f"""WITH {_PREFERENCE} SELECT round(estimate, 8) AS estimate, round(se, 8) AS se, n_obs, df, round(estimate / se, 8) AS t, round({t_p_sql('(estimate / se)', 'df')}, 8) AS p, (SELECT round(quantile_cont(m, 0.025), 8) FROM bo) AS ci_low, (SELECT round(quantile_cont(m, 0.975), 8) FROM bo) AS ci_high,
  (SELECT round(min(estimate), 8) FROM loo) AS least_without_one, (SELECT round(max(estimate), 8) FROM loo) AS most_without_one FROM est""")
def m_fe_preference(spark, d):
    return rounded(models.fe_preference(i.panel(spark, d), "user_id", "event_type", "a", "b", ["view", "click"], _DRAWS, SEED))


_SL_FIT = f"""{_SL}, sl AS (SELECT b, sqrt(m / (sxx * sxx) * r / (r - 1) * (n - 1) / (n - r - s)) AS se, n::BIGINT AS n, (r - 1)::BIGINT AS df, 1 - ((SELECT sum(y * y) FROM dm) - b * b * sxx) / (SELECT var_pop(a) * count(*) FROM panel) AS r2 FROM f, m, c)"""


@query(f"""WITH {_SL_FIT}, {FAMILY_SQL}, prs AS (SELECT family, x.user_id, x.a - y.a AS ds, x.b - y.b AS dw, (x.b + y.b) / 2 AS mw FROM fam JOIN panel x ON x.event_type = sx JOIN panel y ON y.event_type = sy AND y.user_id = x.user_id),
g AS (SELECT family, count(*) AS n, avg(ds) AS my, avg(dw) AS mx, regr_slope(ds, dw) AS b, regr_sxx(ds, dw) AS sxx FROM prs GROUP BY family),
e AS (SELECT family, sum(pow((dw - mx) * (ds - my - b * (dw - mx)) / (1 - 1.0::DOUBLE / n - pow(dw - mx, 2) / sxx), 2)) AS meat, sum(pow(ds - my - b * (dw - mx), 2)) AS rss, sum(pow(ds - my, 2)) AS tss FROM prs JOIN g USING (family) GROUP BY family),
h AS (SELECT family, n, b, sqrt(meat) / sxx AS se, 1 - rss / tss AS r2, my, mx FROM g JOIN e USING (family)),
tl AS (SELECT *, ntile(3) OVER (PARTITION BY family ORDER BY mw, user_id::VARCHAR) AS tertile FROM prs)
SELECT 'candidate_fixed_effect' AS analysis, 'all' AS family, 'all' AS bucket, n, round(b, 8) AS estimate, round(se, 8) AS se, round(b / se, 8) AS t, round({t_p_sql('(b / se)', 'df')}, 8) AS p, round(r2, 8) AS r_squared, NULL::DOUBLE AS mean_score_delta, NULL::DOUBLE AS mean_word_delta, NULL::BIGINT AS positive, NULL::DOUBLE AS least_words, NULL::DOUBLE AS most_words FROM sl
UNION ALL SELECT 'within_family_regression', family, 'all', n, round(b, 8), round(se, 8), round(b / se, 8), round({t_p_sql('(b / se)', '(n - 2)')}, 8), round(r2, 8), round(my, 8), round(mx, 8), NULL, NULL, NULL FROM h
UNION ALL SELECT 'length_bucket', family, ['short', 'middle', 'long'][tertile], count(*), round(avg(ds), 8), NULL, NULL, NULL, NULL, round(avg(ds), 8), round(avg(dw), 8), count(*) FILTER (ds > 0), round(min(mw), 8), round(max(mw), 8) FROM tl GROUP BY family, tertile""")
def m_length_confound(spark, d):
    return rounded(models.length_confound(i.panel(spark, d), "user_id", "event_type", "a", "b", FAMILIES))


_IAA = f"""{RATE}, {_PART}, cmp AS (SELECT item, rater, round(avg(score), 9) AS score FROM part GROUP BY item, rater HAVING count(*) = 6 AND count(DISTINCT dim) = 6),
ev AS (SELECT dim, item, rater, score::DOUBLE AS score FROM part UNION ALL SELECT 'COMPOSITE', item, rater, score FROM cmp), pm AS (SELECT dim, item, count(score) AS m FROM ev GROUP BY ALL),
n AS (SELECT dim, count(*) AS n_items, count(*) FILTER (m = 7) AS n_complete FROM pm GROUP BY dim),
c AS (SELECT dim, item, score AS c, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), sz AS (SELECT dim, item, sum(n) AS m FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT l.dim, l.c, r.c AS k, sum(l.n * (r.n - (l.c = r.c)::INT) / (m - 1)) AS o FROM c l JOIN c r ON l.dim = r.dim AND l.item = r.item JOIN sz ON sz.dim = l.dim AND sz.item = l.item GROUP BY ALL),
mg AS (SELECT dim, c, sum(o) AS n FROM o GROUP BY ALL), cu AS (SELECT *, sum(n) OVER (PARTITION BY dim ORDER BY c) AS upto, sum(n) OVER (PARTITION BY dim) AS total FROM mg),
de AS (SELECT l.dim, l.c, r.c AS k, l.n AS nc, r.n AS nk, l.total, pow(r.upto - r.n / 2 - (l.upto - l.n / 2), 2) AS d FROM cu l JOIN cu r ON l.dim = r.dim AND l.c < r.c),
al AS (SELECT dim, 1 - (max(total) - 1) * sum(coalesce(o, 0) * d) / sum(nc * nk * d) AS krippendorff_alpha FROM de LEFT JOIN o USING (dim, c, k) GROUP BY dim),
fl AS (SELECT ev.* FROM ev JOIN pm USING (dim, item) WHERE m = 7), rr AS (SELECT dim, item, rank() OVER (PARTITION BY dim, rater ORDER BY score) + (count(*) OVER (PARTITION BY dim, rater, score) - 1) / 2.0 AS k, pow(count(*) OVER (PARTITION BY dim, rater, score), 2) - 1 AS t FROM fl),
ww AS (SELECT dim, 12 * var_pop(r) * count(*) / nullif(max(m) * max(m) * (pow(count(*), 3) - count(*)) - max(m) * sum(t), 0) AS kendall_w FROM (SELECT dim, item, sum(k)::DOUBLE AS r, sum(t) AS t, count(*)::DOUBLE AS m FROM rr GROUP BY dim, item) GROUP BY dim),
ks AS (SELECT dim, item, score, count(*) AS c FROM part GROUP BY ALL), kp AS (SELECT dim, item, sum(c * (c - 1)) / 42.0::DOUBLE AS p FROM ks GROUP BY dim, item HAVING sum(c) = 7),
ke AS (SELECT dim, sum(q * q) AS pe FROM (SELECT dim, score, sum(c)::DOUBLE / sum(sum(c)) OVER (PARTITION BY dim) AS q FROM ks JOIN kp USING (dim, item) GROUP BY dim, score) GROUP BY dim),
kk AS (SELECT dim, (avg(p) - any_value(pe)) / (1 - any_value(pe)) AS fleiss_kappa FROM kp JOIN ke USING (dim) GROUP BY dim)
SELECT dim, n_items, n_complete, round(krippendorff_alpha, 8) AS krippendorff_alpha, round(kendall_w, 8) AS kendall_w, round(fleiss_kappa, 8) AS fleiss_kappa FROM n LEFT JOIN al USING (dim) LEFT JOIN ww USING (dim) LEFT JOIN kk USING (dim)"""


@query(f"WITH {_IAA}")
def m_agreement(spark, d):
    from .queries import _part

    return rounded(models.agreement(_part(spark, d), "item", "rater", "dim", "score", 7, 6))


def correlations_sql(src: str, by: str) -> str:
    """Correlations with p of ``src`` (by, x, y)."""
    t = lambda r: f"CASE WHEN abs({r}) >= 1 THEN CASE WHEN n > 2 THEN 0.0 ELSE 1.0 END WHEN n > 2 THEN {t_p_sql(f'({r} * sqrt((n - 2) / (1 - {r} * {r})))', '(n - 2)')} END"
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM {src}),
pl AS (SELECT {by}, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(rx::DOUBLE, ry::DOUBLE) END AS s FROM rk GROUP BY {by}),
ce AS (SELECT {by}, x, y, count(*) AS c FROM {src} GROUP BY {by}, x, y),
cc AS (SELECT {', '.join('l.' + c.strip() for c in by.split(','))}, sum(sign(l.x - q.x) * sign(l.y - q.y) * l.c * q.c) / 2.0::DOUBLE AS con FROM ce l JOIN ce q USING ({by}) GROUP BY ALL),
tx AS (SELECT {by}, sum(c * (c - 1) / 2)::DOUBLE AS t2, sum(c * (c - 1) * (c - 2))::DOUBLE AS t3, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS t5 FROM (SELECT {by}, x, count(*) AS c FROM {src} GROUP BY {by}, x) GROUP BY {by}),
ty AS (SELECT {by}, sum(c * (c - 1) / 2)::DOUBLE AS u2, sum(c * (c - 1) * (c - 2))::DOUBLE AS u3, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS u5 FROM (SELECT {by}, y, count(*) AS c FROM {src} GROUP BY {by}, y) GROUP BY {by}),
ta AS (SELECT {by}, con / sqrt((n * (n - 1) / 2.0::DOUBLE - t2) * (n * (n - 1) / 2.0::DOUBLE - u2)) AS kendall, con / sqrt((n::DOUBLE * (n - 1) * (2 * n + 5) - t5 - u5) / 18 + 2 * t2 * u2 / (n::DOUBLE * (n - 1)) + CASE WHEN n > 2 THEN t3 * u3 / (9 * n::DOUBLE * (n - 1) * (n - 2)) ELSE 0 END) AS z
  FROM pl JOIN cc USING ({by}) JOIN tx USING ({by}) JOIN ty USING ({by}) WHERE t2 < n * (n - 1) / 2.0 AND u2 < n * (n - 1) / 2.0),
co AS (SELECT {by}, n, round(r, 8) AS pearson, round({t('r')}, 8) AS pearson_p, round(s, 8) AS spearman, round({t('s')}, 8) AS spearman_p, round(kendall, 8) AS kendall, round({normal_p_sql('z')}, 8) AS kendall_p FROM pl LEFT JOIN ta USING ({by}))"""


@query(f"WITH {PANEL}, f AS (SELECT event_type, floor(a) AS x, floor(b / 3) AS y FROM panel), {correlations_sql('f', 'event_type')} SELECT * FROM co")
def i_correlations(spark, d):
    p = i.panel(spark, d).select("user_id", "event_type", F.floor("a").alias("x"), F.floor(F.col("b") / 3).alias("y"))
    return rounded(pairs.correlations(p, ["event_type"], "x", "y", "user_id"))


@query(f"""WITH {PANEL}, q AS (SELECT user_id, event_type, floor(a) AS a, floor(b / 3) AS b FROM panel), m AS (SELECT event_type, round(avg(a), 9) AS a, round(avg(b), 9) AS b FROM q GROUP BY event_type),
f AS (SELECT 'pooled' AS analysis, 'all' AS name, a AS x, b AS y FROM q UNION ALL SELECT 'per_system', event_type, a, b FROM q UNION ALL SELECT 'paired_delta', l.event_type || '-' || r.event_type, r.a - l.a, r.b - l.b FROM q l JOIN q r ON l.user_id = r.user_id AND l.event_type < r.event_type UNION ALL SELECT 'system_means', 'all', a, b FROM m),
{correlations_sql('f', 'analysis, name')} SELECT * FROM co
UNION ALL BY NAME SELECT 'ranking' AS analysis, event_type AS name, rank() OVER (ORDER BY a DESC)::BIGINT AS n, (rank() OVER (ORDER BY a DESC) - rank() OVER (ORDER BY b DESC))::DOUBLE AS pearson, NULL::DOUBLE AS pearson_p, NULL::DOUBLE AS spearman, NULL::DOUBLE AS spearman_p, NULL::DOUBLE AS kendall, NULL::DOUBLE AS kendall_p FROM m""")
def i_alignment_tests(spark, d):
    """Pooled, per system, paired differences and system means; the ranking rows hold a system's rank (n) and how far the judges' ranks differ (pearson)."""
    from pyspark.sql import Window

    p = i.panel(spark, d).select("user_id", "event_type", F.floor("a").cast("double").alias("a"), F.floor(F.col("b") / 3).cast("double").alias("b"))
    means = p.groupBy("event_type").agg(F.round(F.avg("a"), 9).alias("a"), F.round(F.avg("b"), 9).alias("b"))
    other = p.select("user_id", F.col("event_type").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    delta = p.join(other, "user_id").where("event_type < o").select(F.concat_ws("-", "event_type", "o").alias("name"), (F.col("oa") - F.col("a")).alias("a"), (F.col("ob") - F.col("b")).alias("b"), "user_id")  # five systems a user
    parts = [("pooled", p.withColumn("name", F.lit("all"))), ("per_system", p.withColumn("name", F.col("event_type"))), ("paired_delta", delta), ("system_means", means.withColumns({"name": F.lit("all"), "user_id": F.lit(0)}))]
    rows = None
    for k, x in parts:
        x = x.select(F.lit(k).alias("analysis"), "name", "a", "b", "user_id")
        rows = x if rows is None else rows.unionByName(x)
    out = pairs.correlations(rows, ["analysis", "name"], "a", "b", "user_id")
    ra, rb = (F.rank().over(Window.partitionBy().orderBy(F.desc(c))) for c in ("a", "b"))  # a row per system
    null = F.lit(None).cast("double")
    ranks = means.select(F.lit("ranking").alias("analysis"), F.col("event_type").alias("name"), ra.cast("long").alias("n"), (ra - rb).cast("double").alias("pearson"), *[null.alias(c) for c in out.columns[4:]])
    return rounded(out.unionByName(ranks))


@query()
def i_cross_judge(spark, d):
    panel = written(i.panel(spark, d), "panel")  # seven tables read it
    tables = analyses.cross_judge(panel, "user_id", "event_type", "a", "b", ["view", "click"], FAMILIES, _DRAWS, SEED)
    return rounded(analyses.long_form(tables, ["scope", "judge", "family", "event_type"]))


@query("SELECT lang, string_agg(source || ':' || n, ';' ORDER BY source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def a_source_counts(spark, d):
    return summary.count_string(i.table(spark, d, "documents"), ["lang"], "source", "counts")
