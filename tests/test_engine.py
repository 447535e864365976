"""Golden values and edge cases of the engine."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import ngram, report, special, ter
from pairwright.functions import text as t
from pairwright.operators import gates, judge, latest, models, pairs, providers, resample, sampling, scoring, stages, summary
from pairwright.sources import files
from pairwright.streaming import attempts as stream


def values(spark, **columns):
    one = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return one.asDict()


def test_text(spark):
    lit = F.lit
    v = values(
        spark, lines=t.lines(lit("a \r\nb\n\n\tc\x0bd 　e")), strip=t.strip(lit("　\x1c x y\t")), han=t.has_han(lit("x詩")), ratio=t.english_ratio(lit("ab詩")), none=t.english_ratio(lit("123")),
        diff=t.line_count_difference(lit("a\nb"), lit("a\n\n")), length=t.length_ratio(lit("ab"), lit("abcd ")), empty=t.length_ratio(lit("x"), lit(" ")), words=t.count_words(lit("it's a 9")),
        flags=t.flag_list(lit('["a", "", " b "]')), bare=t.flag_list(lit("ocr")), no=t.flag_list(lit(None).cast("string")), number=t.finite_or_null(lit("nan")), text=t.finite_or_null(lit("x")),
        half=t.half_step(lit(2.5)), off=t.half_step(lit(2.3)), env=t.env_list(lit("a; b,,c")), url=t.endpoint(lit("http://h/v1/"), "/chat"), twice=t.endpoint(lit("http://h/v1/chat"), "/chat"),
        secret=t.redact(lit("key abc and abcd"), ["abc", "abcd", ""]),
    )
    assert v["lines"] == ["a", "b", "c", "d", "e"]
    assert v["strip"] == "x y"
    assert (v["han"], v["none"], v["diff"], v["length"], v["empty"], v["words"]) == (True, 0.0, 1, 0.5, 0.0, 2)
    assert math.isclose(v["ratio"], 2 / 3)
    assert (v["flags"], v["bare"], v["no"], v["number"], v["text"]) == (["a", "b"], ["ocr"], [], None, None)
    assert (v["half"], v["off"], v["env"], v["url"], v["twice"], v["secret"]) == (True, False, ["a", "b", "c"], "http://h/v1/chat", "http://h/v1/chat", "key [redacted] and [redacted]")
    assert values(spark, s=t.stable_seed(1, lit("a")))["s"] == int(__import__("hashlib").sha256(b"1:a").hexdigest()[:16], 16)


def test_bleu_and_chrf(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat", "a dog barks"), (3, "", "a b"), (4, "the cat sat on a mat today", "the cat sat on the mat"), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    b = {r["k"]: r["s"] for r in ngram.statistics(df, ["k"], "h", "r", ngram.BLEU_ORDERS).select("k", ngram.bleu(True).alias("s")).collect()}
    assert math.isclose(b[1], 100)
    assert (b[2], b[3], b[5]) == (0, 0, 0)
    want = 100 * math.exp(sum(math.log(x) for x in (5 / 7, 3 / 6, 2 / 5, 1 / 4)) / 4)
    assert math.isclose(b[4], want)
    c = {r["k"]: r["s"] for r in ngram.statistics(df, ["k"], "h", "r", ngram.CHRF_ORDERS).select("k", ngram.chrf().alias("s")).collect()}
    assert math.isclose(c[1], 100)
    assert 0 < c[4] < 100
    assert c[3] == c[5] == 0
    assert values(spark, w=ngram.split_words(F.lit('(a, b." c-d !')))["w"] == ["(a", ",", 'b.', '"', "c-d", "!"]


def test_ter():
    assert ter.edits("a b c".split(), "a b c".split()) == 0
    assert ter.edits("c a b".split(), "a b c".split()) == 1
    assert ter.edits("d e f a b c".split(), "a b c d e f".split()) == 1
    assert ter.edits([], "a b".split()) == 2
    assert ter.edits("a x c".split(), "a b c".split()) == 1
    assert (ter.rate(0, 0), ter.rate(2, 0), ter.rate(1, 4)) == (0.0, 100.0, 25.0)


@pytest.mark.parametrize(("p", "want"), [([0.01, 0.04, 0.03, 0.20], [0.04, 0.09, 0.09, 0.20]), ([0.01, 0.02, 0.04, None], [0.03, 0.04, 0.04, None])])
def test_holm(spark, p, want):
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = [r["p_holm"] for r in pairs.holm(df, "p", []).orderBy("k").collect()]
    assert [None if g is None else round(g, 12) for g in got] == want
    declared = [r["p_holm"] for r in pairs.holm(df, "p", [], family_size=10).orderBy("k").collect()]
    assert math.isclose(declared[0], 0.1)


def test_effects(spark):
    rows = [("zero", k, 1.0, 1.0) for k in range(3)] + [("ones", k, 0.0, 1.0) for k in range(3)] + [("steps", k, 0.0, k + 1.0) for k in range(3)]
    got = {r["f"]: r for r in pairs.effects(spark.createDataFrame(rows, "f string, u int, x double, y double"), ["f"]).collect()}
    assert (got["zero"]["dz"], got["zero"]["dz_status"]) == (0.0, "all_zero")
    assert (got["ones"]["dz"], got["ones"]["dz_status"]) == (None, "zero_variance_nonzero")
    assert (got["steps"]["dz"], got["steps"]["dz_status"], got["steps"]["direction"]) == (2.0, "ok", "up")
    assert [r["d"] for r in spark.createDataFrame([("ter_mean", 2.0), ("ter_mean", -3.0), ("chrf", 2.0)], "m string, d double").select(t.oriented_delta(F.col("m"), F.col("d")).alias("d")).collect()] == [-2, 3, 2]


def test_incomplete_pairs(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "u int, s string, v double")
    assert pairs.paired(df, "u", "s", "v", "a", "b").count() == 1
    with pytest.raises(Exception, match="incomplete pair: 2"):
        pairs.paired(df, "u", "s", "v", "a", "b", how="raise").collect()


def test_correlations(spark):
    df = spark.createDataFrame([("g", k, float(k), y) for k, y in enumerate([1.0, 2.0, 3.0, 5.0, 100.0])] + [("c", k, 1.0, float(k)) for k in range(4)], "g string, k int, x double, y double")
    got = {r["g"]: r for r in pairs.correlations(df, ["g"], "x", "y", "k").collect()}
    assert math.isclose(got["g"]["spearman"], 1) and math.isclose(got["g"]["kendall"], 1)
    assert got["g"]["pearson"] < 0.8
    assert (got["c"]["pearson"], got["c"]["spearman"], got["c"]["kendall"]) == (None, None, None)


def test_tau_b_makes_no_pairs(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, 150), rng.integers(0, 5, 150)
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
    rows = [("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    df = pairs.correlations(spark.createDataFrame(rows, "g string, k int, x double, y double"), ["g"], "x", "y", "k")
    assert math.isclose(df.first()["kendall"], want, rel_tol=1e-12)
    # 60,000 rows of distinct values: 1.8e9 pairs.
    many = spark.range(60_000).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.col("id").alias("x"), F.when(F.col("id") < 30_000, F.col("id") + 30_000).otherwise(F.col("id") - 30_000).alias("y"))
    got = pairs.correlations(many, ["g"], "x", "y", "k").first()
    n = 60_000
    assert math.isclose(got["kendall"], 1 - 4 * 30_000**2 / (n * (n - 1)), abs_tol=1e-12)


def test_special_functions():
    assert math.isclose(special.t_sf2(2.093024054, 19), 0.05, abs_tol=1e-8)
    assert math.isclose(special.minimal_dz(20, 0.05), 0.6604416544, abs_tol=2e-6)
    assert math.isclose(special.minimal_dz(20, 0.05 / 21), 0.9888366073, abs_tol=2e-6)
    assert special.wilcoxon_p(0, 5) == 2 / 32
    assert special.wilcoxon_p(3, 6) == 0.15625
    assert special.wilcoxon_p(0, 0) == 1.0


def test_fixed_effects_equal_the_dummy_fit(spark):
    rng = np.random.default_rng(5)
    r, s = 12, 5
    d = [(u, f"s{k}", float(rng.normal()), float(rng.normal() + (1.5 if k < 2 else 0))) for u in range(r) for k in range(s)]
    got = models.fe_interaction(spark.createDataFrame(d, "u int, s string, a double, b double"), "u", "s", "a", "b", ["s0", "s1"]).first()
    x, y, cluster = [], [], []
    for u, k, a, b in d:
        for j, v in ((0, a), (1, b)):
            x.append([1.0, j, j * (k in ("s0", "s1")), *[float(u == i) for i in range(1, r)], *[float(k == f"s{i}") for i in range(1, s)]])
            y.append(v)
            cluster.append(u)
    x, y, cluster = np.array(x), np.array(y), np.array(cluster)
    inv = np.linalg.inv(x.T @ x)
    e = y - x @ (inv @ x.T @ y)
    meat = sum(np.outer(g, g) for g in (x[cluster == u].T @ e[cluster == u] for u in range(r)))
    n, k = x.shape
    var = (inv @ meat @ inv) * r / (r - 1) * (n - 1) / (n - k)
    assert math.isclose(got["estimate"], (inv @ x.T @ y)[2], rel_tol=1e-9)
    assert math.isclose(got["se"], math.sqrt(var[2, 2]), rel_tol=1e-9)
    exact = spark.createDataFrame([(u, f"s{k}", 1.0, 1.0 + 1.5 * (k == 0)) for u in range(20) for k in range(7)], "u int, s string, a double, b double")
    assert math.isclose(models.fe_interaction(exact, "u", "s", "a", "b", ["s0"]).first()["estimate"], 1.5)


def test_hc3(spark):
    x = [1.0, 2.0, 3.0, 5.0, 8.0]
    y = [1.0, 3.0, 2.0, 6.0, 7.0]
    got = models.hc3(spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double"), "y", "x").first()
    m = np.stack([np.ones(5), x], 1)
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ np.array(y)
    e = (np.array(y) - m @ b) / (1 - np.diag(m @ inv @ m.T))
    assert math.isclose(got["slope"], b[1])
    assert math.isclose(got["se"], math.sqrt((inv @ (m.T * e**2) @ m @ inv)[1, 1]))
    with pytest.raises(Exception, match="constant"):
        models.hc3(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "y", "x").collect()


def test_agreement(spark):
    rows = [("d", i, k, float(v)) for i, own in enumerate([(1, 1, 2), (3, 3, 3), (5, 6, 5), (2, 2, 2)]) for k, v in enumerate(own)]
    df = spark.createDataFrame(rows, "dim string, item int, rater int, score double")
    w = models.kendall_w(df, ["dim"], "item", "rater", "score").first()
    assert w["n_items"] == 4 and 0.9 < w["kendall_w"] <= 1
    same = df.where("item = 1 or item = 3")
    assert models.fleiss_kappa(same, ["dim"], "item", "score", 3).first()["fleiss_kappa"] == 1.0
    assert models.krippendorff_alpha(same, ["dim"], "item", "score").first()["krippendorff_alpha"] == 1.0
    assert 0.8 < models.krippendorff_alpha(df, ["dim"], "item", "score").first()["krippendorff_alpha"] < 1


def test_six_raters_rule(spark):
    rows = [(1, a, f"d{k}", k + 1) for a in range(1, 8) for k in range(6) if not (a == 7 and k == 0)]
    got = summary.rater_composites(spark.createDataFrame(rows, "item int, rater int, dim string, score int"), ["item"], "rater", "dim", "score", 6, 6).first()
    assert (got["composite"], got["raters"], got["enough"]) == (3.5, 6, True)


def test_summary_edges(spark):
    rows = [("a", "ok", "x", "v1", "", 1, 1.0, 2.0), ("a", "ok", " ", "v1", "", 2, 1.0, 9.0), ("b", "error", "", "", "late", 4, 1.0, 1.0), ("b", "error", "", "", "first", 3, None, 1.0)]
    got = {r["s"]: r for r in summary.system_summary(spark.createDataFrame(rows, "s string, status string, output_text string, prompt_version string, error string, seq int, latency_seconds double, m double"), ["s"], ["m"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_total"], a["n_ok"], a["n_failed"], a["m_mean"], a["m_sd"], a["m_ci95"]) == (2, 1, 0, 2.0, 0.0, 0.0)
    assert (b["status"], b["metric_errors"], b["m_mean"], b["m_sd"], b["runtime_seconds_total"]) == ("not_available_or_failed", "first", None, None, 1.0)


def test_logs(spark):
    df = spark.createDataFrame([("a", 1, 1, "error"), ("a", 1, 2, "ok"), ("a", 2, 1, "ok"), ("a", 2, 3, "error"), (None, 2, 5, "ok")], "s string, r int, seq int, status string")
    assert {(x["s"], x["r"], x["status"]) for x in latest.latest_wins(df, ["s", "r"], "seq").collect()} == {("a", 1, "ok"), ("a", 2, "error"), (None, 2, "ok")}
    work = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "s string, r int")
    assert latest.remaining(work, df.where("seq > 2"), ["s", "r"]).count() == 2
    assert latest.remaining(work, df.where("seq > 2"), ["s", "r"], retry_failed=True).count() == 3
    shards = latest.shard(spark.range(20).withColumnRenamed("id", "k"), "k", 3).collect()
    assert sorted((r["k"], r["shard"]) for r in shards) == [(k, k % 3) for k in range(20)]


def test_samples(spark):
    df = spark.createDataFrame([(k, "x" if k < 264 else "y" if k < 386 else "z" if k < 392 else "w") for k in range(397)], "k int, g string")
    counts = df.groupBy("g").agg(F.count(F.lit(1)).alias("count"), F.min("k").alias("first"))
    quota = {r["g"]: r["quota"] for r in sampling.allocate(counts, "g", 20, "first").collect()}
    assert quota == {"x": 13, "y": 6, "z": 1, "w": 0}
    assert sorted(r["k"] for r in sampling.head_manifest(df, "g", "k", 20).collect()) == [*range(13), *range(264, 270), 386]
    once = {r["k"] for r in sampling.hash_sample(df, "g", "k", 20, 1).collect()}
    assert len(once) == 20 and once != {r["k"] for r in sampling.hash_sample(df, "g", "k", 20, 2).collect()}
    ids = [("x", ["a", "b", "c"]), ("y", ["d", "e"])]
    assert sampling.seeded_panel(ids, {"x": 2, "y": 1}, 3) == sampling.seeded_panel(ids, {"x": 2, "y": 1}, 3)


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, float("nan")), (3, None), (4, float("inf"))], "k int, v double")
    found = gates.union(gates.row_checks(df, {"finite": gates.finite("v")}), gates.duplicates(df, ["k"]))
    assert {r["check"]: r["n"] for r in found.collect()} == {"finite": 3, "duplicate_keys": 1}
    with pytest.raises(gates.GateError, match="finite: 3"):
        gates.enforce(found)
    gates.enforce(gates.duplicates(df.where("k > 1"), ["k"]))
    bad = spark.createDataFrame([("nan", 1.1, 2.0, 1.0, "in /home/b", "x")], "effect string, p_holm double, ci_lo double, ci_hi double, note string, hypothesis string")
    found = {r["check"]: r["n"] for r in gates.release_audit(bad).collect() if r["n"]}
    assert found == {"not_finite": 1, "probability": 1, "private_place": 1, "forbidden_column": 1, "interval": 1}
    assert {r["check"]: r["n"] for r in gates.release_audit(bad.limit(0).drop("hypothesis")).collect() if r["n"]} == {"empty": 1}
    files_ = gates.release_files(["a.csv", "raw.csv", "b.txt"], {"a.csv", "c.csv"})
    assert files_ == {"missing": ["c.csv"], "unexpected": ["b.txt", "raw.csv"], "not_csv": ["b.txt"], "forbidden": ["raw.csv"]}


def test_judge_answers(spark):
    one = lambda c, form=5.0, reason="r": {"candidate_id": c, "scores": {"form": form, "sense": 7.5}, "reasons": {"form": reason, "sense": "r"}, "average_score": 0, "major_errors": []}
    body = lambda scores, ranking: json.dumps({"candidate_scores": scores, "ranking": ranking, "ranking_reason": "x"})
    good = body([one("A"), one("B", 4.0)], ["B", "A"])
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"so: ```{good}```"), (4, body([one("A", 10.5), one("B", 3.3)], ["A", "B", "A"])), (5, body([one("A", reason=" ")], ["A"])), (6, None)]
    df = spark.createDataFrame([(k, ["A", "B"], raw) for k, raw in rows], "rec int, expected array<string>, raw string")
    got = {r["rec"]: {k: r[k] for k in judge.FAULTS if r[k]} for r in judge.faults(judge.parse(df, "raw"), "expected", ["form", "sense"]).collect()}
    assert got[1] == got[2] == {}
    assert got[3] == got[6] == {"unparsed": 1, "candidates": 1, "ranking": 1}
    assert got[4] == {"out_of_range": 1, "off_step": 1, "ranking": 1}
    assert got[5] == {"candidates": 1, "blank_reasons": 1, "ranking": 1}
    mapping = spark.createDataFrame([(1, "A", "s1"), (1, "B", "s2")], "rec int, candidate_id string, system_id string")
    out = {r["system_id"]: (r["rank_position"], r["average_score"]) for r in judge.explode_scores(judge.parse(df, "raw"), "rec", mapping, ["form", "sense"]).collect()}
    assert out == {"s1": (2, 6.25), "s2": (1, 5.75)}


def test_messages(spark):
    m = judge.messages(F.lit(" 詩 "), {"v": ("be good", "Text: ")}, F.lit("v"))
    v = values(spark, m=m, leak=judge.leaks(m, F.lit("good"), []), none=judge.leaks(m, F.lit(" "), ["reference"]), split=judge.split_system(m))
    assert [tuple(x) for x in v["m"]] == [("system", "be good"), ("user", "Text: 詩")]
    assert (v["leak"], v["none"], v["split"]["system"], len(v["split"]["messages"])) == (True, False, "be good", 1)
    with pytest.raises(Exception, match="unknown prompt version"):
        values(spark, m=judge.messages(F.lit("x"), {"v": ("a", "b")}, F.lit("w")))
    raw = json.dumps([{"type": "thinking", "thinking": "h"}, {"type": "text", "text": "a"}, {"type": "redacted"}, {"type": "thinking", "thinking": "m"}, {"type": "text", "text": "b"}])
    assert tuple(values(spark, c=judge.content_blocks(F.lit(raw)))["c"]) == ("ab", "h\nm")
    usage = json.dumps({"completion_tokens": 5, "completion_tokens_details": {"reasoning_tokens": 3}})
    assert values(spark, a=judge.token_number(F.lit(usage), "reasoning_tokens"), b=judge.token_number(F.lit(usage), "completion_tokens")) == {"a": 3.0, "b": 5.0}


def test_services(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "k int, p string")
    policy = providers.Retry([providers.EchoClient("first", "bad"), providers.EchoClient("second", "bad")], times=2)
    got = {r["k"]: (r["status"], r["attempts"], r["client"]) for r in providers.call(df, "p", policy).collect()}
    assert got == {1: ("ok", 1, "first"), 2: ("error", 4, "second"), 3: ("ok", 1, "first")}
    assert providers.unique_clients([("a", "x"), ("b", "y"), ("a", "x")]) == [("a", "x"), ("b", "y")]


def test_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('﻿{"k": 1, "t": "詩"}\n\n{"k": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_jsonl(spark, str(log), "k int, t string").collect()] == [(1, "詩"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "k int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_rows(spark, str(tmp_path / "none.csv"), "k int")
    log.write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(log), "k int").collect()
    assert [r["corrupt"] for r in files.read_jsonl_located(spark, [str(log)], "k int").collect()] == [None, '{"k": ']
    a, b = f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"
    one = spark.createDataFrame([(1, "x")], "k int, t string")
    files.write_all_or_none({a: one, b: one})
    with pytest.raises(ValueError, match="no rows"):
        files.write_all_or_none({a: one.unionByName(one), b: one.limit(0)})
    assert files.read_rows(spark, a, "k int, t string").count() == 1
    files.write_all_or_none({a: one.unionByName(one), b: one}, {a: ["t", "k"]})
    assert files.read_rows(spark, a, "t string, k int").count() == 2
    assert files.read_env("# c\nA = 'x'\nB=1\nbad\n", {"B": "0"}) == {"A": "x", "B": "0"}
    assert files.read_env("B=1", {"B": "0"}, override=True) == {"B": "1"}
    with pytest.raises(ValueError, match="one destination"):
        files.write_all_or_none({a: one, a + "/": one})


def test_reports(spark):
    v = values(spark, n=report.number(F.lit(1.005)), none=report.number(F.lit(None).cast("double")), q=report.quoted(F.lit("a\nb")))
    assert (v["none"], v["q"]) == ("NA", "> a\n> b")


def test_resampling(spark):
    df = spark.createDataFrame([("g", k, 0.0, float(k % 5)) for k in range(40)], "g string, u int, x double, y double")
    one, two = (resample.numpy_bootstrap(df, "g", "u", 500, 7).first() for _ in range(2))
    assert one == two and one["ci_low"] < one["delta"] < one["ci_high"]
    h = resample.hash_bootstrap(df, "u", "y", 100, 7).first()
    assert h["n_valid"] == 100 and h["ci_low"] < h["mean"] < h["ci_high"]
    flat = resample.correlation_bootstrap(df, "g", "u", "x", "y", 50, 7).first()
    assert (flat["n_valid"], flat["ci_low"]) == (0, None)
    both = df.withColumns({"a": F.col("u") * 1.0, "b": -F.col("u") * 1.0, "z": F.col("u") + F.col("y")})
    gap = resample.correlation_difference(both, "g", "u", "b", "a", "z", 200, 7).first()
    assert gap["difference"] > 1.9 and gap["ci_low"] > 1.8 and math.isclose(gap["p"], 2 / 201)
    assert resample.analysis_seed(1, "a") != resample.analysis_seed(1, "b")
    assert resample.difference_p(np.array([1.0, 2, 3])) == 0.5


def test_mixed_model(spark):
    rng = np.random.default_rng(3)
    rows = [("d", a, p, m, float(2 + 0.7 * m + ra + rp + rng.normal() * 0.1)) for a, ra in enumerate(rng.normal(size=7)) for p, rp in enumerate(rng.normal(size=8)) for m in (0.0, 1.0)]
    got = resample.mixed_model(spark.createDataFrame(rows, "g string, a int, p int, m double, y double"), "g", "y", "m", "a", "p").first()
    plain = np.mean([r[4] for r in rows if r[3]]) - np.mean([r[4] for r in rows if not r[3]])
    assert got["status"] == "ok" and math.isclose(got["coef"], plain, abs_tol=1e-6)


def dense_mixed(rows):
    """coef and se of (a, p, mode, y) by matrices as wide as the rows."""
    a, p, m, y = (np.array(c, float) for c in zip(*rows, strict=True))
    x, zz = np.stack([np.ones(len(y)), m], 1), [(c[:, None] == c).astype(float) for c in (a, p)]

    def fit(theta):
        v = np.eye(len(y)) + np.exp(theta[0]) * zz[0] + np.exp(theta[1]) * zz[1]
        w = np.linalg.inv(v)
        gram = x.T @ w @ x
        b = np.linalg.solve(gram, x.T @ w @ y)
        s2 = (y - x @ b) @ w @ (y - x @ b) / (len(y) - 2)
        return (len(y) - 2) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(gram)[1], b[1], np.sqrt(s2 * np.linalg.inv(gram)[1, 1])

    at, step = np.array([-1.0, -1.0]), 2.0
    while step > 1e-3:
        best = min((fit(np.clip(at + np.array(d) * step, -12, 8))[0], d) for d in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))[1]
        at, step = np.clip(at + np.array(best) * step, -12, 8), step if any(best) else step / 2
    return fit(at)[1:]


def test_mixed_model_equals_the_dense_fit(spark):
    rng = np.random.default_rng(4)
    ra, rp = rng.normal(size=4), rng.normal(size=10)
    rows = [(a, p, m, float(2 + 0.7 * m + ra[a] + rp[p] + rng.normal())) for a in range(4) for p in range(10) for m in (0.0, 1.0) if rng.random() < 0.7]
    for way in (rows, [(p, a, m, y) for a, p, m, y in rows]):
        got = resample.mixed_model(spark.createDataFrame([("d", *r) for r in way], "g string, a int, p int, m double, y double"), "g", "y", "m", "a", "p").first()
        coef, se = dense_mixed(way)
        assert got["status"] == "ok" and math.isclose(got["coef"], coef, abs_tol=1e-4) and math.isclose(got["se"], se, abs_tol=1e-4)


def test_mixed_model_of_many_records(spark):
    """48,000 rows, whose matrices would take 18 GB each."""
    r = spark.range(8000).select(F.lit("g").alias("g"), F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    r = r.select("g", "p", (F.col("k") % 3).alias("a"), F.floor(F.col("k") / 3).cast("double").alias("m"))
    r = r.withColumn("y", 0.7 * F.col("m") + F.col("a") + F.pmod(F.hash("p"), F.lit(7)) + F.pmod(F.hash("p", "a", "m"), F.lit(101)) / 100.0)
    got = resample.mixed_model(r, "g", "y", "m", "a", "p").first()
    assert got["status"] == "ok" and abs(got["coef"] - 0.7) < 0.02


def test_stream(spark, tmp_path):
    rows = lambda a: spark.createDataFrame(a, "k int, seq int, s string")
    log = f"{tmp_path}/log"
    def run():
        q = stream.upsert_latest(stream.read_log(spark, log, rows([(1, 1, "a")]).schema), f"{tmp_path}/state", f"{tmp_path}/cp", ["k"], "seq").trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/v{q.lastProgress['batchId']}").collect()}

    rows([(1, 1, "a"), (2, 2, "b")]).write.parquet(log)
    assert run() == {(1, 1, "a"), (2, 2, "b")}
    rows([(1, 3, "c"), (2, 1, "old")]).write.mode("append").parquet(log)
    assert run() == {(1, 3, "c"), (2, 2, "b")}


def test_scoring(spark):
    outputs = spark.createDataFrame(
        [("s", "1", 1, "ok", "old text", "", "v", 1.0), ("s", "1", 2, "ok", "the cat sat on the mat", "", "v", 2.0), ("s", "2", 3, "error", "", "down", "v", 1.0), ("s", "9", 4, "ok", "x", "", "v", 1.0)],
        "system_id string, record_id string, seq long, status string, output_text string, error string, prompt_version string, latency_seconds double",
    )
    manifest = spark.createDataFrame([("1", "p", "詩", "the cat sat on the mat"), ("2", "p", "詩", "a dog")], "record_id string, source_id string, source string, reference string")
    length = lambda: lambda s, h, r: h.str.len().astype(float)
    def broken():
        raise OSError("no file")

    rows = scoring.score_rows(outputs, manifest, "all", {"semantic": length, "learned": broken}).persist()
    got = {r["record_id"]: r for r in rows.collect()}
    assert set(got) == {"1", "2"}
    assert math.isclose(got["1"]["bleu"], 100) and got["1"]["ter"] == 0 and got["1"]["semantic"] == 22
    assert (got["2"]["bleu"], got["2"]["learned"], got["2"]["learned_error"]) == (None, None, "learned is not available: no file")
    one = scoring.score_systems(rows, 3.0).first()
    assert (one["n_total"], one["n_ok"], one["n_failed"], one["scoring_seconds"]) == (2, 1, 1, 3.0)
    assert math.isclose(one["bleu_corpus"], 100) and math.isclose(one["chrf_corpus"], 100) and one["ter_corpus"] == 0


def test_stage_helpers(spark):
    assert stages.system_paths(["a=x", " b = y=z "]) == {"a": "x", "b": "y=z"}
    for bad in (["a"], ["=x"], ["a=x", "a=y"]):
        with pytest.raises(ValueError, match="SYSTEM=PATH"):
            stages.system_paths(bad)
    stages.shard_paths(["out-shard-1-of-3.jsonl"], 1, 3)
    with pytest.raises(ValueError, match="without"):
        stages.shard_paths(["out.jsonl"], 1, 3)
    with pytest.raises(ValueError, match="shard 3 of 3"):
        stages.shard_paths(["x"], 3, 3)
    report = json.loads(stages.verification_report(spark.createDataFrame([("a", 0), ("b", 2)], "check string, n long"), {"records": 3}))
    assert report == {"records": 3, "violations": {"a": 0, "b": 2}, "passed": False}
    m = "array<struct<candidate_id:string,system_id:string>>"
    own = spark.createDataFrame([("1", [("A", "s")]), ("2", None)], f"record_id string, candidate_map {m}")
    private = spark.createDataFrame([("1", [("A", "t")]), ("2", [("A", "t")])], f"record_id string, candidate_map {m}")
    assert {r["record_id"]: r["candidate_map"][0]["system_id"] for r in stages.with_mapping(own, private).collect()} == {"1": "s", "2": "t"}
