"""Structured judge answers: parsing, validation, explosion, and the prompts that ask for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_step, strip, text

ANSWER = (
    "candidate_scores array<struct<candidate_id:string,scores:map<string,double>,reasons:map<string,string>,average_score:double,major_errors:array<string>>>, "
    "ranking array<string>, ranking_reason string"
)


def unfence(c: Column) -> Column:
    """The text of a bare JSON object, or of exactly one whole code fence around one; else null."""
    bare = strip(c)
    inside = F.regexp_extract(bare, r"(?s)^```(?:json)?[ \t]*\n(.*?)\n?```$", 1)
    own = strip(F.when(bare.startswith("```"), inside).otherwise(bare))
    return F.when(own.startswith("{") & own.endswith("}") & ~own.contains("```"), own)


def parse(answers: DataFrame, raw: str) -> DataFrame:
    """``answer`` (null where the text isn't one JSON object) beside all columns."""
    return answers.withColumn("answer", F.from_json(unfence(F.col(raw)), ANSWER, {"mode": "PERMISSIVE"}))


def faults(parsed: DataFrame, expected: str, dims: list[str]) -> DataFrame:
    """Counts per answer of what is wrong with it. ``expected``: array of the candidate ids asked for."""
    c = F.col("answer.candidate_scores")
    ids = F.transform(c, lambda x: x["candidate_id"])
    known = F.array(*map(F.lit, dims))
    every = lambda f: F.coalesce(F.aggregate(F.transform(c, f), F.lit(0), lambda a, b: a + b), F.lit(0))
    count = lambda arr, bad: F.size(F.filter(arr, bad))
    value = lambda x, d: F.element_at(x["scores"], d)
    flag = lambda ok: F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)
    return parsed.withColumns(
        {
            "unparsed": flag(F.col("answer").isNotNull() & c.isNotNull()),
            "candidates": flag(F.array_sort(ids) == F.array_sort(F.col(expected))),
            "missing_scores": every(lambda x: count(known, lambda d: value(x, d).isNull())),
            "extra_dimensions": every(lambda x: F.size(F.array_except(F.map_keys(x["scores"]), known))),
            "out_of_range": every(lambda x: count(known, lambda d: F.coalesce(~value(x, d).between(0, 10), F.lit(False)))),
            "off_step": every(lambda x: count(known, lambda d: F.coalesce(~half_step(value(x, d)), F.lit(False)))),
            "blank_reasons": every(lambda x: count(known, lambda d: strip(F.element_at(x["reasons"], d)) == "")),
            "errors_not_listed": every(lambda x: x["major_errors"].isNull().cast("int")),
            "ranking": flag(F.array_sort("answer.ranking") == F.array_sort(F.col(expected))),
        }
    )


FAULTS = ["unparsed", "candidates", "missing_scores", "extra_dimensions", "out_of_range", "off_step", "blank_reasons", "errors_not_listed", "ranking"]


def explode_scores(parsed: DataFrame, record: str, mapping: DataFrame, dims: list[str]) -> DataFrame:
    """record, system_id, rank_position, average_score (recomputed over dims) and a column per dimension.

    mapping: record, candidate_id, system_id. Candidates that it doesn't name fall out.
    """
    each = parsed.select(record, F.col("answer.ranking").alias("ranking"), F.explode("answer.candidate_scores").alias("c"))
    scores = [F.element_at("c.scores", d).alias(d) for d in dims]
    out = each.select(record, F.col("c.candidate_id").alias("candidate_id"), F.array_position("ranking", F.col("c.candidate_id")).cast("int").alias("rank_position"), *scores)
    mean = sum((F.col(d) for d in dims), F.lit(0.0)) / len(dims)
    return out.withColumn("average_score", mean).join(mapping, [record, "candidate_id"]).drop("candidate_id")


def candidates(records: DataFrame, systems: DataFrame, outputs: DataFrame, record: str, system: str) -> DataFrame:
    """Every (record, system) with its text and whether it is usable: ok and not blank. ``systems`` is a small dimension table."""
    grid = records.select(record).join(F.broadcast(systems.select(system)), how="cross")
    out = grid.join(outputs, [record, system], "left")
    return out.withColumn("matched", F.coalesce((F.col("status") == "ok") & (strip(F.col("output_text")) != ""), F.lit(False)))


def prompt(rows: DataFrame, record: str, letter: str, output: str) -> DataFrame:
    """Per record the candidates' texts in letter order, as blocks with a blank line between."""
    block = F.concat(F.lit("Candidate "), F.col(letter), F.lit(":\n"), strip(F.col(output)))
    each = rows.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(letter).alias("l"), block.alias("b")))).alias("x"))
    return each.select(record, F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("candidates"))


def messages(source: Column, templates: dict[str, tuple[str, str]], version: Column) -> Column:
    """Chat messages of a prompt version (its system text, the start of its user text); unknown versions are an error."""
    out = F.raise_error(F.concat(F.lit("unknown prompt version: "), text(version))).cast("array<struct<role:string,content:string>>")
    for name, (system, user) in templates.items():
        own = F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
            F.struct(F.lit("user").alias("role"), F.concat(F.lit(user), strip(source)).alias("content")),
        )
        out = F.when(version == name, own).otherwise(out)
    return out


def leaks(chat: Column, reference: Column, names: list[str]) -> Column:
    """Whether the messages hold the reference text or a forbidden field name."""
    payload = F.to_json(chat)
    held = (strip(reference) != "") & F.exists(chat, lambda m: F.contains(m["content"], strip(reference)))
    for n in names:
        held = held | payload.contains(n)
    return held


def split_system(chat: Column) -> Column:
    """(system: system parts joined by a blank line, messages: the others; unknown roles count as user)."""
    parts = F.transform(F.filter(chat, lambda m: m["role"] == "system"), lambda m: m["content"])
    rest = F.transform(
        F.filter(chat, lambda m: m["role"] != "system"),
        lambda m: F.struct(F.when(m["role"].isin("user", "assistant"), m["role"]).otherwise("user").alias("role"), m["content"].alias("content")),
    )
    return F.struct(F.array_join(parts, "\n\n").alias("system"), rest.alias("messages"))


def content_blocks(raw: Column) -> Column:
    """(text joined without separator, thinking joined by line breaks) of a JSON list of content blocks."""
    blocks = F.from_json(raw, "array<struct<type:string,text:string,thinking:string>>")
    pick = lambda kind, field: F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: text(b[field]))
    return F.struct(F.array_join(pick("text", "text"), "").alias("text"), F.array_join(pick("thinking", "thinking"), "\n").alias("thinking"))


def token_number(raw: Column, field: str) -> Column:
    """A token count of a JSON usage object: details first, then the object."""
    nested = F.get_json_object(raw, f"$.completion_tokens_details.{field}")
    return F.coalesce(nested, F.get_json_object(raw, f"$.{field}")).try_cast("double")


#: What two kinds of judge services are asked with: fixed values of their protocols.
SERVICES = {
    "plain": {"temperature": 0.0, "max_tokens": 8192, "stream": False, "thinking": {"type": "disabled"}},
    "reasoning": {"reasoning_effort": "high", "stream": False, "response_format": {"type": "json_object"}, "max_completion_tokens": 8192},
}


def request(prompt_text: Column, model: str, service: str) -> Column:
    """The JSON body that asks a judge of a kind of service."""
    head = json.dumps({"model": model}, ensure_ascii=False)[:-1]
    tail = json.dumps(SERVICES[service])[1:]
    body = F.to_json(F.array(F.struct(F.lit("user").alias("role"), text(prompt_text).alias("content"))))
    return F.concat(F.lit(head + ', "messages": '), body, F.lit(", " + tail))


def answer(response: Column) -> Column:
    """(content, reasoning, model, input and output tokens) of a service's JSON response; missing parts are empty or null."""
    get = lambda path: F.get_json_object(response, path)
    return F.struct(
        text(get("$.choices[0].message.content")).alias("content"), text(get("$.choices[0].message.reasoning_content")).alias("reasoning"), get("$.model").alias("model"),
        get("$.usage.prompt_tokens").try_cast("long").alias("input_tokens"), get("$.usage.completion_tokens").try_cast("long").alias("output_tokens"),
    )


def run(prompts: DataFrame, record: str, ask, done: DataFrame | None = None) -> DataFrame:
    """Judge what isn't judged yet. prompts: record, candidates, expected (letters), mapping; ``ask`` gives ``raw`` answers to ``candidates``.

    An answer whose JSON is broken or isn't about the expected candidates keeps its row, with status ``invalid``.
    """
    work = prompts if done is None else prompts.join(done.where("status = 'ok'").select(record), record, "left_anti")
    asked = parse(ask(work), "raw")
    named = F.transform("answer.candidate_scores", lambda c: c["candidate_id"])
    good = F.col("answer").isNotNull() & F.coalesce(F.array_sort(named) == F.array_sort("expected"), F.lit(False))
    return asked.withColumn("status", F.when(good, "ok").otherwise("invalid"))
