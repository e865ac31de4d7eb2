"""Batch runs: one answer row for each question, with the fields that are asked for."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.config import EngineConfig
from cloakframe.functions import spanlist
from cloakframe.functions.batches import with_columns
from cloakframe.functions.spans import replace_pairs
from cloakframe.operators.cascade import Cascade
from cloakframe.operators.recognizers import guard, routed, trace
from cloakframe.operators.resolve import resolve
from cloakframe.operators.rewrite import baseline_entities, mask, redacted
from cloakframe.schema import BASELINE, TIMINGS

FIELDS = tuple("question pattern_scan_pii entity_trace_pii context_guard_pii confirmed_pii pii_detail quasi_id_risks surrogate_map sanitized_input llm_response final_output recognized_not_replaced stage_timings_ms presidio_sanitized_input presidio_found_piis error".split())


def echo(prompt: Column) -> Column:
    """The responder for runs without a model: the prompt comes back."""
    return prompt


def patiently(send: Callable[[str], str], tries: int = 3, first: float = 5.0, wait: Callable[[float], None] = time.sleep) -> Callable[[Column], Column]:
    """A responder that sends each prompt to a service, in Arrow batches; a call that fails is made again after 5, 10, ... seconds.

    An error with `retry_after` (seconds) waits so long instead. The last failure is raised, so the task fails and is tried again.
    """

    def ask(prompt: str | None) -> str | None:
        for k in range(tries if prompt is not None else 0):
            try:
                return send(prompt)
            except Exception as error:
                if k + 1 == tries:
                    raise
                wait(float(getattr(error, "retry_after", None) or first * 2**k))
        return None

    @F.pandas_udf("string")
    def answered(prompts: pd.Series) -> pd.Series:
        return prompts.map(ask)

    return lambda prompt: answered(prompt)


def stage_times(df: DataFrame, text: str, config: EngineConfig, out: str = "stage_timings_ms") -> DataFrame:
    """Adds the milliseconds of each stage, each run by itself; the second entity stage counts where the first leaves something to verify."""
    stages = Cascade(config)

    def times(t: str | None) -> dict[str, float]:
        marks = [time.perf_counter()]
        found = spanlist.scan(t)
        marks.append(time.perf_counter())
        masked = spanlist.mask(t or "", found)
        high, low = routed(trace(masked, found, stages.recognizer), config)
        marks.append(time.perf_counter())
        if low and config.guard_enabled:
            guard(spanlist.mask(masked, high), low, stages.second, config)
        marks.append(time.perf_counter())
        ms = [1000 * (b - a) for a, b in zip(marks, marks[1:])]
        return dict(zip(("pattern_scan_ms", "entity_trace_ms", "context_guard_ms", "surrogate_gen_ms", "llm_call_ms", "total_ms"), (*ms, 0.0, 0.0, sum(ms))))

    kind = pa.struct([(f"{x}_ms", pa.float64()) for x in ("pattern_scan", "entity_trace", "context_guard", "surrogate_gen", "llm_call", "total")])
    return with_columns(df, {out: TIMINGS}, lambda batch: [pa.array([times(t) for t in batch.column(text).to_pylist()], kind)])


def run_batch(questions: DataFrame, fields: tuple[str, ...] = FIELDS, responder: Callable[[Column], Column] = echo, baseline: Callable[[Column], Column] | None = None, config: EngineConfig = EngineConfig(), idx: str = "idx", text: str = "input", done: DataFrame | None = None, **stages: object) -> DataFrame:
    """(idx, *fields) of each question; rows whose idx is in `done` are left out.

    Texts are read once. Detection runs on the text with fuzzed addresses, but surrogates are put into the question as it
    stands, as is usual for such runs. Each question is a session of its own. `baseline` gives another engine's entities of a
    text (null: not available). Null questions are empty ones. A question on which a recogniser fails has the error, and no text to send.
    """
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    rows = questions if done is None else questions.join(done.select(idx), idx, "left_anti")
    out = mask(rows.select(idx, F.coalesce(text, F.lit("")).alias("question")), idx, "question", config, skip_fuzzed=False, errors="error", **stages)
    every = F.concat("confirmed", "skipped")
    of = lambda s: F.transform(F.filter(every, lambda e: e["source"] == s), lambda e: e["text"])
    reason = F.when(F.col("is_service"), "service_query_location_suppressed").otherwise("topical_geo_filtered")
    none = F.lit(None).cast("string")

    def detail(e: Column, status: Column, why: Column) -> Column:
        return F.struct(e["text"].alias("key"), F.struct(e["type"].alias("type"), F.round(e["score"], 4).alias("score"), e["source"].alias("source"), status.alias("surrogate_status"), why.alias("skip_reason"), none.alias("fuzzed_to")).alias("value"))

    fuzzed = F.transform("fuzzed", lambda p: F.struct(p["original"].alias("key"), F.struct(F.lit("address").alias("type"), F.lit(1.0).alias("score"), F.lit("pattern").alias("source"), F.lit("fuzzed").alias("surrogate_status"), F.lit("service_query_fuzzed").alias("skip_reason"), p["surrogate"].alias("fuzzed_to")).alias("value")))
    details = F.concat(F.transform("confirmed", lambda e: detail(e, none, none)), F.transform("skipped", lambda e: detail(e, F.lit("skipped"), reason)), fuzzed)
    kept = F.concat(F.transform("skipped", lambda e: F.struct(e["text"].alias("value"), e["type"].alias("type"), reason.alias("reason"), none.alias("fuzzed_to"))), F.transform("fuzzed", lambda p: F.struct(p["original"].alias("value"), F.lit("address").alias("type"), F.lit("service_query_fuzzed").alias("reason"), p["surrogate"].alias("fuzzed_to"))))
    out = out.withColumns({
        "pattern_scan_pii": of("pattern"), "entity_trace_pii": of("ner"), "context_guard_pii": of("slm"), "confirmed_pii": F.transform(every, lambda e: e["text"]),
        "pii_detail": _last_wins(details), "quasi_id_risks": F.col("risks"), "surrogate_map": _last_wins(F.transform("pairs", lambda p: F.struct(p["original"].alias("key"), p["surrogate"].alias("value")))),
        "sanitized_input": F.when(F.col("error").isNull(), replace_pairs(F.col("question"), F.col("pairs"))), "recognized_not_replaced": kept,
    })
    if "stage_timings_ms" in fields:
        out = stage_times(out, "question", config)
    out = out.withColumn("llm_response", responder(F.col("sanitized_input")) if {"llm_response", "final_output"} & set(fields) else none)
    if baseline and {"presidio_sanitized_input", "presidio_found_piis"} & set(fields):
        out = baseline_entities(out.withColumn("__other", baseline(F.col("question"))), "__other", "question", "__b")
        out = redacted(out, "question", "__b", "presidio_sanitized_input").withColumn("presidio_found_piis", F.transform("__b", lambda e: F.struct(e["text"].alias("value"), e["type"].alias("type"), e["score"].alias("score"))))
    else:
        out = out.withColumns({"presidio_sanitized_input": none, "presidio_found_piis": F.lit(None).cast(BASELINE)})
    if "final_output" in fields:
        out = resolve(out, "llm_response", "pairs", out="final_output", threshold=config.fuzzy_threshold)
    return out.select(idx, *fields)


def run_in_steps(spark: SparkSession, questions: DataFrame, path: str, every: int = 25, **options: object) -> DataFrame:
    """A batch run that writes its answers after each `every` questions, and goes on where an earlier run stopped.

    `questions` has idx; a step is a range of it, and its answers are one more part of the table at `path`, so a run that breaks off
    loses one step. Returns all answers.
    """
    idx = str(options.get("idx", "idx"))
    spans = questions.agg(F.min(idx).alias("a"), F.max(idx).alias("b")).first()
    try:
        done = spark.read.parquet(path).select(idx)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        done = None
    left = questions if done is None else questions.join(done, idx, "left_anti")
    steps = left.select(F.floor((F.col(idx) - F.lit(spans.a)) / every).alias("k")).distinct().orderBy("k").toLocalIterator() if spans.a is not None else ()
    for step in steps:
        low = spans.a + step.k * every
        run_batch(left.filter((F.col(idx) >= low) & (F.col(idx) < low + every)), **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _last_wins(entries: Column) -> Column:
    """A map from entries; of a repeated key the last one counts, at the place of the first."""
    firsts = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"))), lambda x: ~F.exists(F.slice(entries, F.lit(1), x["i"]), lambda o: o["key"] == x["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda o: o["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["key"].alias("key"), last(x["key"]).alias("value"))))


def text_scores(answers: DataFrame, scorer: Callable[[Column, Column], Column] | None, reply: str = "llm_response", reference: str = "final_output") -> DataFrame:
    """Adds scores (precision, recall, f1) of replies; null without a scorer or where a text is missing."""
    kind = "struct<precision:double,recall:double,f1:double>"
    value = scorer(F.col(reply), F.col(reference)).cast(kind) if scorer else F.lit(None).cast(kind)
    return answers.withColumn("scores", F.when(F.col(reply).isNotNull() & F.col(reference).isNotNull(), value))


def word_overlap(reply: Column, reference: Column) -> Column:
    """A scorer without a model: precision, recall and F1 of the distinct lower-case words of two texts."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\W+"), lambda w: w != ""))
    both, a, b = (F.size(x).cast("double") for x in (F.array_intersect(words(reply), words(reference)), words(reply), words(reference)))
    p, r = F.when(a > 0, both / a).otherwise(0.0), F.when(b > 0, both / b).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
