"""Recovery attacks: what a model was asked for, its reply, and how much of the originals it got back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.evaluate import BASELINE_TYPES, LABELS_OF, lookup, merged_type

TYPES = tuple(sorted(LABELS_OF))
EXCLUDED = ("address",)
NAMES = {t: t.replace("_", " ") for t in TYPES} | {"FAC": "facility", "GPE": "city or country", "LOC": "place", "ORG": "organisation", "PERSON": "person's name", "dob": "date of birth", "ssn": "social security number"}
REPLY = "struct<recovery_attempts:array<struct<guessed_original:string,pii_type:string,confidence:double>>,overall_assessment:string>"
RECOVERED = "array<struct<value:string,type:string,confidence:double,address_type:boolean>>"


def detail_types(detail: Column) -> Column:
    """Distinct merged types of a map of details, in order."""
    return F.array_distinct(F.filter(F.transform(F.map_values(detail), lambda d: merged_type(d["type"])), lambda t: t.isNotNull() & (t != "")))


def baseline_types(found: Column) -> Column:
    """Distinct types of the baseline's values, in the names that they are compared by."""
    return F.array_distinct(F.filter(F.transform(found, lambda e: merged_type(lookup(e["type"], BASELINE_TYPES))), lambda t: t.isNotNull() & (t != "")))


def types_list(types: Column) -> Column:
    """One line with a dash for each type; "none" without types."""
    return F.when(F.size(types) > 0, F.array_join(F.transform(types, lambda t: F.concat(F.lit("- "), lookup(t, NAMES))), "\n")).otherwise("- none")


def prompt(text: Column, types: Column) -> Column:
    """What the attacking model is asked."""
    ask = "The text below was sanitized: personal values were replaced. Guess the original value of each type that is listed.\nTypes:\n"
    form = '\nReply with JSON: {"recovery_attempts": [{"pii_type": ..., "guessed_original": ..., "confidence": 0..1}], "overall_assessment": ...}\nText:\n'
    return F.concat(F.lit(ask), types_list(types), F.lit(form), text)


def parse_reply(reply: Column) -> Column:
    """A reply as a struct: fences stripped, read as JSON, else from its first to its last brace; else no attempts and "parse_error"."""
    text = F.regexp_replace(F.regexp_replace(reply, r"(?m)^[ \t]*```.*$", ""), r"\A\s+|\s+\z", "")
    bare = F.when(reply.rlike(r"\A\s*```"), text).otherwise(F.regexp_replace(reply, r"\A\s+|\s+\z", ""))
    outer = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    # Damaged JSON is read as a struct of nulls or as null; only whole JSON parses as a variant.
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).when((outer != "") & F.try_parse_json(outer).isNotNull(), outer)
    failed = F.struct(F.array().cast("array<struct<guessed_original:string,pii_type:string,confidence:double>>").alias("recovery_attempts"), F.when(reply.isNull(), "error").otherwise("parse_error").alias("overall_assessment")).cast(REPLY)
    return F.coalesce(F.from_json(whole, REPLY), failed)


def recovered(parsed: Column, originals: Column) -> Column:
    """Attempts that hit an original (in lower case), with whether they are of an excluded type."""
    attempts = F.coalesce(parsed["recovery_attempts"], F.array())
    hit = F.filter(attempts, lambda a: (F.coalesce(a["guessed_original"], F.lit("")) != "") & F.array_contains(originals, F.lower(a["guessed_original"])))
    return F.transform(hit, lambda a: F.struct(a["guessed_original"].alias("value"), F.coalesce(a["pii_type"], F.lit("")).alias("type"), F.coalesce(a["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(a["pii_type"].isin(*EXCLUDED), F.lit(False)).alias("address_type"))).cast(RECOVERED)


def score_side(df: DataFrame, available: Column, reply: Column, originals: Column, targeted: Column, out: str) -> DataFrame:
    """Adds a struct of one side's counts, rate, recovered values and error."""
    low = F.transform(originals, lambda v: F.lower(v))
    df = df.withColumn("__parsed", F.when(available, parse_reply(reply))).withColumn("__hits", F.when(available, recovered(F.col("__parsed"), low)).otherwise(F.array().cast(RECOVERED)))
    n, addr = F.size("__hits"), F.size(F.filter("__hits", lambda h: h["address_type"]))
    total = F.when(available, targeted).otherwise(0)
    side = F.struct(
        available.alias("available"), total.alias("total_targeted"), n.alias("recovered_count"), addr.alias("address_recovered_count"), (n - addr).alias("non_address_recovered_count"),
        F.when(total > 0, n / total).otherwise(0.0).alias("recovery_rate"), F.col("__hits").alias("recovered_values"),
        F.when(F.col("__parsed.overall_assessment").isin("parse_error", "error"), F.col("__parsed.overall_assessment")).alias("error"),
    )
    return df.withColumn(out, side).drop("__parsed", "__hits")


def run_experiment(answers: DataFrame, responder: Callable[[Column], Column], idx: str = "idx", done: DataFrame | None = None) -> DataFrame:
    """(idx, types, own, baseline) of each answer row: both sanitized texts are sent to `responder` (prompt column -> reply column).

    Rows whose idx is in `done` are left out, so a broken run goes on where it stopped.
    """
    rows = answers if done is None else answers.join(done.select(idx), idx, "left_anti")
    rows = rows.withColumns({"types": detail_types(F.coalesce("pii_detail", F.create_map().cast(dict(answers.dtypes)["pii_detail"]))), "__b": F.coalesce("presidio_found_piis", F.array().cast("array<struct<value:string,type:string,score:double>>"))})
    text, base = F.coalesce("sanitized_input", F.lit("")), F.col("presidio_sanitized_input")
    originals = F.coalesce(F.map_keys("surrogate_map"), F.array().cast("array<string>"))
    rows = score_side(rows, text != "", responder(prompt(text, F.col("types"))), originals, F.size(originals), "own")
    values = F.transform("__b", lambda e: e["value"])
    rows = score_side(rows, base.isNotNull(), responder(prompt(base, baseline_types(F.col("__b")))), values, F.size(values), "baseline")
    return rows.select(idx, "types", "own", "baseline")


def analysis(results: DataFrame, side: str) -> DataFrame:
    """(questions_available, total_targeted, total_recovered, total_recovered_excluding_address, both rates) of one side.

    The rate without addresses has a denominator that is less by the questions with addresses, 1 at least.
    """
    rows = results.filter(f"{side}.available")
    address = F.count_if(F.array_contains("types", "address"))
    out = rows.agg(F.count("*").alias("questions_available"), *[F.coalesce(F.sum(f"{side}.{c}"), F.lit(0)).alias(n) for n, c in (("total_targeted", "total_targeted"), ("total_recovered", "recovered_count"), ("total_recovered_excluding_address", "non_address_recovered_count"))], address.alias("a"))
    return out.withColumns({
        "recovery_rate": F.round(F.when(F.col("total_targeted") > 0, F.col("total_recovered") / F.col("total_targeted")).otherwise(0.0), 4),
        "recovery_rate_excluding_address": F.round(F.col("total_recovered_excluding_address") / F.greatest(F.lit(1), F.col("total_targeted") - F.col("a")), 4),
    }).drop("a")


def analysis_by_type(results: DataFrame, side: str) -> DataFrame:
    """(type, targeted, recovered, rate) of all eighteen types: questions with the type, and recovered values of it."""
    rows = results.filter(f"{side}.available")
    entries = F.concat(F.transform("types", lambda t: F.struct(t.alias("type"), F.lit(1).alias("t"), F.lit(0).alias("r"))), F.transform(f"{side}.recovered_values", lambda v: F.struct(merged_type(v["type"]).alias("type"), F.lit(0).alias("t"), F.lit(1).alias("r"))))
    counts = rows.select(F.explode(entries).alias("e")).groupBy("e.type").agg(F.sum("e.t").alias("targeted"), F.sum("e.r").alias("recovered"))
    all_types = results.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    out = F.broadcast(all_types).join(counts, "type", "left").fillna(0)
    return out.withColumn("rate", F.when(F.col("targeted") > 0, F.round(F.col("recovered") / F.col("targeted"), 4)).otherwise(0.0))
