"""Scores of detected values against answer keys: per question, per type, against a baseline, by stage.

Everything works on long tables. A found or key value is one row (idx, value, ...); sets meet in one
`groupBy`, with a flag for each side, so no join is needed and counts are combined before the shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.spans import replace_pairs
from cloakframe.functions.stats import t_test_p

#: Labels of answer keys by the type that they stand for.
LABELS_OF: dict[str, str] = {
    "FAC": "fac FAC", "GPE": "gpe GPE location", "LOC": "loc LOC", "ORG": "org ORG organization", "PERSON": "name person PERSON", "address": "address", "api_key": "api_key",
    "credit_card": "credit_card", "crypto": "crypto bitcoin ethereum wallet", "dob": "dob date_of_birth", "email": "email", "gender_indicator": "gender", "ip_address": "ip ip_address",
    "phone": "phone phone_intl phone_uk phone_us", "postal_code": "postcode postcode_uk zip zip_us", "ssn": "ssn", "us_bank_number": "bank_account bank_number routing routing_number us_bank_number",
    "us_driver_license": "dl driver_license drivers_license license us_driver_license",
}
TYPE_OF_LABEL = {label: t for t, labels in LABELS_OF.items() for label in labels.split()}
#: Types that are counted together.
MERGED = {f"phone_{x}": "phone" for x in ("intl", "uk", "us")} | {"postcode_uk": "postal_code", "zip_us": "postal_code"}
#: Types of the baseline by the type that they are compared with.
BASELINE_TYPES = dict(x.split(">") for x in "CREDIT_CARD>credit_card CRYPTO>crypto DATE_TIME>dob EMAIL_ADDRESS>email IP_ADDRESS>ip_address LOCATION>GPE PERSON>PERSON PHONE_NUMBER>phone US_BANK_NUMBER>us_bank_number US_DRIVER_LICENSE>us_driver_license US_SSN>ssn".split())
OWN_TYPES = tuple("FAC ORG address api_key gender_indicator postal_code".split())
CONFIGS = {"full": None, "ps_cg": ("pattern", "slm"), "ps_et": ("pattern", "ner"), "ps_only": ("pattern",)}
STAGES_MS = tuple(f"{x}_ms" for x in ("pattern_scan", "entity_trace", "context_guard", "surrogate_gen", "llm_call", "total"))


def lookup(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A column by a table of literals; what it lacks is as it was, or `default`."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, column), column if default is None else default)


def merged_type(type_: Column) -> Column:
    return lookup(type_, MERGED)


def key_values(keys: DataFrame, idx: str = "idx", key: str = "answer_key") -> DataFrame:
    """(idx, label, type, value) of answer keys in JSON: an object of values or lists of values, or a text of quoted values with commas.

    Labels that aren't known have type "other"; values of a text have no label and no type. Null and blank values and keys give no row.
    """
    text = F.trim(F.col(key))
    is_object = text.startswith("{")
    inner = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    rows = keys.select(idx, is_object.alias("o"), text.alias("t"))
    objects = rows.filter("o").select(idx, F.explode(F.when(F.col("o"), F.map_entries(F.from_json("t", "map<string,string>")))).alias("f")).select(idx, F.col("f.key").alias("label"), F.explode(inner(F.col("f.value"))).alias("value"))
    objects = objects.select(idx, "label", lookup(F.col("label"), TYPE_OF_LABEL, F.lit("other")).alias("type"), F.trim("value").alias("value"))
    legacy = rows.filter("NOT o").select(idx, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("type"), F.explode(F.split("t", ",")).alias("value")).withColumn("value", F.regexp_replace("value", r"""^[\s"']+|[\s"']+$""", ""))
    return objects.unionByName(legacy).filter("value IS NOT NULL AND value <> ''")


def found_values(answers: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, value): what was replaced or recognised in each answer row."""
    kept = F.transform(F.coalesce("recognized_not_replaced", F.array()), lambda r: r["value"])
    return answers.select(idx, F.explode(F.concat(F.map_keys(F.coalesce("surrogate_map", F.create_map().cast("map<string,string>"))), kept)).alias("value")).filter("value IS NOT NULL AND value <> ''")


def detail_rows(answers: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, value, type) of each answer's details, merged types."""
    return answers.select(idx, F.explode("pii_detail").alias("value", "d")).select(idx, "value", merged_type(F.coalesce("d.type", F.lit("other"))).alias("type"))


def stage_rows(answers: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, stage, value): values by the stage that found them, and those of the full cascade as stage "full"; rows without stage data are left out."""
    some = answers.filter("pattern_scan_pii IS NOT NULL OR entity_trace_pii IS NOT NULL")
    named = {"pattern": "pattern_scan_pii", "ner": "entity_trace_pii", "slm": "context_guard_pii", "full": "confirmed_pii"}
    entries = F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v, s=s: F.struct(F.lit(s).alias("stage"), v.alias("value"))) for s, c in named.items()])
    return some.select(idx, F.explode(entries).alias("x")).select(idx, "x.stage", "x.value")


def paired_lengths(*sizes: DataFrame) -> None:
    """Raises ValueError unless all tables have as many rows."""
    n = {df.count() for df in sizes}
    if len(n) > 1:
        raise ValueError(f"tables differ in length: {sorted(n)}")


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1; 1, 1 and 0 where there is nothing to divide by."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({k: F.round(c, digits) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def sets(idx: str, **sides: DataFrame) -> DataFrame:
    """(idx, v, flags): lower-case values of each question, with one Boolean for each side that has them."""
    rows = [df.select(idx, F.lower("value").alias("v"), *[F.lit(name == s).alias(s) for s in sides]) for name, df in sides.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(idx, "v").agg(*[F.max(s).alias(s) for s in sides])


def question_scores(questions: DataFrame, found: DataFrame, keys: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, tp, fp, fn, precision, recall, f1, accuracy, error), one row for each question."""
    both = sets(idx, found=found, key=keys).groupBy(idx).agg(*[F.sum(F.expr(x).cast("long")).alias(n) for n, x in (("tp", "found AND key"), ("fp", "found AND NOT key"), ("fn", "key AND NOT found"))])
    rows = questions.select(idx).join(both, idx, "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    more = {"accuracy": F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(1.0), "error": F.when(tp + fn > 0, fn / (tp + fn)).otherwise(0.0)}
    return rows.withColumns(ratios(tp, fp, fn) | more)


def macro(scores: DataFrame) -> DataFrame:
    """Means over the questions, of four digits."""
    return scores.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1", "accuracy", "error")])


def micro(scores: DataFrame) -> DataFrame:
    """Ratios of the summed counts."""
    return _rounded(scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def answer_counts(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """(questions, answered, empty, answer_rate, found, in_key, average_found, average_key)."""
    a = answers.agg(F.count("*").alias("questions"), F.count_if(F.coalesce("llm_response", F.lit("")) != "").alias("answered"), F.coalesce(F.sum(F.coalesce(F.size(F.map_keys("surrogate_map")), F.lit(0))), F.lit(0)).alias("found"))
    n = F.greatest(F.col("questions"), F.lit(1))
    out = a.crossJoin(keys.agg(F.count("*").alias("in_key")))
    return out.select("questions", "answered", (F.col("questions") - F.col("answered")).alias("empty"), F.round(F.col("answered") / n, 4).alias("answer_rate"), "found", "in_key", F.round(F.col("found") / n, 4).alias("average_found"), F.round(F.col("in_key") / n, 4).alias("average_key"))


def timing_means(answers: DataFrame) -> DataFrame:
    """Mean milliseconds of each stage over the answers with timings, of six digits."""
    timed = answers.filter("stage_timings_ms IS NOT NULL")
    return timed.agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(f"stage_timings_ms.{s}", F.lit(0.0))), 6).alias(s) for s in STAGES_MS])


def type_counts(found: DataFrame, keys: DataFrame, detail: DataFrame, kept: DataFrame | None = None, idx: str = "idx") -> DataFrame:
    """(type, tp, fp, fn): key values (repeated ones too) by whether they were found; details that neither the key nor `kept` has.

    Three tables meet in one shuffle by question and value.
    """
    none = found.sparkSession.createDataFrame([], found.select(idx, "value").schema)
    parts = {"found": found, "key": keys, "detail": detail, "kept": none if kept is None else kept}
    no_type = F.lit(None).cast("string")
    rows = reduce(DataFrame.unionByName, [df.select(idx, F.lower("value").alias("v"), F.lit(name).alias("side"), (merged_type(F.col("type")) if "type" in df.columns and name in ("key", "detail") else no_type).alias("type")) for name, df in parts.items()])
    # A value without a type counts as one that the key has, but not by type.
    has = lambda s: F.max(F.col("side") == s)
    by_value = rows.groupBy(idx, "v").agg(has("found").alias("found"), has("key").alias("in_key"), has("kept").alias("kept"), F.collect_list(F.struct("side", "type")).alias("own"))
    each = by_value.withColumn("o", F.explode("own")).filter("o.type IS NOT NULL").select(F.col("o.type").alias("type"), F.col("o.side").alias("side"), "found", "in_key", "kept")
    counts = [F.count_if(F.expr(x)).alias(n) for n, x in (("tp", "side = 'key' AND found"), ("fp", "side = 'detail' AND NOT in_key AND NOT kept"), ("fn", "side = 'key' AND NOT found"))]
    return each.groupBy("type").agg(*counts).filter("tp + fp + fn > 0")


def per_type(found: DataFrame, keys: DataFrame, detail: DataFrame, kept: DataFrame | None = None, idx: str = "idx") -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1)."""
    return _rounded(type_counts(found, keys, detail, kept, idx))


def baseline_comparison(own: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two tables of counts by type side by side, and a row "overall" with the ratios of the sums; a side that lacks a type has counts of 0 and no ratios."""

    def side(df: DataFrame, name: str) -> DataFrame:
        rolled = df.rollup("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("type", F.coalesce("type", F.lit("overall")))
        return _rounded(rolled.fillna(0, ["tp", "fp", "fn"])).select("type", *[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")])

    joined = side(own, "own").join(side(baseline, "baseline"), "type", "full_outer")
    return joined.fillna(0, [f"{s}_{c}" for s in ("own", "baseline") for c in ("tp", "fp", "fn")])


def baseline_counts(found: DataFrame, keys: DataFrame, idx: str = "idx") -> DataFrame:
    """(type, tp, fp, fn) of the baseline's values (idx, value, type in its own names), over the types that can be compared."""
    mapped = found.withColumn("type", lookup(F.col("type"), BASELINE_TYPES, F.lit(None).cast("string")))
    comparable = sorted(set(BASELINE_TYPES.values()))
    counts = type_counts(found.select(idx, "value"), keys, mapped.filter("type IS NOT NULL"), idx=idx)
    return counts.filter(F.col("type").isin(comparable))


def baseline_only(found: DataFrame) -> DataFrame:
    """(type, n) of the baseline's types that can't be compared, most first."""
    return found.filter(~F.col("type").isin(sorted(BASELINE_TYPES))).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def data_status(answers: DataFrame) -> DataFrame:
    """(status, with_data, total): whether no, some or all answers have baseline data."""
    out = answers.agg(F.count("presidio_found_piis").alias("with_data"), F.count("*").alias("total"))
    return out.select(F.when(F.col("with_data") == 0, "no_data").when(F.col("with_data") < F.col("total"), "partial").otherwise("full").alias("status"), "with_data", "total")


def paired_t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean and population deviation of both, mean_diff, t, p, significant) of rows with both values; nulls for fewer than two.

    One aggregation; only p, of the one row that is left, is made in Python.
    """
    d = F.col(a) - F.col(b)
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = both.agg(F.count("*").alias("n"), F.avg(a).alias("a_mean"), F.stddev_pop(a).alias("a_std"), F.avg(b).alias("b_mean"), F.stddev_pop(b).alias("b_std"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    some, md, sd = F.col("n") >= 2, F.col("mean_diff"), F.col("sd")
    # Equal differences: t is infinite, or nothing if all are zero.
    t = F.when(sd > 0, md / (sd / F.sqrt("n"))).when(md != 0, F.when(md > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.lit(float("nan")))

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or k < 2 else math.nan if x != x else t_test_p(x, int(k) - 1) for x, k in zip(t, n)], dtype="float64")

    out = x.withColumn("t", F.when(some, t)).withColumn("p", F.when(some, two_sided("t", "n")))
    numbers = [F.when(some, F.round(c, 4)).alias(c) for c in ("a_mean", "a_std", "b_mean", "b_std", "mean_diff")]
    return out.select("n", *numbers, F.when(F.abs("t") < float("inf"), F.round("t", 4)).otherwise(F.col("t")).alias("t"), "p", F.when(some, F.col("p") < 0.001).alias("significant"))


def score_means(answers: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 of both sides' text scores; nulls are left out."""
    return answers.agg(*[F.round(F.avg(f"bertscore_{s}.{m}"), 4).alias(f"{n}_{m}") for s, n in (("ss", "own"), ("presidio", "baseline")) for m in ("precision", "recall", "f1")])


def ablation(stages: DataFrame, keys: DataFrame, types: DataFrame | None = None, idx: str = "idx") -> DataFrame:
    """(config, type, tp, fp, fn, precision, recall, f1) of the four configurations; type null: over all types.

    `stages`: (idx, stage, value); `types`: (idx, value, type) of found values that the key lacks. Questions with both stage data and key count. Grouping sets
    give totals and types in one pass.
    """
    flags = sets(idx, **{s: stages.filter(F.col("stage") == s) for s in ("pattern", "ner", "slm", "full")}, key=keys)
    both = Window.partitionBy(idx)
    flags = flags.withColumns({"has_key": F.max("key").over(both), "has_stage": F.max(F.col("pattern") | F.col("ner") | F.col("slm") | F.col("full")).over(both)}).filter("has_key AND has_stage")
    named = keys.filter("type IS NOT NULL").groupBy(idx, F.lower("value").alias("v")).agg(F.max("type").alias("key_type"))
    flags = flags.join(named, [idx, "v"], "left")
    if types is not None:
        flags = flags.join(types.groupBy(idx, F.lower("value").alias("v")).agg(F.max(merged_type(F.col("type"))).alias("own_type")), [idx, "v"], "left")
    else:
        flags = flags.withColumn("own_type", F.lit(None).cast("string"))
    hit = lambda s: reduce(lambda a, b: a | b, [F.col(x) for x in s]) if s else F.col("full")
    each = flags.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), hit(s).alias("hit")) for n, s in CONFIGS.items()])))
    each = each.select("c.config", F.coalesce(F.when(F.col("key"), F.col("key_type")).otherwise(F.col("own_type")), F.lit("other")).alias("type"), F.col("c.hit").alias("hit"), "key").filter("hit OR key")
    counts = [F.count_if(F.expr(x)).alias(n) for n, x in (("tp", "hit AND key"), ("fp", "hit AND NOT key"), ("fn", "key AND NOT hit"))]
    return _rounded(each.groupingSets([["config"], ["config", "type"]], "config", "type").agg(*counts))


def stage_necessity(stages: DataFrame, keys: DataFrame, idx: str = "idx") -> DataFrame:
    """(questions, needing_ner, needing_slm and their shares): questions whose key the earlier stages miss in part while the stage has some of it."""
    flags = sets(idx, **{s: stages.filter(F.col("stage") == s) for s in ("pattern", "ner", "slm", "full")}, key=keys)
    per = flags.groupBy(idx).agg(F.max("key").alias("k"), F.max(F.col("pattern") | F.col("ner") | F.col("slm") | F.col("full")).alias("s"), *[F.max(F.expr(x)).alias(n) for n, x in (("ner_hit", "ner AND key"), ("slm_hit", "slm AND key"), ("ps_miss", "key AND NOT pattern"), ("et_miss", "key AND NOT pattern AND NOT ner"))]).filter("k AND s")
    out = per.agg(F.count("*").alias("questions"), F.count_if(F.expr("ner_hit AND ps_miss")).alias("needing_ner"), F.count_if(F.expr("slm_hit AND et_miss")).alias("needing_slm"))
    n = F.greatest("questions", F.lit(1))
    return out.withColumns({"share_ner": F.round(F.col("needing_ner") / n, 4), "share_slm": F.round(F.col("needing_slm") / n, 4)})


def config_steps(table: DataFrame, least: float = 0.80) -> DataFrame:
    """(type, config, f1, delta, key_stage): the F1 by configuration in the order in which stages are added, the step from the one before, and the first configuration that reaches `least`."""
    order = F.array_position(F.array(*[F.lit(c) for c in ("ps_only", "ps_et", "ps_cg", "full")]), F.col("config"))
    rows = table.select(F.coalesce("type", F.lit("overall")).alias("type"), "config", "f1", order.alias("o"))
    by_type = Window.partitionBy("type")
    delta = F.round(F.col("f1") - F.lag("f1").over(by_type.orderBy("o")), 4)
    return rows.withColumns({"delta": delta, "key_stage": F.min_by(F.col("config"), F.when(F.col("f1") >= least, F.col("o"))).over(by_type)}).drop("o")


def stage_shares(stages: DataFrame) -> DataFrame:
    """(stage, n, pct) of the values by stage, of one digit; the full cascade is no stage."""
    n = stages.filter("stage <> 'full'").groupBy("stage").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("stage", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("pct"))


def restored(answers: DataFrame) -> DataFrame:
    """Adds restored: the reply with surrogates replaced, longest first, then the words of surrogates of several words that the reply lacks."""
    pairs = F.transform(F.map_entries("surrogate_map"), lambda e: F.struct(e["value"].alias("original"), e["key"].alias("surrogate")))
    pairs = F.filter(pairs, lambda p: F.coalesce(p["original"], F.lit("")) != "")
    reply = F.coalesce("llm_response", F.lit(""))
    out = answers.withColumn("__pairs", pairs).withColumn("__exact", replace_pairs(reply, F.col("__pairs")))
    words = lambda x: F.split(F.trim(x), r"\s+")
    loose = F.filter("__pairs", lambda p: F.contains(p["original"], F.lit(" ")) & ~F.contains(reply, p["original"]) & (F.size(words(p["original"])) == F.size(words(p["surrogate"]))))
    steps = F.flatten(F.transform(loose, lambda p: F.arrays_zip(words(p["original"]).alias("a"), words(p["surrogate"]).alias("b"))))
    quoted = lambda w: F.concat(F.lit(r"(?<!\w)\Q"), w, F.lit(r"\E(?!\w)"))
    literal = lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return out.withColumn("restored", F.aggregate(steps, F.col("__exact"), lambda t, s: F.regexp_replace(t, quoted(s["a"]), literal(s["b"])))).drop("__pairs", "__exact")


def restore_leaks(answers: DataFrame) -> DataFrame:
    """(questions, leaking, leaks, rate, precision): surrogates that restoring leaves in the reply; values that are their own surrogate don't count."""
    left = F.filter(F.map_entries("surrogate_map"), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (e["key"] != e["value"]) & F.contains(F.col("restored"), e["value"]))
    rows = restored(answers).select(F.greatest(F.coalesce(F.size(left), F.lit(0)), F.lit(0)).alias("n"))
    return _leaks(rows).withColumn("precision", F.when(F.col("questions") > 0, F.round(1 - F.col("leaking") / F.col("questions"), 4)).otherwise(1.0))


def text_leaks(answers: DataFrame, keys: DataFrame, idx: str = "idx") -> DataFrame:
    """(questions, leaking, leaks, rate, accuracy, error): key values that stand as words of their own in the sanitized text, but for those that
    were recognised and kept. Accuracy and error are means over the questions with a key of the share of its values."""
    quoted = F.concat(F.lit(r"(?<![a-zA-Z0-9])\Q"), F.lower("value"), F.lit(r"\E(?![a-zA-Z0-9])"))
    kept = F.transform(F.coalesce("recognized_not_replaced", F.array()), lambda r: F.lower(r["value"]))
    texts = answers.select(idx, F.lower(F.coalesce("sanitized_input", F.lit(""))).alias("t"), kept.alias("kept"))
    rows = keys.select(idx, "value").join(texts, idx).select(idx, (~F.array_contains("kept", F.lower("value")) & F.contains(F.col("t"), F.lower("value")) & F.regexp_like("t", quoted)).cast("int").alias("leak"))
    per = answers.select(idx).join(rows.groupBy(idx).agg(F.sum("leak").alias("n"), F.count("*").alias("keys")), idx, "left")
    share = F.coalesce(F.avg(F.col("n") / F.col("keys")), F.lit(0.0))
    out = per.agg(F.count("*").alias("questions"), F.count_if(F.col("n") > 0).alias("leaking"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("leaks"), F.round(share, 4).alias("error"))
    accuracy = F.when(F.col("questions") > 0, F.round(1 - F.col("error"), 4)).otherwise(F.lit(0.0))
    return out.select("questions", "leaking", "leaks", F.round(F.col("leaking") / F.greatest("questions", F.lit(1)), 4).alias("rate"), accuracy.alias("accuracy"), "error")


def _leaks(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count("*").alias("questions"), F.count_if(F.col("n") > 0).alias("leaking"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("leaks"))
    return out.withColumn("rate", F.round(F.col("leaking") / F.greatest("questions", F.lit(1)), 4))


def banner(accuracy: Column, precision: Column) -> Column:
    """A word for a whole evaluation, from the accuracy of the sanitized texts and the precision of restoring (both 1 where they weren't asked for)."""
    a, p = F.coalesce(accuracy, F.lit(1.0)), F.coalesce(precision, F.lit(1.0))
    return F.when((a == 1) & (p == 1), "clean").when((a > 0.8) & (p > 0.8), "minor issues").otherwise("significant leaks")


def evaluation_banner(answers: DataFrame, keys: DataFrame, idx: str = "idx") -> DataFrame:
    """(accuracy, precision, status) of a whole evaluation."""
    both = text_leaks(answers, keys, idx).select("accuracy").crossJoin(restore_leaks(answers).select("precision"))
    return both.withColumn("status", banner(F.col("accuracy"), F.col("precision")))
