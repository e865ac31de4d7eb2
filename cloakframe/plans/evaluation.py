"""Queries of evaluation, attack analysis and streams' batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import attack, evaluate
from cloakframe.plans.base import EVAL_SQL, answer_tables, evaluation_tables, table
from cloakframe.streaming.sessions import windowed_types

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, d: f(evaluation_tables(spark, d))


def _scores(t: dict[str, DataFrame]) -> DataFrame:
    return evaluate.question_scores(t["questions"], t["found"], t["keys"])


def _ablation(t: dict[str, DataFrame]) -> DataFrame:
    return evaluate.ablation(t["stages"], t["keys"], t["details"])


def _baseline(t: dict[str, DataFrame]) -> DataFrame:
    own = evaluate.type_counts(t["found"], t["keys"], t["details"], t["kept"])
    return evaluate.baseline_comparison(own, evaluate.baseline_counts(t["baseline"], t["keys"]))


def key_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Keys written as JSON objects (and as quoted texts for each third question), and read again."""
    keys = evaluation_tables(spark, d)["keys"]
    as_map = F.to_json(F.map_from_entries(F.collect_list(F.struct("type", "value"))))
    as_text = F.array_join(F.collect_list(F.concat(F.lit('"'), "value", F.lit('"'))), ", ")
    written = keys.groupBy("idx").agg(F.when(F.col("idx") % 3 == 0, as_text).otherwise(as_map).alias("answer_key"))
    return evaluate.key_values(written).select("idx", "type", "value")


def attack_results(spark: SparkSession, d: str) -> DataFrame:
    """An experiment over all questions: the responder answers with a fenced JSON of the values that it was given, or garbage."""
    t = evaluation_tables(spark, d)
    pairs = t["details"].groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("value", F.concat(F.lit("s-"), F.md5("value"))))).alias("surrogate_map"), F.map_from_entries(F.collect_list(F.struct("value", F.struct("type")))).alias("pii_detail"))
    guesses = t["keys"].groupBy("idx").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("value").alias("guessed_original"), F.col("type").alias("pii_type"), F.lit(0.5).alias("confidence"))).alias("recovery_attempts"))).alias("reply"))
    rows = pairs.join(guesses, "idx").withColumns({"sanitized_input": F.lit("text"), "presidio_sanitized_input": F.lit(None).cast("string"), "presidio_found_piis": F.lit(None).cast("array<struct<value:string,type:string,score:double>>")})
    fenced = F.concat(F.lit("```json\n"), F.col("reply"), F.lit("\n```"))
    rows = rows.withColumn("reply", F.when(F.col("idx") % 5 == 0, "no JSON here").when(F.col("idx") % 5 == 1, F.concat(F.lit("Here: "), "reply")).otherwise(fenced))
    scored = attack.score_side(rows.withColumn("types", attack.detail_types(F.col("pii_detail"))), F.col("sanitized_input") != "", F.col("reply"), F.map_keys("surrogate_map"), F.size("surrogate_map"), "own")
    return scored.select("idx", "types", "own")


def attack_summary(spark: SparkSession, d: str) -> DataFrame:
    return attack.analysis(attack_results(spark, d), "own")


def attack_by_type(spark: SparkSession, d: str) -> DataFrame:
    return attack.analysis_by_type(attack_results(spark, d), "own")


def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    """Two scores of each question; n, means, deviations and t (p is left out: SQL has no t distribution)."""
    return evaluate.paired_t_test(evaluation_tables(spark, d)["questions"], "x", "y").select("n", "a_mean", "a_std", "b_mean", "b_std", "mean_diff", "t", "significant")


def _answers(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Over literal answer rows and their parsed keys."""
        answers, keys = answer_tables(spark)
        return f(answers, evaluate.key_values(keys))

    return query


def _merged(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Scores by type, with phones and postal codes of all kinds as one."""
    return evaluate.per_type(evaluate.found_values(answers), keys, evaluate.detail_rows(answers))


def _macro(answers: DataFrame, keys: DataFrame) -> DataFrame:
    return evaluate.macro(evaluate.question_scores(answers, evaluate.found_values(answers), keys))


def _t_test(answers: DataFrame, keys: DataFrame) -> DataFrame:
    rows = answers.select(F.col("bertscore_ss.f1").alias("x"), F.col("bertscore_presidio.f1").alias("y"))
    return evaluate.paired_t_test(rows, "x", "y").select("n", "mean_diff", "t")


def attack_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What the attacking model is asked about each literal answer."""
    answers, _ = answer_tables(spark)
    types = attack.detail_types(F.col("pii_detail"))
    whole = attack.prompt(F.col("sanitized_input"), types)
    return answers.select("idx", attack.types_list(types).alias("types"), (whole.contains(attack.types_list(types)) & whole.endswith(F.col("sanitized_input"))).alias("asked"))


def attack_experiment(spark: SparkSession, d: str) -> DataFrame:
    """The whole experiment over the literal answers, against a model that knows one name."""
    answers, _ = answer_tables(spark)
    reply = F.lit('{"recovery_attempts": [{"guessed_original": "ann lee", "pii_type": "PERSON", "confidence": 0.9}], "overall_assessment": "ok"}')
    rows = attack.run_experiment(answers, lambda prompt: reply)
    return rows.select("idx", F.col("own.total_targeted").alias("targeted"), F.col("own.recovered_count").alias("recovered"))


def events_risk_window(spark: SparkSession, d: str) -> DataFrame:
    return windowed_types(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES: dict[str, Query] = {
    "eval_question_scores": _on(_scores),
    "eval_macro": _on(lambda t: evaluate.macro(_scores(t))),
    "eval_micro": _on(lambda t: evaluate.micro(_scores(t))),
    "eval_per_type": _on(lambda t: evaluate.per_type(t["found"], t["keys"], t["details"], t["kept"])),
    "eval_baseline_comparison": _on(_baseline),
    "eval_baseline_only": _on(lambda t: evaluate.baseline_only(t["baseline"])),
    "eval_ablation": _on(_ablation),
    "eval_config_steps": _on(lambda t: evaluate.config_steps(_ablation(t))),
    "eval_stage_necessity": _on(lambda t: evaluate.stage_necessity(t["stages"], t["keys"])),
    "eval_stage_shares": _on(lambda t: evaluate.stage_shares(t["stages"])),
    "eval_key_parsing": key_parsing,
    "paired_ttest": paired_ttest,
    "attack_results": attack_results,
    "attack_summary": attack_summary,
    "attack_by_type": attack_by_type,
    "events_risk_window": events_risk_window,
    "answers_counts": _answers(lambda a, k: evaluate.answer_counts(a, k)),
    "answers_macro": _answers(_macro),
    "answers_per_type": _answers(_merged),
    "answers_times": _answers(lambda a, k: evaluate.timing_means(a)),
    "answers_restored": _answers(lambda a, k: evaluate.restored(a).select("idx", "restored")),
    "answers_restore_leaks": _answers(lambda a, k: evaluate.restore_leaks(a)),
    "answers_text_leaks": _answers(evaluate.text_leaks),
    "answers_scores": _answers(lambda a, k: evaluate.score_means(a)),
    "answers_banner": _answers(evaluate.evaluation_banner),
    "answers_baseline_status": _answers(lambda a, k: evaluate.data_status(a)),
    "answers_t_test": _answers(_t_test),
    "attack_prompts": attack_prompts,
    "attack_experiment": attack_experiment,
}

_P = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END"
_R = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END"
_F1 = f"CASE WHEN ({_P}) + ({_R}) > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0.0 END"
_ROUNDED = f"round(({_P})::DOUBLE, 4) AS precision, round(({_R})::DOUBLE, 4) AS recall, round(({_F1})::DOUBLE, 4) AS f1"
_SETS = "k AS (SELECT DISTINCT idx, lower(value) AS v FROM keys), f AS (SELECT DISTINCT idx, lower(value) AS v FROM found)"
_PER_Q = f"""{EVAL_SQL}, {_SETS}, hits AS (SELECT idx, count(*) FILTER (k.v IS NOT NULL AND f.v IS NOT NULL) AS tp, count(*) FILTER (k.v IS NULL) AS fp, count(*) FILTER (f.v IS NULL) AS fn FROM k FULL JOIN f USING (idx, v) GROUP BY idx),
  q AS (SELECT idx, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM questions LEFT JOIN hits USING (idx)),
  s AS (SELECT *, ({_P})::DOUBLE AS precision, ({_R})::DOUBLE AS recall, ({_F1})::DOUBLE AS f1, (CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1.0 END)::DOUBLE AS accuracy, (CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END)::DOUBLE AS error FROM q)"""
_MERGE = "CASE WHEN type LIKE 'phone_%' THEN 'phone' WHEN type IN ('zip_us', 'postcode_uk') THEN 'postal_code' ELSE type END"


def _types_sql(details: str, found: str, kept: str) -> str:
    return f"""SELECT type, count(*) FILTER (s = 'tp') AS tp, count(*) FILTER (s = 'fp') AS fp, count(*) FILTER (s = 'fn') AS fn FROM (
      SELECT {_MERGE} AS type, CASE WHEN (idx, lower(value)) IN (SELECT (idx, lower(value)) FROM {found}) THEN 'tp' ELSE 'fn' END AS s FROM keys
      UNION ALL SELECT {_MERGE}, 'fp' FROM {details} d WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.idx = d.idx AND lower(k.value) = lower(d.value)) AND NOT EXISTS (SELECT 1 FROM {kept} k WHERE k.idx = d.idx AND lower(k.value) = lower(d.value))) GROUP BY type"""


_MAPPED = "mapped AS (SELECT idx, value, CASE type WHEN 'EMAIL_ADDRESS' THEN 'email' WHEN 'DATE_TIME' THEN 'dob' WHEN 'LOCATION' THEN 'GPE' WHEN 'US_SSN' THEN 'ssn' WHEN 'PERSON' THEN 'PERSON' END AS type FROM baseline WHERE type <> 'NRP'), nothing AS (SELECT idx, value FROM keys WHERE false)"


def _side(name: str, rows: str) -> str:
    return f"SELECT coalesce(type, 'overall') AS type, tp AS {name}_tp, fp AS {name}_fp, fn AS {name}_fn, {', '.join(f'{c} AS {name}_{c}' for c in ('precision', 'recall', 'f1'))} FROM (SELECT *, {_ROUNDED} FROM (SELECT type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({rows}) GROUP BY ROLLUP (type)))"


_FLAGS = f"""{EVAL_SQL}, ks AS (SELECT idx, lower(value) AS v, max(type) AS key_type FROM keys GROUP BY ALL), st AS (SELECT idx, lower(value) AS v, bool_or(stage = 'pattern') AS pattern, bool_or(stage = 'ner') AS ner, bool_or(stage = 'slm') AS slm, bool_or(stage = 'full') AS full_ FROM stages GROUP BY ALL),
  fl AS (SELECT idx, v, key_type IS NOT NULL AS key, key_type, coalesce(pattern, false) AS pattern, coalesce(ner, false) AS ner, coalesce(slm, false) AS slm, coalesce(full_, false) AS full_ FROM ks FULL JOIN st USING (idx, v) WHERE idx IN (SELECT idx FROM ks) AND idx IN (SELECT idx FROM st)),
  own AS (SELECT idx, lower(value) AS v, max(type) AS own_type FROM details GROUP BY ALL),
  cf AS (SELECT config, CASE WHEN key THEN key_type ELSE coalesce(own_type, 'other') END AS type, hit, key FROM (SELECT *, unnest([{{'config': 'full', 'hit': full_}}, {{'config': 'ps_cg', 'hit': pattern OR slm}}, {{'config': 'ps_et', 'hit': pattern OR ner}}, {{'config': 'ps_only', 'hit': pattern}}], recursive := true) FROM fl LEFT JOIN own USING (idx, v)) WHERE hit OR key),
  ab AS (SELECT config, type, count(*) FILTER (hit AND key) AS tp, count(*) FILTER (hit AND NOT key) AS fp, count(*) FILTER (key AND NOT hit) AS fn FROM cf GROUP BY GROUPING SETS ((config), (config, type))),
  abl AS (SELECT *, {_ROUNDED} FROM ab)"""
#: Attempts are the question's keys, unless the reply has no JSON; what the details have is targeted.
_ATTACK = f"""{EVAL_SQL}, qs AS (SELECT DISTINCT idx FROM keys SEMI JOIN details USING (idx)),
  hit AS (SELECT k.idx, k.type, k.value FROM keys k JOIN qs USING (idx) WHERE k.idx % 5 <> 0 AND EXISTS (SELECT 1 FROM details d WHERE d.idx = k.idx AND lower(d.value) = lower(k.value))),
  tg AS (SELECT idx, type, value FROM details SEMI JOIN qs USING (idx))"""
_ALL_TYPES = ", ".join(f"('{t}')" for t in attack.TYPES)
ORACLE_SQL: dict[str, str] = {
    "eval_question_scores": f"WITH {_PER_Q} SELECT * FROM s",
    "eval_macro": f"WITH {_PER_Q} SELECT count(*) AS questions, {', '.join(f'round(avg({c}), 4) AS {c}' for c in ('precision', 'recall', 'f1', 'accuracy', 'error'))} FROM s",
    "eval_micro": f"WITH {_PER_Q}, m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM q) SELECT *, {_ROUNDED} FROM m",
    "eval_per_type": f"WITH {EVAL_SQL}, t AS ({_types_sql('details', 'found', 'kept')}) SELECT *, {_ROUNDED} FROM t WHERE tp + fp + fn > 0",
    "eval_baseline_comparison": f"WITH {EVAL_SQL}, {_MAPPED} SELECT * REPLACE ({', '.join(f'coalesce({x}_{c}, 0)::BIGINT AS {x}_{c}' for x in ('own', 'baseline') for c in ('tp', 'fp', 'fn'))}) FROM ({_side('own', _types_sql('details', 'found', 'kept'))}) FULL JOIN ({_side('baseline', 'SELECT * FROM (' + _types_sql('mapped', 'baseline', 'nothing') + ') WHERE type NOT IN (' + chr(39) + 'ORG' + chr(39) + ')')}) USING (type)",
    "eval_baseline_only": f"WITH {EVAL_SQL} SELECT type, count(*) AS n FROM baseline WHERE type = 'NRP' GROUP BY type",
    "eval_ablation": f"WITH {_FLAGS} SELECT * FROM abl",
    "eval_config_steps": f"""WITH {_FLAGS}, o AS (SELECT coalesce(type, 'overall') AS type, config, f1, list_position(['ps_only', 'ps_et', 'ps_cg', 'full'], config) AS o FROM abl)
      SELECT type, config, f1, round(f1 - lag(f1) OVER (PARTITION BY type ORDER BY o), 4) AS delta, arg_min(config, o) FILTER (f1 >= 0.8) OVER (PARTITION BY type) AS key_stage FROM o""",
    "eval_stage_necessity": f"""WITH {_FLAGS}, p AS (SELECT idx, bool_or(ner AND key) AND bool_or(key AND NOT pattern) AS a, bool_or(slm AND key) AND bool_or(key AND NOT pattern AND NOT ner) AS b FROM fl GROUP BY idx)
      SELECT count(*) AS questions, count(*) FILTER (a) AS needing_ner, count(*) FILTER (b) AS needing_slm, round(count(*) FILTER (a) / greatest(count(*), 1), 4) AS share_ner, round(count(*) FILTER (b) / greatest(count(*), 1), 4) AS share_slm FROM p""",
    "eval_stage_shares": f"WITH {EVAL_SQL} SELECT stage, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM stages WHERE stage <> 'full' GROUP BY stage",
    "eval_key_parsing": f"WITH {EVAL_SQL} SELECT idx, CASE WHEN idx % 3 = 0 THEN NULL WHEN type IN ('PERSON', 'email', 'dob', 'GPE', 'ORG', 'ssn') THEN type ELSE 'other' END AS type, value FROM keys",
    "paired_ttest": f"""WITH {EVAL_SQL} SELECT count(*) AS n, round(avg(x), 4) AS a_mean, round(stddev_pop(x), 4) AS a_std, round(avg(y), 4) AS b_mean, round(stddev_pop(y), 4) AS b_std, round(avg(x - y), 4) AS mean_diff,
      round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 4) AS t, abs(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*)))) > 3.3 AS significant FROM questions""",
    "attack_summary": f"""WITH {_ATTACK} SELECT (SELECT count(*) FROM qs) AS questions_available, (SELECT count(*) FROM tg) AS total_targeted, (SELECT count(*) FROM hit) AS total_recovered, (SELECT count(*) FROM hit) AS total_recovered_excluding_address,
      round((SELECT count(*) FROM hit) / (SELECT count(*) FROM tg), 4) AS recovery_rate, round((SELECT count(*) FROM hit) / (SELECT count(*) FROM tg), 4) AS recovery_rate_excluding_address""",
    "attack_by_type": f"""WITH {_ATTACK}, a(type) AS (VALUES {_ALL_TYPES}), r AS (SELECT type, (SELECT count(DISTINCT idx) FROM tg WHERE tg.type = a.type) AS targeted, (SELECT count(*) FROM hit WHERE hit.type = a.type) AS recovered FROM a)
      SELECT *, CASE WHEN targeted > 0 THEN round(recovered / targeted, 4) ELSE 0.0 END AS rate FROM r""",
    "events_risk_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    # By hand, from the rows of `base.ANSWERS`.
    "answers_counts": "SELECT 6::BIGINT AS questions, 5::BIGINT AS answered, 1::BIGINT AS empty, 0.8333::DOUBLE AS answer_rate, 7::BIGINT AS found, 10::BIGINT AS in_key, 1.1667::DOUBLE AS average_found, 1.6667::DOUBLE AS average_key",
    "answers_macro": "SELECT 6::BIGINT AS questions, 1.0::DOUBLE AS precision, 0.8611::DOUBLE AS recall, 0.9111::DOUBLE AS f1, 0.8611::DOUBLE AS accuracy, 0.1389::DOUBLE AS error",
    "answers_per_type": "SELECT type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, p::DOUBLE AS precision, r::DOUBLE AS recall, f::DOUBLE AS f1 FROM (VALUES ('GPE', 1, 0, 0, 1, 1, 1), ('phone', 1, 0, 1, 1, 0.5, 0.6667), ('postal_code', 2, 0, 0, 1, 1, 1), ('ORG', 0, 0, 1, 1, 0, 0), ('PERSON', 3, 0, 0, 1, 1, 1), ('email', 1, 0, 0, 1, 1, 1)) AS t(type, tp, fp, fn, p, r, f)",
    "answers_times": "SELECT 5::BIGINT AS n, 2.0::DOUBLE AS pattern_scan_ms, 20.0::DOUBLE AS entity_trace_ms, 0.2::DOUBLE AS context_guard_ms, 1.0::DOUBLE AS surrogate_gen_ms, 0.0::DOUBLE AS llm_call_ms, 23.2::DOUBLE AS total_ms",
    "answers_restored": "SELECT idx::BIGINT AS idx, restored FROM (VALUES (0, 'Hi Ann! a@b.org'), (1, '90210 it is'), (2, 'Falk, Bo Lundner'), (3, ''), (4, 'SW1A 1AA'), (5, 'Cleo Marsh, hi')) AS t(idx, restored)",
    "answers_restore_leaks": "SELECT 6::BIGINT AS questions, 1::BIGINT AS leaking, 1::BIGINT AS leaks, 0.1667::DOUBLE AS rate, 0.8333::DOUBLE AS precision",
    "answers_text_leaks": "SELECT 6::BIGINT AS questions, 2::BIGINT AS leaking, 3::BIGINT AS leaks, 0.3333::DOUBLE AS rate, 0.7333::DOUBLE AS accuracy, 0.2667::DOUBLE AS error",
    "answers_scores": "SELECT 0.8::DOUBLE AS own_precision, 0.8::DOUBLE AS own_recall, 0.8::DOUBLE AS own_f1, 0.7::DOUBLE AS baseline_precision, 0.6::DOUBLE AS baseline_recall, 0.6167::DOUBLE AS baseline_f1",
    "answers_banner": "SELECT 0.7333::DOUBLE AS accuracy, 0.8333::DOUBLE AS precision, 'significant leaks' AS status",
    "answers_baseline_status": "SELECT 'partial' AS status, 5::BIGINT AS with_data, 6::BIGINT AS total",
    "answers_t_test": "SELECT 2::BIGINT AS n, 0.15::DOUBLE AS mean_diff, 3.0::DOUBLE AS t",
    "attack_prompts": "SELECT idx::BIGINT AS idx, types, true AS asked FROM (VALUES (0, '- person''s name' || chr(10) || '- email'), (1, '- postal code' || chr(10) || '- phone'), (2, '- person''s name'), (3, '- none'), (4, '- postal code'), (5, '- person''s name')) AS t(idx, types)",
    "attack_experiment": "SELECT idx::BIGINT AS idx, targeted::INT AS targeted, recovered::INT AS recovered FROM (VALUES (0, 2, 1), (1, 2, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0), (5, 1, 0)) AS t(idx, targeted, recovered)",
}
