"""Queries of surrogates, rewriting, restoring, state and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.api import Engine
from cloakframe.config import EngineConfig
from cloakframe.functions.spans import restore_pairs
from cloakframe.functions.surrogates import draw_sql
from cloakframe.operators import rag, rewrite, scan, service, state
from cloakframe.operators.batch import FIELDS, run_batch
from cloakframe.operators.resolve import failure_summary, resolve
from cloakframe.operators.rewrite import ATTEMPTS, surrogate_rows
from cloakframe.operators.service import address_pairs, is_service_query
from cloakframe.plans.base import TEXTS, TEXTS_SQL, sql_text, table, texts
from cloakframe.plans.detection import SPANS_SQL, scanned
from cloakframe.sources.io import reply_text
from cloakframe.storage import checkpoint

#: Key material of the round trip query; a cluster's secret comes from its own store.
TEST_SECRET = bytes(range(32))


#: A fixed key, so that SQL can draw the same surrogates. Runs over data of one's own take the random one of a new configuration.
FIXED = EngineConfig(salt="cloak")


def paired(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.with_pairs(scanned(spark, d), "doc_id", config=FIXED)


def surrogate_map(spark: SparkSession, d: str) -> DataFrame:
    return surrogate_rows(scan.explode_entities(scanned(spark, d), "doc_id"), "doc_id", FIXED)


def masked_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with surrogates for the spans of all sixteen patterns."""
    return paired(spark, d).select("doc_id", "masked")


def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.redacted(scanned(spark, d)).select("doc_id", "redacted")


def unmask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = paired(spark, d)
    return rows.groupBy((restore_pairs(F.col("masked"), F.col("pairs")) == F.col("text")).alias("same")).agg(F.count("*").alias("n"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Masked texts as replies, with half of the surrogates in lower case, through all passes."""
    rows = paired(spark, d).select("doc_id", "pairs", F.when(F.col("doc_id") % 2 == 0, F.lower("masked")).otherwise(F.col("masked")).alias("reply"))
    return resolve(rows, failures="failures")


def resolve_replies(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("doc_id", "resolved", "failures")


def resolve_failures(spark: SparkSession, d: str) -> DataFrame:
    return failure_summary(_replies(spark, d))


#: (reply, pairs, restored, failures): the passes of restoring, by hand.
REPLIES = [
    ("Hi Marcus Ellison!", [("Ahmed Al-Rashidi", "Marcus Ellison")], "Hi Ahmed Al-Rashidi!", ""),
    ("Hello Ashley Wise! See Ashley County", [("Jane Doe", "Ashley Wise")], "Hello Jane Doe! See Ashley County", ""),
    ("Hi Victoria", [("Ann Lee", "Victoria Mitchell")], "Hi Ann", "fuzzy_hit"),
    ("mail marcus.elison@example.org now", [("me@x.org", "marcus.ellison@example.org")], "me@x.org.org now", "fuzzy_hit"),
    ("nothing", [("a", "zzzz")], "nothing", "exact_miss|fuzzy_miss"),
    ("Ada Berg and Bo Lund", [("X Y", "Ada Berg"), ("Z W", "Bo Lund")], "X Y and Z W", ""),
]


def resolve_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r, p) for i, (r, p, *_) in enumerate(REPLIES)], "id int, reply string, pairs array<struct<original:string,surrogate:string>>")
    return resolve(rows, failures="failures").select("id", "resolved", F.array_join(F.sort_array(F.col("failures.failure_type")), "|").alias("failures"))


def engine_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text masked by the whole engine as a session of its own, and restored from its state: how many come back as they were.

    Requests for a service are left out of the comparison, as their addresses move for good.
    """
    engine = Engine(FIXED)
    rows, state = engine.mask(texts(spark, d).withColumn("session", F.col("doc_id")), "session")
    back = engine.unmask(rows, "session", "sanitized", state)
    asks = F.size(address_pairs(F.coalesce("text", F.lit("")), F.lit(""), ascii=True)) > 0
    # Few texts have an address; the expressions of requests are tried on these alone.
    return back.filter(~(asks & is_service_query(F.col("text")))).groupBy((F.col("resolved") == F.col("text")).alias("same")).agg(F.count("*").alias("n"))


def engine_mask(spark: SparkSession, d: str) -> DataFrame:
    """All texts of a language as one session: masked texts, through detection, one map for the session, and back to the rows."""
    rows, _ = Engine(FIXED).mask(texts(spark, d), "lang")
    return rows.select("doc_id", "lang", "sanitized")


def engine_mask_twice(spark: SparkSession, d: str) -> DataFrame:
    """Masking again with the state of the first time gives the same texts and no new pairs."""
    engine = Engine(FIXED)
    rows, state = engine.mask(texts(spark, d), "lang")
    again, after = engine.mask(texts(spark, d), "lang", state=state)
    same = rows.select("doc_id", "sanitized").join(again.select("doc_id", F.col("sanitized").alias("second")), "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("sanitized") == F.col("second")).alias("same"))
    return same.crossJoin(after.join(state, ["session", "surrogate"], "left_anti").agg(F.count("*").alias("new_pairs")))


def engine_turns(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns of all user messages against an echo, with the nearest anonymised chunks of the literal texts as context."""
    engine = Engine(FIXED)
    store = rag.index(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), config=FIXED)
    messages = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    rows, _ = engine.turns(messages, "conv_id", "text", chunks=checkpoint(store))
    return rows.select("conv_id", "turn", "sent", "restored")


def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """The batch processor over all texts as questions, all fields but the times."""
    questions = texts(spark, d).select(F.col("doc_id").alias("idx"), F.col("text").alias("input"))
    return run_batch(questions, tuple(f for f in FIELDS if f != "stage_timings_ms"), config=FIXED)


def batch_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Whether the final outputs of a batch run against an echo are the questions."""
    return batch_answers(spark, d).groupBy((F.col("final_output") == F.col("question")).alias("same")).agg(F.count("*").alias("n"))


def anonymised_chunks(spark: SparkSession, d: str) -> DataFrame:
    return rag.anonymised_chunks(texts(spark, d).select("doc_id", "text"), config=FIXED)


def customer_mask(spark: SparkSession, d: str) -> DataFrame:
    """Names of customers as persons, unique within a nation."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), F.lit("PERSON").alias("type"), F.col("c_name").alias("text"))
    return surrogate_rows(rows, "session", FIXED)


def _unique_sql() -> str:
    """The rounds of `surrogate_rows` as common table expressions."""
    draw = lambda k: draw_sql("type", "original", "session::VARCHAR", FIXED.salt, str(k), ["PERSON"])
    out = ["r0 AS (SELECT DISTINCT c_nationkey AS session, 'PERSON' AS type, trim(c_name) AS original FROM customer)", f"s0 AS (SELECT *, {draw(0)} AS surrogate FROM r0)"]
    for k in range(1, ATTEMPTS):
        out.append(f"s{k} AS (SELECT session, type, original, CASE WHEN r > 1 OR surrogate = original THEN {draw(k)} ELSE surrogate END AS surrogate FROM (SELECT *, row_number() OVER (PARTITION BY session, surrogate ORDER BY original) AS r FROM s{k - 1}))")
    last = f"SELECT session, type, original, surrogate || CASE WHEN r > 1 THEN '_' || lpad(printf('%x', r), 4, '0') ELSE '' END AS surrogate FROM (SELECT *, row_number() OVER (PARTITION BY session, surrogate ORDER BY original) AS r FROM s{ATTEMPTS - 1})"
    return f"WITH {', '.join(out)} {last}"


def shadow_state(spark: SparkSession, d: str) -> DataFrame:
    """Two updates of a state, the second with pairs that the first one has: sizes of the maps by session."""
    pairs = customer_mask(spark, d).select(F.col("session").cast("string").alias("session"), "original", "surrogate")
    empty = spark.createDataFrame([], state.STATE)
    return state.mapping_counts(state.update(state.update(empty, pairs), pairs))


def aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sealed and opened maps by session; with another secret they open as empty ones."""
    pairs = customer_mask(spark, d).select(F.col("session").cast("string").alias("session"), "original", "surrogate")
    rows = state.update(spark.createDataFrame([], state.STATE), pairs)
    files = state.sealed(rows, TEST_SECRET)
    # A large session is sealed in several rows.
    size = lambda secret, name: state.unsealed(files, secret).groupBy("session").agg(F.sum(F.size("pairs")).cast("int").alias(name))
    return size(TEST_SECRET, "n").join(size(TEST_SECRET[::-1], "n_wrong_secret"), "session")


def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return state.conversation_summary(table(spark, d, "conversations"))


def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    """Turns wrapped as replies of three kinds of services, and taken out again."""
    t = F.col("text")
    kinds = [F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))), F.to_json(F.struct(t.alias("text"))), t]
    wrapped = F.element_at(F.array(*kinds), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", reply_text(wrapped).alias("text"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return rag.numbered_chunks(table(spark, d, "documents"))


def context_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rag.context_prompt(rag.chunks(F.col("text"))).alias("prompt"))


def rag_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """For each vector whose id is divisible by 20, the nearest of all vectors."""
    vectors = table(spark, d, "embeddings")
    return rag.top_k_each(vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "surrogate_map": surrogate_map, "masked_text": masked_text, "redacted_text": redacted_text, "unmask_roundtrip": unmask_roundtrip, "resolve_replies": resolve_replies, "resolve_failures": resolve_failures, "resolve_cases": resolve_cases,
    "engine_roundtrip": engine_roundtrip, "engine_mask": engine_mask, "engine_mask_twice": engine_mask_twice, "engine_turns": engine_turns, "batch_answers": batch_answers, "batch_outputs": batch_outputs, "anonymised_chunks": anonymised_chunks,
    "customer_mask": customer_mask, "shadow_state_by_session": shadow_state, "aes_roundtrip": aes_roundtrip, "conversation_summary": conversation_summary, 
    "reply_texts": reply_texts, "chunk_documents": chunk_documents, "context_prompts": context_prompts, "rag_topk_cosine": rag_topk_cosine,
}

_SURROGATE = draw_sql("type", "original", "doc_id::VARCHAR", FIXED.salt)
_NAMED = f"SELECT doc_id, type, original, {_SURROGATE} AS surrogate FROM (SELECT DISTINCT doc_id, type, value AS original FROM spans)"
_MASKED = f"""SELECT doc_id, text, coalesce(list_reduce(list_concat([text], list_transform(p, lambda x: x.o || chr(1) || x.s)), lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2))), text) AS masked
  FROM texts LEFT JOIN (SELECT doc_id, list({{'o': original, 's': surrogate}} ORDER BY length(original) DESC, original) AS p FROM ({_NAMED}) GROUP BY doc_id) USING (doc_id)"""
_CHUNKS = "SELECT doc_id, CASE WHEN length(text) <= 512 THEN [text] ELSE list_transform(range(0, length(text), 410), lambda a: substr(text, a + 1, 512)) END AS cs FROM documents WHERE text IS NOT NULL"
ORACLE_SQL: dict[str, str] = {
    "surrogate_map": f"WITH {SPANS_SQL} {_NAMED}",
    "masked_text": f"WITH {SPANS_SQL} SELECT doc_id, masked FROM ({_MASKED})",
    "unmask_roundtrip": f"WITH {TEXTS_SQL} SELECT true AS same, count(*) AS n FROM texts WHERE text IS NOT NULL",
    "resolve_cases": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(o)}, {sql_text(f)})" for i, (_, _, o, f) in enumerate(REPLIES)) + ") AS t(id, resolved, failures)",
    "batch_outputs": f"WITH {TEXTS_SQL} SELECT true AS same, count(*) AS n FROM texts",
    "engine_roundtrip": f"WITH {TEXTS_SQL} SELECT true AS same, count(*) AS n FROM texts WHERE text IS NOT NULL AND NOT (regexp_matches(text, {sql_text(service.ADDRESS)}) AND NOT regexp_matches(text, {sql_text(service.SENSITIVE_REGEX)}) AND regexp_matches(text, {sql_text(service.SERVICE_REGEX)}))",
    "engine_mask_twice": f"WITH {TEXTS_SQL} SELECT count(*) AS n, count(*) FILTER (text IS NOT NULL) AS same, 0::BIGINT AS new_pairs FROM texts",
    "customer_mask": _unique_sql(),
    "shadow_state_by_session": f"SELECT CAST(session AS VARCHAR) AS session, count(*) AS n FROM ({_unique_sql()}) GROUP BY session",
    "aes_roundtrip": "SELECT CAST(c_nationkey AS VARCHAR) AS session, count(DISTINCT c_name)::INT AS n, 0 AS n_wrong_secret FROM customer GROUP BY c_nationkey",
    "conversation_summary": "SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id",
    "reply_texts": "SELECT conv_id, turn, text FROM conversations",
    "chunk_documents": f"""SELECT doc_id, i::INT AS chunk_index, 'doc_' || (before + i) || '_' || i AS chunk_id, cs[i + 1] AS chunk
      FROM (SELECT doc_id, cs, unnest(range(len(cs))) AS i, coalesce(sum(len(cs)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ({_CHUNKS}))""",
    "context_prompts": f"SELECT doc_id, 'Answer with the help of this context.' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(cs) + 1), lambda i: '[Document excerpt ' || i || ']' || chr(10) || cs[i]), chr(10) || chr(10) || '---' || chr(10) || chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' AS prompt FROM ({_CHUNKS})",
    "redacted_text": f"WITH {SPANS_SQL}, s AS (SELECT doc_id, type, start AS a, stop AS b FROM spans), g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a FROM s)"
    " SELECT doc_id, string_agg(coalesce(CASE WHEN k = 0 THEN substr(text, a + 1, b - a) ELSE '[' || type || ']' END, ''), '' ORDER BY a, k) AS redacted FROM ("
    " SELECT d.doc_id, text, 0 AS k, NULL AS type, coalesce(p, 0) AS a, coalesce(g.a, length(text)) AS b FROM texts d LEFT JOIN g USING (doc_id)"
    " UNION ALL SELECT doc_id, text, 1, s.type, s.a, s.b FROM s JOIN texts USING (doc_id)"
    " UNION ALL SELECT doc_id, text, 0, NULL, max(s.b), length(text) FROM s JOIN texts USING (doc_id) GROUP BY doc_id, text) GROUP BY doc_id",
    "rag_topk_cosine": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
      SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 3""",
}
