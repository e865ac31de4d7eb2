"""The public surface: configure, scan, mask, unmask, flush, whole turns of chats."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.config import EngineConfig
from cloakframe.functions.batches import list_array, with_columns
from cloakframe.functions.crypto import device_secret
from cloakframe.functions.spans import replace_pairs
from cloakframe.operators import rag
from cloakframe.operators import state as states
from cloakframe.operators.batch import echo
from cloakframe.operators.cascade import Cascade
from cloakframe.operators.resolve import resolve
from cloakframe.operators.rewrite import mask as mask_rows
from cloakframe.operators.rewrite import surrogate_rows
from cloakframe.schema import PAIRS
from cloakframe.sources.io import reply_text
from cloakframe.storage import checkpoint


class Engine:
    """Settings with the operators that use them; a session's pairs are a DataFrame (see `state.STATE`).

    With `state_dir` the sessions are sealed in that folder: `mask` and `turns` read them, and write what they add.
    """

    def __init__(self, config: EngineConfig | None = None):
        self.config = config or EngineConfig()

    def configure(self, **options: object) -> Engine:
        return Engine(self.config.with_options(**options))

    # --- sessions ------------------------------------------------------------------------------------

    def _secret(self) -> bytes:
        return device_secret(f"{self.config.state_dir}/secret.key")

    def load(self, spark: SparkSession) -> DataFrame:
        """The state in `state_dir`; an empty one where there is none. Rows that don't open have no pairs."""
        return states.load(spark, self.config.state_dir, self._secret()) if self.config.state_dir else spark.createDataFrame([], states.STATE)

    def save(self, state: DataFrame) -> DataFrame:
        """Writes a state to `state_dir` (the latest version counts), if there is one."""
        return states.save(state, self.config.state_dir, self._secret()) if self.config.state_dir else state

    def flush(self, state: DataFrame, *sessions: str) -> DataFrame:
        """The state without some sessions, in `state_dir` as well."""
        return self.save(states.flush(state, list(sessions)))

    # --- texts ---------------------------------------------------------------------------------------

    def scan(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds found (value -> type); types that are switched off are listed too, the last type of a value counts."""
        stages = Cascade(self.config.with_options(pii_off=()))
        kind = pa.struct([("value", pa.string()), ("type", pa.string())])

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [list_array([list({e.text: e.type for e in stages.find(t).confirmed}.items()) for t in batch.column(text).to_pylist()], kind)]

        return with_columns(df, {"found": "array<struct<value:string,type:string>>"}, run).withColumn("found", F.map_from_entries("found"))

    pii_finder = scan

    def mask(self, df: DataFrame, session: str, text: str = "text", state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(the rows with sanitized, the new state). All rows of a session share one map; known originals keep their surrogates.

        Texts are read once and written down with what was found. Entities meet by session, and each row gets back the pairs of its
        own entities alone: a session may be of any size. A null session is one of its own; null texts stay null.
        """
        spark = df.sparkSession
        state = self.load(spark) if state is None else state
        rows = mask_rows(df.withColumn("__session", F.coalesce(F.col(session).cast("string"), F.lit(""))), "__session", text, self.config)
        rows = checkpoint(rows.select(*df.columns, "__session", "fuzzed", F.transform("confirmed", lambda e: F.struct("__session", e["type"].alias("type"), e["text"].alias("text"))).alias("__found")).withColumn("__row", F.monotonically_increasing_id()))
        found = rows.select("__row", F.explode("__found").alias("e")).select("__row", F.col("e.__session").alias("session"), "e.type", "e.text")
        known = state.select("session", "original", "surrogate", "seq").groupBy("session", "original").agg(F.max_by("surrogate", "seq").alias("surrogate"))
        pairs = checkpoint(surrogate_rows(found.select("session", "type", "text"), "session", self.config, known).select("session", "original", "surrogate"))
        after = self.save(checkpoint(states.update(state, pairs.join(state.select("session", "original", "surrogate"), ["session", "original", "surrogate"], "left_anti"))))
        mine = found.join(pairs, (found.session == pairs.session) & (F.trim(found.text) == pairs.original)).groupBy("__row").agg(F.collect_list(F.struct("original", "surrogate")).alias("__pairs"))
        work = replace_pairs(F.col(text), F.col("fuzzed"))
        clean = replace_pairs(work, F.coalesce("__pairs", F.array().cast(PAIRS)))
        return rows.join(mine, "__row", "left").withColumn("sanitized", clean).select(*df.columns, "sanitized"), after

    def unmask(self, replies: DataFrame, session: str, reply: str, state: DataFrame | None = None) -> DataFrame:
        """Adds resolved and failures: replies (texts, or services' JSON) with the session's originals back."""
        state = self.load(replies.sparkSession) if state is None else state
        maps = states.as_pairs(state).select(F.col("session").alias("__s"), F.col("pairs").alias("__pairs"))
        rows = replies.join(maps, F.coalesce(F.col(session).cast("string"), F.lit("")) == F.col("__s"), "left").withColumn("__reply", reply_text(F.col(reply)))
        return resolve(rows, "__reply", "__pairs", "resolved", "failures", self.config.fuzzy_threshold).select(*replies.columns, "resolved", "failures")

    def turns(self, messages: DataFrame, session: str, text: str, responder: Callable[[Column], Column] = echo, state: DataFrame | None = None, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(the rows with sent, reply and restored, the new state): one whole turn of each session.

        A message is masked, gets the nearest of `chunks` (see `rag.index`) as context, goes to the service, and the reply gets its originals
        back. `sent` and `reply` are what the service's history holds, the message and `restored` what the user's history does.
        """
        masked, after = self.mask(messages, session, text, state)
        masked = masked.withColumn("__turn", F.monotonically_increasing_id())
        if chunks is not None:
            masked = checkpoint(masked)
            near = rag.nearest_chunks(masked.filter("sanitized IS NOT NULL").select("__turn", "sanitized"), "__turn", "sanitized", chunks, self.config.rag_top_k)
            masked = masked.join(near, "__turn", "left").withColumn("sent", F.concat(rag.context_prompt(F.coalesce("chunks", F.array().cast("array<string>"))), "sanitized"))
        else:
            masked = masked.withColumn("sent", F.col("sanitized"))
        rows = checkpoint(masked.withColumn("reply", responder(F.col("sent"))))
        out = self.unmask(rows, session, "reply", after)
        return out.select(*messages.columns, "sent", "reply", F.col("resolved").alias("restored")), after
