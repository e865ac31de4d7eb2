"""Masking conversations as a stream: one state of pairs for each session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakframe.config import EngineConfig
from cloakframe.functions.spanlist import best_by_text
from cloakframe.functions.surrogates import pairs_of
from cloakframe.operators.cascade import Cascade
from cloakframe.operators.rewrite import replaced
from cloakframe.operators.service import asks_for_service, moved_addresses

OUT = "session string, turn bigint, sanitized string, n_pairs int"


def _masker(config: EngineConfig, idle_ms: int | None):
    stages, salt = Cascade(config), config.salt

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Turns of one session in order: originals that are known keep their surrogate, new ones get one that isn't taken."""
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[str, str] = dict(json.loads(state.get[0])) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        out = []
        for turn, whole in zip(rows["turn"], rows["text"]):
            service = asks_for_service(whole)
            moved = moved_addresses(whole, key[0]) if service else {}
            text = replaced(whole, moved)
            found = best_by_text(stages.find(text, [*known.values(), *moved.values()], service).confirmed)
            pairs = pairs_of([(e.type, e.text) for e in found], key[0], salt, known)
            known.update(pairs)
            out.append((key[0], int(turn), replaced(text, pairs), len(known)))
        state.update((json.dumps(list(known.items())),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "turn", "sanitized", "n_pairs"])

    return run


def mask_stream(messages: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text", config: EngineConfig = EngineConfig(), idle_ms: int | None = None) -> DataFrame:
    """(session, turn, sanitized, n_pairs) of each message of a stream; null texts are empty ones.

    A session's pairs are its state, and stay until it is flushed: replies to it can always be restored. With `idle_ms` a session without a
    message for so long is forgotten; write its pairs elsewhere before, if replies may still come.
    """
    rows = messages.select(F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"), F.col(turn).cast("long").alias("turn"), F.coalesce(text, F.lit("")).alias("text"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("session").applyInPandasWithState(_masker(config, idle_ms), OUT, "pairs string", "append", timeout)


def windowed_types(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of tumbling windows; later rows than the watermark allows are dropped. Works on batches too."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
