"""Chat formatting with a grammar round trip.

A conversation is rendered to one text; a deterministic parser reads it again, and the turns that it
recovers are compared with the source. Where they differ, the content is in conflict with the grammar:
one more level of escapes is put on the conflicting turns, until the round trip is the identity.

Grammar:   chat = turn*      turn = "<|" role "|" level "|>" LF content LF "<|end|>" LF
role is one of ROLES; level counts how often the content is escaped. One level of escapes puts a
backslash before each run "backslashes <|" of the content.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import table

ROLES = ("system", "user", "assistant", "tool")
OTHER = "other"

_HEAD = re.compile(r"<\|([a-z]+)\|([0-9]+)\|>\n")
_TAIL = "\n<|end|>\n"
_ESCAPE = re.compile(r"(\\*)<\|")
_UNESCAPE = re.compile(r"\\(\\*)<\|")

Turn = tuple[str, str]


def escape(text: str, level: int) -> str:
    for _ in range(level):
        text = _ESCAPE.sub(lambda m: "\\" + m[0], text)
    return text


def unescape(text: str, level: int) -> str:
    for _ in range(level):
        text = _UNESCAPE.sub(lambda m: m[1] + "<|", text)
    return text


def render(turns: list[Turn], levels: list[int]) -> str:
    return "".join(f"<|{role}|{level}|>\n{escape(text, level)}{_TAIL}" for (role, text), level in zip(turns, levels))


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered chat; None if the text isn't one. A turn ends at the first end mark."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.find(_TAIL, head.end() - 1) if head else -1
        if not head or end < 0 or head[1] not in (*ROLES, OTHER):
            return None
        out.append((head[1], unescape(text[head.end() : end], int(head[2])) if end >= head.end() else ""))
        at = end + len(_TAIL)
    return out


def round_trip(turns: list[Turn]) -> tuple[str, int, int]:
    """The rendered chat that parses back into `turns`, the turns that had to be escaped, and the rounds.

    A turn is in conflict if it doesn't survive alone; escaped once, no mark is left in it, so two
    rounds are enough, which the last comparison proves.
    """
    levels, rounds = [0] * len(turns), 0
    while True:
        rounds += 1
        text = render(turns, levels)
        if parse(text) == turns:
            return text, sum(x > 0 for x in levels), rounds
        bad = [i for i, t in enumerate(turns) if parse(render([t], [levels[i]])) != [t]]
        if not bad:
            raise ValueError("a chat doesn't survive the round trip although each of its turns does")
        for i in bad:
            levels[i] += 1


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, rounds, rendered): one row for each conversation.

    Turns go by turn, then role and text; a null turn comes first. A null text is an empty one; a role
    beyond ROLES (null too) is rendered as "other". Repeated rows are repeated turns, and ties keep no other
    order. A row with a null conv_id is a conversation of its own, so such rows never gather in one task. Other
    columns than conv_id, turn, role and text are not read; an empty table gives an empty result. A conversation is
    one text, so its turns meet in one task, however long they are.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(OTHER).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), turn.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        turns = batch.column("turns")
        made = [round_trip([(t["role"], t["text"]) for t in own]) for own in turns.to_pylist()]
        whole = lambda xs: pa.array(xs, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), pc.list_value_length(turns).cast(pa.int32()), whole([x[1] for x in made]), whole([x[2] for x in made]), pa.array([x[0] for x in made], pa.string())], ["conv_id", "n_turns", "n_escaped", "rounds", "rendered"])

    return chats.select("conv_id", "turns").mapInArrow(lambda batches: map(run, batches), "conv_id long, n_turns int, n_escaped int, rounds int, rendered string")


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns of rendered chats; a null text, and one that isn't a chat, give none.

    A null conv_id stays null; repeated rows give repeated results; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, i, r, t) for n, x in enumerate(batch.column("rendered").to_pylist()) for i, (r, t) in enumerate(parse(x) or [] if x is not None else [])]
        ids = batch.column("conv_id").take(pa.array([x[0] for x in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string())))], ["conv_id", "position", "role", "text"])

    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), "rendered").mapInArrow(lambda batches: map(run, batches), "conv_id long, position int, role string, text string")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`format_chats` over the whole table `conversations`; one shuffle by conversation."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(text, '') AS text,
         CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE 'other' END AS role
  FROM conversations),
e AS (SELECT *, CASE WHEN contains(text || chr(10), chr(10) || '<|end|>' || chr(10)) OR starts_with(text || chr(10), '<|end|>' || chr(10)) THEN 1 ELSE 0 END AS level FROM t)
SELECT conv_id, count(*)::INT AS n_turns, sum(level)::INT AS n_escaped, (1 + max(level))::INT AS rounds,
       string_agg('<|' || role || '|' || level || '|>' || chr(10) || CASE WHEN level = 1 THEN regexp_replace(text, '(\\*<\|)', '\\\1', 'g') ELSE text END || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM e GROUP BY conv_id, alone
"""
