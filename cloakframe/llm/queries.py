"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import chat, decontaminate, html, langid, licenses, matroska, mixing, secrets, simhash, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_html_extract": html.op2_html_extract,
    "op3_chat_format": chat.op3_chat_format,
    "op4_matroska_packets": matroska.op4_matroska_packets,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
}
