"""Keyed reversible state: one row for each pair of a session, sealed at rest.

A state is a DataFrame (session, original, surrogate, seq). Sealed, it is a row for each PART pairs of a session: JSON under a key
derived from the secret and the session's name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.crypto import derived_key, seal, unseal
from cloakframe.schema import PAIRS

STATE = "session string, original string, surrogate string, seq bigint"
SEALED = "array<struct<seq:bigint,original:string,surrogate:string>>"
#: Pairs of one sealed row.
PART = 10_000


def update(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state with the pairs of `new` (session, original, surrogate): a later pair of a surrogate replaces the earlier one."""
    last = state.groupBy("session").agg(F.max("seq").alias("last"))
    # Numbers that rise, with gaps: no session has to be ordered in one task.
    added = new.select("session", "original", "surrogate", (F.monotonically_increasing_id() + 1).alias("r")).join(last, "session", "left").select("session", "original", "surrogate", (F.coalesce("last", F.lit(0)) + F.col("r")).cast("bigint").alias("seq"))
    newest = Window.partitionBy("session", "surrogate").orderBy(F.desc("seq"))
    return state.select("session", "original", "surrogate", "seq").unionByName(added).withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r")


def flush(state: DataFrame, sessions: list[str]) -> DataFrame:
    """The state without some sessions."""
    return state.filter(~F.col("session").isin(*sessions)) if sessions else state


def as_pairs(state: DataFrame) -> DataFrame:
    """(session, pairs): the pairs of each session in the order in which they came."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "original", "surrogate")))
    return state.groupBy("session").agg(rows.alias("x")).select("session", F.transform("x", lambda r: F.struct(r["original"].alias("original"), r["surrogate"].alias("surrogate"))).alias("pairs"))


def sealed(state: DataFrame, secret: bytes) -> DataFrame:
    """(session, part, sealed): nonce, ciphertext and tag of a session's pairs, PART of them in a row, so that no session is one value."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "original", "surrogate")))
    parts = state.groupBy("session", F.floor(F.col("seq") / PART).alias("part")).agg(rows.alias("pairs"))
    keyed = parts.withColumn("__key", derived_key(secret, F.col("session")))
    return keyed.select("session", "part", seal(F.encode(F.to_json("pairs"), "UTF-8"), F.col("__key")).alias("sealed"))


def unsealed(files: DataFrame, secret: bytes) -> DataFrame:
    """(session, pairs) of each sealed row: no pairs where the data is missing, short, damaged or of another secret."""
    keyed = files.select("session", "sealed", derived_key(secret, F.col("session")).alias("__key"))
    text = unseal(F.col("sealed"), F.col("__key"))
    return keyed.select("session", F.coalesce(F.from_json(text, SEALED), F.array().cast(SEALED)).alias("pairs"))


def load(spark: SparkSession, folder: str, secret: bytes) -> DataFrame:
    """The latest state that `save` wrote to a folder; an empty one where there is none."""
    versions = sorted((int(m[1]), p) for p in _list(spark, folder) if (m := re.fullmatch(r"state-(\d+)", p)))
    if not versions:
        return spark.createDataFrame([], STATE)
    opened = unsealed(spark.read.parquet(f"{folder}/{versions[-1][1]}"), secret)
    return opened.select("session", F.explode("pairs").alias("p")).select("session", "p.original", "p.surrogate", F.col("p.seq").cast("bigint").alias("seq"))


def save(state: DataFrame, folder: str, secret: bytes) -> DataFrame:
    """Writes a state as a new version of a folder and drops those before the last one; returns it as it was read back.

    The last version but one stays until the next: readers of it go on, and a write that breaks off changes nothing.
    """
    spark = state.sparkSession
    old = sorted(int(m[1]) for p in _list(spark, folder) if (m := re.fullmatch(r"state-(\d+)", p)))
    number = old[-1] + 1 if old else 1
    sealed(state, secret).write.parquet(f"{folder}/writing-{number}")
    files, path = _files(spark, folder)
    files.rename(path(f"{folder}/writing-{number}"), path(f"{folder}/state-{number}"))
    for n in old[:-1]:
        files.delete(path(f"{folder}/state-{n}"), True)
    return load(spark, folder, secret)


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _list(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(path(folder))] if files.exists(path(folder)) else []


def mapping_counts(state: DataFrame) -> DataFrame:
    """(session, n): the size of each session's map."""
    return state.groupBy("session").agg(F.count("*").alias("n"))


def conversation_summary(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, message_count, first_turn, last_turn, roles) of each conversation, by id."""
    return messages.groupBy(conv).agg(F.count("*").alias("message_count"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count_distinct("role").alias("roles"))


def relative_time(then, now):
    """A time as "just now", "5m ago", "3h ago", "2d ago" or a date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda unit, per: F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago("m", 60)).when(s < 86400, ago("h", 3600)).when(s < 7 * 86400, ago("d", 86400)).otherwise(F.date_format(then, "yyyy-MM-dd"))
