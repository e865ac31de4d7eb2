"""Reading and writing: question, key and answer files, texts, sealed sessions, replies of services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.crypto import derived_key, unseal
from cloakframe.operators.evaluate import paired_lengths
from cloakframe.schema import ANSWER

QUESTION = "input string"


def read_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(idx, element's fields) of a file with one JSON array; idx is the place in it. A file that isn't one has no rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{element}>>")).alias("idx", "e")).select(F.col("idx").cast("long").alias("idx"), "e.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, "input:string")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(idx, question, answer_key): the key as it stands, JSON or text."""
    return read_array(spark, path, "Question:string,`Answer-Key`:string").select("idx", F.col("Question").alias("question"), F.col("Answer-Key").alias("answer_key"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    fields = ANSWER.replace("idx bigint, ", "")
    schema = spark.createDataFrame([], fields).schema
    text = spark.read.text(path, wholetext=True)
    from pyspark.sql.types import ArrayType

    return text.select(F.posexplode(F.from_json("value", ArrayType(schema))).alias("idx", "e")).select(F.col("idx").cast("long").alias("idx"), "e.*")


def read_evaluation(spark: SparkSession, questions: str, keys: str, answers: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three files whose rows belong together by place; ValueError if their lengths differ."""
    out = read_questions(spark, questions), read_keys(spark, keys), read_answers(spark, answers)
    paired_lengths(*out)
    return out


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Many files of one JSON object a line: the form for large results."""
    df.write.mode(mode).json(path)


def as_array(df: DataFrame, idx: str = "idx") -> DataFrame:
    """One row with all rows as a JSON array, by idx: for results that one reader takes whole."""
    rows = df.select(F.struct(idx, F.to_json(F.struct(*[c for c in df.columns if c != idx])).alias("j")).alias("r"))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["j"]), ",\n"), F.lit("]")).alias("value"))


def remaining(questions: DataFrame, done: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows that an earlier run hasn't answered."""
    return questions.join(done.select(idx), idx, "left_anti")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """(session, sealed) of a folder of sealed files named by session."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return spark.read.format("binaryFile").load(path).select(name.alias("session"), F.col("content").alias("sealed"))


def opened(files: DataFrame, secret: bytes) -> DataFrame:
    """(session, text): sealed files opened; data that doesn't open but is JSON text is taken as it stands; null otherwise."""
    keyed = files.select("session", "sealed", derived_key(secret, F.col("session")).alias("__key"))
    plain = F.try_validate_utf8("sealed").cast("string")
    return keyed.select("session", F.coalesce(unseal(F.col("sealed"), F.col("__key")), F.when(F.try_parse_json(plain).isNotNull(), plain)).alias("text"))


def summaries(texts: DataFrame) -> DataFrame:
    """(session, id, created, message_count, rag_mode) of conversations as JSON, by session; those that can't be read have nulls and 0 messages."""
    kind = "id string, created string, rag_mode boolean, messages array<struct<role:string,content:string,timestamp:string>>"
    x = F.from_json("text", kind)
    return texts.select("session", x.alias("x")).select("session", "x.id", "x.created", F.greatest(F.coalesce(F.size("x.messages"), F.lit(0)), F.lit(0)).alias("message_count"), F.coalesce("x.rag_mode", F.lit(False)).alias("rag_mode")).orderBy("session")


def reply_text(reply: Column) -> Column:
    """The text of a service's reply: a block list's first text, a choice's message, a text field, or the reply as it stands."""
    is_json = F.try_parse_json(reply).isNotNull() & F.ltrim(reply).startswith("{")
    field = F.coalesce(*[F.get_json_object(reply, p) for p in ("$.content[0].text", "$.choices[0].message.content", "$.text")])
    return F.coalesce(F.when(is_json, field), reply)


def append_vectors(df: DataFrame, path: str) -> None:
    """Chunks with vectors, appended to a store of Parquet files."""
    df.write.mode("append").parquet(path)
