"""The corpus pipeline: stages over `documents`, each one's rows written and read again by the next.

Language identification drops texts of no known language, near-duplicate search keeps one document of
each group, decontamination drops documents with test items, the secret scan blanks secrets, and the
mixture takes documents by source until the budget is used up.

All stages take null ids, null, empty and very long texts, ties, repeated rows, empty tables and columns of
any names; what they make of them is said below, and more closely at the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import ensure_checkpoint_dir, table
from cloakframe.llm.decontaminate import decontaminate
from cloakframe.llm.langid import keep_languages
from cloakframe.llm.mixing import mix
from cloakframe.llm.secrets import redact
from cloakframe.llm.simhash import dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; `lang` is filled in, or corrected where it is clearly wrong.

    Null, empty and letterless texts are rejected. Of equal languages the first by name counts. A null doc_id changes nothing;
    repeated rows fare alike; texts are parsed whole. Without labelled rows only letterless texts go.
    """
    return keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if it matches one of a smaller doc_id that stays, so one of each group stays.

    Rows with a null doc_id or without a text stay. Of rows that repeat a doc_id one stays. Texts are compared whole.
    """
    return dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go.

    Rows with a null doc_id or text stay, and so do all without items. Rows that repeat a doc_id go together. Texts are searched whole.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced and n_chars follows.

    Null and empty texts stay as they are; repeated rows fare alike; overlapping secrets are replaced as one. Texts are searched whole.
    """
    return redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that weighted fair queueing takes within the budget, with their columns.

    A null source is one of its own; a null text has no tokens. Ties go by source, then by the hash of doc_id; repeated rows enter, or
    don't, together.
    """
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixture", source_mixture),
]

#: The first two stages (suffix automata, SimHash) can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again.

    What a stage has read is deleted when the next one's rows are written; the last stage's rows stay for the reader.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            files.delete(path(before), True)
        before = at
    return docs
