"""The pattern stage as an operator: sixteen ordered expressions, checks, skip values and claiming."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import spanlist
from cloakframe.functions.batches import entity_array, map_rows, with_columns
from cloakframe.functions.patterns import ASCII_PATTERNS, PATTERNS
from cloakframe.schema import ENTITIES


def scan(df: DataFrame, text: str = "text", out: str = "entities", types: tuple[str, ...] | None = None, skip: str | None = None, ascii: bool = False) -> DataFrame:
    """Adds the entities of the pattern stage to each row, by start.

    `skip` names an array column of values that are left alone. Null texts have no entities. One pass over the texts, no
    shuffle; filter on other columns before. `ascii`: words end at letters that aren't ASCII, as in SQL (see `ascii_words`).
    """
    patterns = [p for p in (ASCII_PATTERNS if ascii else PATTERNS) if types is None or p.type in types]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        left = batch.column(skip).to_pylist() if skip else [None] * len(texts)
        return [entity_array([spanlist.scan(t, patterns, s) for t, s in zip(texts, left)])]

    return with_columns(df, {out: ENTITIES}, run)


def extract(df: DataFrame, type_: str, key: str, text: str = "text", ascii: bool = False) -> DataFrame:
    """(key, value, start, stop) of all checked matches of one pattern, without claiming; `ascii` as in `scan`."""
    pattern = next(p for p in (ASCII_PATTERNS if ascii else PATTERNS) if p.type == type_)
    kind = dict(df.dtypes)[key]
    found = lambda k, t: ((k, e.text, e.start, e.end) for e in spanlist.candidates(t, pattern))
    return map_rows(df, [key, text], f"`{key}` {kind}, value string, start int, stop int", found)


def explode_entities(df: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    """One row for each entity, with its place in the array."""
    return df.select(key, F.posexplode(entities).alias("ord", "e")).select(key, "ord", *[F.col(f"e.{f}").alias("stop" if f == "end" else f) for f in ("text", "start", "end", "type", "score", "source")])
