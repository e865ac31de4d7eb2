"""Text columns through Python by whole Arrow batches: one pass, no shuffle, and a boundary that Catalyst doesn't take apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from cloakframe.functions.spanlist import Entity

#: Arrow's form of `schema.ENTITY`.
ENTITY_TYPE = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64()), ("source", pa.string())])
PAIR_TYPE = pa.struct([("original", pa.string()), ("surrogate", pa.string())])
#: Rows that are worked on at once; bounds what a worker holds besides the batch.
ROWS = 512


def list_array(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as a list column of structs, column by column."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    columns = list(zip(*[x for r in rows for x in r])) or [()] * kind.num_fields
    flat = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(columns)], fields=[kind.field(i) for i in range(kind.num_fields)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def entity_array(rows: list[list[Entity]]) -> pa.Array:
    return list_array(rows, ENTITY_TYPE)


def to_entities(col: pa.Array) -> list[list[Entity]]:
    """The entities of each row; a null has none."""
    return [[Entity(*(e[f] for f in Entity._fields)) for e in row or ()] for row in col.to_pylist()]


def with_columns(df: DataFrame, new: dict[str, str], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """`df` with columns that `fn` makes of each batch; columns of the same names are replaced."""
    taken = {c.lower() for c in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    added = _parse_datatype_string(", ".join(f"`{c}` {kind}" for c, kind in new.items()))
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    names = [*kept, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *fn(part)], names)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """One or many rows for each row of `df`: `fn` gets the values of `columns` and gives tuples."""
    fields = _parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [out for values in zip(*(part.column(c).to_pylist() for c in columns)) for out in fn(*values)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows))], schema=arrow)

    return df.select(*columns).mapInArrow(run, fields)
