"""Small helpers shared by the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from predio.llm.words import row_blocks, text_buffers


#: A stored table of keys with at most so many rows may be sent to every task.
BROADCAST_ROWS = 2_000_000


def maybe_broadcast(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers per row, sent to every task if it has few enough rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that ``names`` would clash with, compared as Spark does."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        taken = set(names)
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken])
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    work: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    text: str = "text",
    block: int = 1 << 22,
) -> DataFrame:
    """``df`` plus columns computed from whole texts, some MB at a time.

    ``work()`` is called once per task and returns a function from a text column (without
    nulls) to the new columns.  Columns of ``df`` named like a new one are replaced, so the
    text column must not be among them.
    """
    df = without(df, [f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            column = batch.column(at)
            if column.null_count:
                column = column.fill_null("")
            _, edges = text_buffers(column)
            for first, last in row_blocks(edges, block):
                part = batch.slice(first, last - first)
                new = function(column.slice(first, last - first))
                yield pa.RecordBatch.from_arrays(
                    [*[c.cast(f.type) for c, f in zip(part.columns, arrow)], *new], schema=arrow
                )

    return df.mapInArrow(run, schema)
