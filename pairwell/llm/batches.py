"""Arrow batches inside tasks: texts as bytes, and columns added to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Fields = list[tuple[str, T.DataType]]

#: Rows handed to a function at once; texts of a batch are read one by one.
ROWS = 256


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives none."""
    for value in pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()):
        yield value.as_py()


def texts(column: pa.Array) -> Iterator[str]:
    """Each text; null gives the empty one."""
    for value in column:
        yield value.as_py() or ""


def added(df: DataFrame, column: str, fields: Fields, work: Callable[[pa.Array], list[tuple]],
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``fields`` computed from ``column``.

    ``work`` maps an array of texts to one tuple per text.  Rows stay where
    they are and nothing is shared between them.
    """
    keep = df.columns if keep is None else keep
    rows = df.select(*[f"`{c}`" for c in keep], df[f"`{column}`"].alias("__body"))
    schema = T.StructType([rows.schema[i] for i in range(len(keep))] + [T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = [f.name for f in schema]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = list(zip(*work(part.column(width)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)]
                    + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)
