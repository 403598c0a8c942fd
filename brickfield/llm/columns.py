"""Adds columns computed in Python to every row, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .vocab import let_go
from .wordscan import give_back, thrifty

Maker = Callable[[], Callable[[pa.RecordBatch], list]]


def with_columns(df: DataFrame, new: list[T.StructField], make: Maker) -> DataFrame:
    """Keeps df's columns and adds `new`; an input column of the same name is replaced.

    make() runs once in each task and returns a function from a record batch (with all of
    df's columns) to the new columns' values, as lists or Arrow arrays.
    """
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name not in names]
    types = [to_arrow_type(f.dataType) for f in new]
    old = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        work = None
        for batch in batches:
            if work is None:
                work = make()
                let_go()
            values = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(work(batch), types, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in old] + values
            yield pa.RecordBatch.from_arrays(columns, names=[*old, *(f.name for f in new)])
        give_back()

    return df.mapInArrow(run, T.StructType([*kept, *new]))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
