"""Columns that no expression gives, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def with_column(frame: DataFrame, name: str, kind: str, make: Callable, *inputs: str) -> DataFrame:
    """`frame` with a new last column `name` of the type `kind`: `make` of the values of `inputs`, row by row within a batch."""
    wanted = _parse_datatype_string(kind)
    if isinstance(wanted, StructType) and len(wanted.fields) == 1 and not kind.lstrip().lower().startswith("struct"):
        wanted = wanted.fields[0].dataType
    arrow = to_arrow_type(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [make(*row) for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(name, wanted)]))
