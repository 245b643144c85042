"""Small helpers of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE = 1024


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def map_rows(df: DataFrame, ddl: str, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]) -> DataFrame:
    """mapInArrow with columns as Python lists: whole numbers stay exact, nulls stay None."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict[str, list]]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}

        for out in work(lists()):
            columns = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
