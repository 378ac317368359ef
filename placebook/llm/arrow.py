"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Rows handled at once; with long texts fewer, so that a step holds about STEP_BYTES.
STEP_ROWS, STEP_BYTES = 1_000, 6_000_000


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    size = max(1, min(STEP_ROWS, int(STEP_BYTES / max(1, batch.nbytes / max(1, rows)))))
    for at in range(0, rows, size):
        yield batch.slice(at, size)


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """Apply ``make()``, called once in each task, to steps of Arrow batches.

    It returns columns as lists or arrays; their names and types are ``schema``'s.
    """
    ship(df.sparkSession)
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, apply = to_arrow_schema(kinds), make()
        for batch in batches:
            for step in steps(batch):
                out = apply(step)
                if len(out[to.names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in to], schema=to)

    return df.mapInArrow(run, kinds)
