"""Small helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def emit_rows(
    df: DataFrame, keys: list[str], inputs: list[str], outputs: list[tuple[str, T.DataType]], fn: Callable[..., list[tuple]]
) -> DataFrame:
    """Each row to any number of rows: the key columns, then one tuple of outputs per row that fn(*inputs) returns.

    Only the named columns travel to Python. Keys keep their types; fn gets None for nulls.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in outputs])
    arrow = to_arrow_schema(schema)
    width = len(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(len(keys) + i).to_pylist() for i in range(len(inputs))]
            take: list[int] = []
            made: list[list] = [[] for _ in range(width)]
            for row, args in enumerate(zip(*values)):
                for out in fn(*args):
                    take.append(row)
                    for slot, value in zip(made, out):
                        slot.append(value)
            index = pa.array(take, pa.int64())
            columns = [batch.column(i).take(index).cast(arrow.field(i).type) for i in range(len(keys))]
            columns += [pa.array(made[i], arrow.field(len(keys) + i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    narrow = df.select(*[df[k] for k in keys], *[df[c].alias(f"__in{i}") for i, c in enumerate(inputs)])
    return narrow.mapInArrow(run, schema)
