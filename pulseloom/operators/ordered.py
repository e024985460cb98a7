"""Order-dependent folds over the rows of a key, with bounded memory whatever the key's length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[tuple]


def _values(column: pa.Array) -> list:
    """Exact Python values: numbers with nulls among them never pass through floats."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if plain and not column.null_count or pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple, dict[str, list]], Rows],
    schema: str,
    finish: Callable[[object, tuple], Rows] | None = None,
) -> DataFrame:
    """Rows meet by ``keys`` and stream in ``order``; ``step(state, key, columns)`` changes the state and returns
    output rows. A key's rows may come in several pieces, so that only a batch of them is ever in memory; a key with a
    third of all rows takes one task's time, as an order-dependent recurrence must, but not its memory. ``finish``
    gets the state after a key's last row. Null keys are a key like any other. One shuffle and one spilling sort."""
    keys = list(keys)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: Rows) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in made]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: Rows = []
            columns = {c: _values(batch.column(i)) for i, c in enumerate(batch.schema.names)}
            at = 0
            for key, same in groupby(zip(*(columns[k] for k in keys))):
                n = sum(1 for _ in same)
                if key != current:
                    if current is not None and finish:
                        out += finish(state, current)
                    current, state = key, start()
                out += step(state, key, {c: v[at : at + n] for c, v in columns.items()})
                at += n
            yield batch_of(out)
        if current is not None and finish:
            yield batch_of(finish(state, current))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
