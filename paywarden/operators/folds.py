"""Ordered folds: keyed state carried along rows in order.

Rows are hashed by key and sorted within partitions, then stream through Arrow batches; a task holds one batch and one
key's state, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, outputs: str, dealt: bool = False) -> DataFrame:
    """df with columns of `outputs` (DDL) from step(state, *inputs) -> tuple, over the rows of each key in order.

    dealt: the caller has repartitioned df by the key, and nothing since has moved rows to other partitions.
    """
    names = [x.split()[0] for x in outputs.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in outputs.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = object(), None
        for b in batches:
            out = []
            for k, *args in zip(*(b.column(c).to_pylist() for c in [key, *inputs])):
                if held is None and k is not None or held is not None and k != held:
                    held, state = k, start()
                out.append(step(state, *args))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(list(c), t) for c, t in zip(cols, types)]], [*b.schema.names, *names])

    return (df if dealt else df.repartition(F.col(key))).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, {outputs}")
