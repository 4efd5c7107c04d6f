"""Folds over the ordered rows of each key, for decisions that depend on earlier decisions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexquarry.operators.machines import Machine


def ordered_fold(df: DataFrame, key: str, order: list[str], added: T.StructType, start: Callable[[], Callable[[dict], tuple]]) -> DataFrame:
    """df's rows with the fields of added. start() gives a function for each key, which is called with its rows in order and
    returns the new fields.

    Rows are shuffled by key and sorted, and one Arrow batch is held at a time, so a key may have any number of rows; its
    fold is one task's work, as each row needs the one before. Null keys are one key.
    """
    schema = T.StructType([*df.schema, *added])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, step = object(), None
        for batch in batches:
            new = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, step = row[key], start()
                new.append(step(row))
            columns = [pa.array([n[i] for n in new], arrow.field(len(batch.schema) + i).type) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def admission(max_items: int, max_chars: int, chars: str):
    """Accepts a row while its key has room; a rejected row takes none."""

    def start():
        count = total = 0

        def step(row: dict) -> tuple:
            nonlocal count, total
            if count >= max_items:
                return (False, "too_many_documents")
            if total + (row[chars] or 0) > max_chars:
                return (False, "library_full")
            count, total = count + 1, total + (row[chars] or 0)
            return (True, None)

        return step

    return start


def each(kind: type[Machine], none: tuple):
    """A machine that gives at most one row for each row taken."""

    def start():
        machine = kind()
        return lambda row: (machine.take(row) or [none])[0]

    return start
