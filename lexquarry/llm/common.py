"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.operators.kept import cut, shared_dir, stored  # noqa: F401, also for the operators

#: The ASCII blanks that end a word; every other code point belongs to one.
BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, which must be cut() and narrow, to be broadcast if it has at most so many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds, F.lit(0))


def as_texts(texts: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return pc.fill_null(texts, "").to_pylist()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def sliced(batches, rows: int = 500):
    """The batches in parts of at most so many rows, so that what is made of them in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns a process's free memory to the system: a worker's, which stays for other tasks, or the driver's after training."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def replaced(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column set last, in the place of any of that name in whatever case."""
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()]).withColumn(name, value)


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def add_columns(df: DataFrame, fields: T.StructType, start, carry: list[str] | None = None, most: int = 1000) -> DataFrame:
    """df's columns (only those in carry, if given), then fields, which take the place of columns of the same name.

    start() is called once in each task and returns a function from an Arrow batch of df, of `most` rows at most, to the arrays
    of fields.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    at = [df.columns.index(c) for c in kept]
    names = [f.name for f in schema]

    def run(batches):
        work = start()
        for batch in sliced(batches, most):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + work(batch), names=names)
        del work
        give_back()

    return df.mapInArrow(run, schema)
