"""Token ids of a corpus in files of checksummed, range-coded blocks, in ascending order of the documents' ids.

A dataset is a folder: `blocks` holds a row for each block of BLOCK ids (the last of a part may be shorter), whose documents may
go on in the next block. A part is one range of document ids; parts, blocks and documents follow one another in order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexquarry.llm import id_coder
from lexquarry.llm.common import as_bytes, broadcast_small, shared_dir, struct_type
from lexquarry.llm.packing import word_tokens

#: Ids of a block, and blocks that a task codes side by side (8 million ids at most are held).
BLOCK, LANES = 4096, 2048
#: Bytes of texts that are tokenized at once; a longer text is alone.
AT_ONCE = 8 << 20


def block_type(id_type: T.DataType) -> T.StructType:
    piece = struct_type(id=id_type, at=T.LongType(), n=T.IntegerType())
    return struct_type(part=T.IntegerType(), block=T.IntegerType(), n_ids=T.IntegerType(), docs=T.ArrayType(piece), data=T.BinaryType())


class Blocks:
    """Cuts the ids of documents into blocks, each with its pieces: (id, ids of the document before, ids)."""

    def __init__(self):
        self.data, self.pieces, self.held = [], [], 0
        self.cut: list[tuple[np.ndarray, list[tuple]]] = []

    def add(self, which, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, BLOCK - self.held)
            self.data.append(ids[at : at + n])
            self.pieces.append((which, at, n))
            self.held += n
            at += n
            if self.held == BLOCK:
                self.close()

    def close(self) -> None:
        if self.held:
            self.cut.append((np.concatenate(self.data), self.pieces))
        self.data, self.pieces, self.held = [], [], 0

    def taken(self) -> list[tuple[np.ndarray, list[tuple]]]:
        out, self.cut = self.cut[:LANES], self.cut[LANES:]
        return out


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose texts have so many bytes at most, or that are one row."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def encode(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", end_id: int = 1, bits: int = 16) -> DataFrame:
    """The rows of a dataset's blocks. Ranges of ids come from one range shuffle; rows of one id, which may be many, are ordered
    and parted by their text. A task holds the ids of LANES blocks at most, whatever its range and the length of a text."""
    schema = block_type(docs.schema[id].dataType)
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_part"), "_id", "_text")
    pieces = to_arrow_type(schema["docs"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, blocks, part, written = word_tokens(tokenizer_path), Blocks(), None, 0

        def coded() -> pa.RecordBatch:
            nonlocal written
            some = blocks.taken()
            first, written = written, written + len(some)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(some), pa.int32()), pa.array(range(first, written), pa.int32()), pa.array([len(ids) for ids, _ in some], pa.int32()),
                    pa.array([[dict(zip(("id", "at", "n"), p)) for p in own] for _, own in some], pieces), pa.array(id_coder.pack([ids for ids, _ in some], bits), pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for some in by_size(batch, 2, AT_ONCE):
                ids, ends = tokens.encode_all(as_bytes(some.column(2)), end_id)
                begin = 0
                for which, end in zip(some.column(1).to_pylist(), ends.tolist()):
                    blocks.add(which, ids[begin:end])
                    begin = end
                    while len(blocks.cut) >= LANES:
                        yield coded()
        blocks.close()
        while blocks.cut:
            yield coded()

    return ranged.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Writes a dataset: each document's ids by the tokenizer and one end id. Null texts are empty (the end id alone), null ids
    come first, repeated rows are written each; other columns are not kept. An empty table gives a dataset without blocks.
    Blocks are compressed already, so their files are not."""
    encode(docs, tokenizer_path, **options).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def decode(found: DataFrame, bits: int = 16, ids: bool = False) -> DataFrame:
    """(part, begin, id, at, n, crc32[, ids]): a row for each piece of a document, read back from its block. begin numbers the
    document's first id within the part. A damaged block is an error, which names it."""
    id_type = found.schema["docs"].dataType.elementType["id"].dataType
    schema = struct_type(part=T.IntegerType(), begin=T.LongType(), id=id_type, at=T.LongType(), n=T.LongType(), crc32=T.LongType(), **{"ids": T.BinaryType()} if ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            parts, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            try:
                bodies = id_coder.unpack(batch.column(4).to_pylist(), bits)
            except ValueError as damage:
                raise ValueError(f"{damage}: one of part {parts[0]}, block {numbers[0]} to part {parts[-1]}, block {numbers[-1]}") from damage
            docs = batch.column(3)
            flat = docs.flatten()
            lengths = docs.value_lengths().to_pylist()
            own, at, n = (flat.field(k) for k in range(3))
            sums, begins, of, raw = [], [], [], []
            k, ats, sizes = 0, at.to_pylist(), n.to_pylist()
            for row, count in enumerate(lengths):
                data, here = memoryview(bodies[row].astype("<u4").tobytes()), 0
                for k in range(k, k + count):
                    piece = data[4 * here : 4 * (here + sizes[k])]
                    sums.append(zlib.crc32(piece))
                    begins.append(numbers[row] * BLOCK + here - ats[k])
                    of.append(parts[row])
                    if ids:
                        raw.append(bytes(piece))
                    here += sizes[k]
                k += 1
            columns = [pa.array(of, pa.int32()), pa.array(begins, pa.int64()), own, at, n.cast(pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if ids else []), names=schema.names)

    return found.select("part", "block", "n_ids", "docs", "data").mapInArrow(run, schema)


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, LANES at a time."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, LANES - rows)
            batch = batch.slice(some.num_rows)
            waiting.append(some)
            rows += some.num_rows
            if rows == LANES:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


#: The polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320


def times(a, b):
    """The products of polynomials modulo POLYNOMIAL; bit 31 is the constant."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    out = a & -(b >> 31 & 1)
    for k in range(30, -1, -1):
        a = a >> 1 ^ POLYNOMIAL * (a & 1)
        out = out ^ a & -(b >> k & 1)
    return out


def joined_crc(first, second, length):
    """The CRC-32 of pairs of strings, one after the other, from theirs and the second's lengths in bytes."""
    length, power = np.asarray(length, np.int64), 1 << 23  # x ** 8
    out = np.asarray(first, np.int64)
    while length.any():
        out = np.where(length & 1, times(out, power), out)
        power, length = times(power, power), length >> 1
    return out ^ second


@F.arrow_udf(T.LongType())
def crc_of(pieces: pa.Array) -> pa.Array:
    """The CRC-32 of a document from its pieces (at, n, crc32) in order."""
    flat, ends = pieces.flatten(), np.cumsum(pieces.value_lengths())
    sums, sizes = flat.field("crc32").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
    begins = ends - pieces.value_lengths().to_numpy(zero_copy_only=False)
    out, k = sums.take(begins), begins + 1
    rows = np.flatnonzero(k < ends)
    while len(rows):  # the next piece of each document that has one
        more = k[rows]
        out[rows] = joined_crc(out[rows], sums[more], 4 * sizes[more])
        k[rows] += 1
        rows = rows[k[rows] < ends[rows]]
    return pa.array(out, pa.int64())


def documents(found: DataFrame, bits: int = 16) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): each document of a dataset's blocks, read back from them.

    start is the number of ids before it. The pieces of a document (one for each block it lies in) meet by its place, as
    their lengths and checksums only.
    """
    pieces = decode(found, bits).groupBy("part", "begin").agg(F.first("id").alias("id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc32"))).alias("pieces"))
    sizes = found.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each range of ids
    before = sizes.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    placed = pieces.join(broadcast_small(before), F.col("part") == F.col("_part"))
    return placed.select("id", (F.col("_before") + F.col("begin")).alias("start"), "n_tokens", crc_of("pieces").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents() of docs, written to a new dataset in the shared folder and read back."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, id=id, text=text)
    return documents(blocks(docs.sparkSession, path)).withColumnRenamed("id", id)
