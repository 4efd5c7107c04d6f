"""Order MinHash: signatures of texts from the least occurrence-numbered k-mers, kept in the order of the text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import as_texts, struct_type

MIX, TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class OrderMinHash:
    """`count` tuples of the two least k-mers, by as many random orders.

    An element is a k-mer of code points with the number of its occurrences before it, so repeats count; a tuple holds its
    k-mers as the text has them, so moving a passage changes it though the set of k-mers is the same. A text shorter than k
    is one k-mer. Equal texts have equal fingerprints; those of empty texts are equal too.
    """

    k: int = 6
    count: int = 64
    seed: int = 1
    block: int = 4096

    def elements(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each k-mer, in order, and that of the element it makes with its occurrence number."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        k = min(self.k, len(codes))
        if not k:
            return codes, codes
        n = len(codes) - k + 1
        kmers = codes[:n] + np.uint64(k)
        for j in range(1, k):
            kmers = kmers * MIX + codes[j : j + n]
        kmers = mix(kmers)
        low = np.uint64((1 << n.bit_length()) - 1)
        ordered = np.sort((kmers & ~low) | np.arange(n, dtype=np.uint64))
        at, same = (ordered & low).astype(np.int64), ordered & ~low
        index = np.arange(n)
        first = np.maximum.accumulate(np.where(np.append(True, same[1:] != same[:-1]), index, 0))
        times = np.empty(n, np.uint64)
        times[at] = (index - first).astype(np.uint64)
        return kmers, mix(kmers + times * MIX)

    def orders(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        return draw.integers(1, 2**63, self.count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, self.count, dtype=np.uint64)

    def least(self, elements: np.ndarray, begin: int, orders: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each order, the two least values of the elements and their places, counted from begin; absent ones are TOP and -1."""
        values, places = np.full((self.count, 2), TOP), np.full((self.count, 2), -1)
        rows = np.arange(self.count)
        for at in range(0, len(elements), self.block):
            some = elements[None, at : at + self.block] * orders[0][:, None] + orders[1][:, None]
            found, where = [], []
            for _ in range(min(2, some.shape[1])):
                i = some.argmin(axis=1)
                found.append(some[rows, i])
                where.append(i + at + begin)
                some[rows, i] = TOP
            values, places = self.merged((values, places), (np.stack(found, 1), np.stack(where, 1)))
        return values, places

    @staticmethod
    def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, places = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
        order = np.argsort(values, axis=1, kind="stable")[:, :2]
        return np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)

    def tuples(self, places: np.ndarray, kmers: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each tuple of k-mers, in the order of their places."""
        if not len(kmers):
            return np.zeros(self.count, np.uint32)
        places = np.sort(places, axis=1)
        first, second = np.where(places[:, 0] < 0, np.uint64(0), kmers[places[:, 0]]), kmers[places[:, 1]]
        return (mix(first * MIX + second + np.arange(self.count, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, text: str) -> np.ndarray:
        kmers, elements = self.elements(text)
        return self.tuples(self.least(elements, 0, self.orders())[1], kmers)

    def pair(self, text: str, edited: str, shared: int, orders) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of two texts with the same first `shared` code points, whose elements are looked at once."""
        kmers, elements = self.elements(text)
        kmers_2, elements_2 = self.elements(edited)
        same = max(0, shared - self.k + 1) if min(len(text), len(edited)) >= self.k else 0
        head = self.least(elements[:same], 0, orders)
        one = self.merged(head, self.least(elements[same:], same, orders))
        two = self.merged(head, self.least(elements_2[same:], same, orders))
        return self.tuples(one[1], kmers), self.tuples(two[1], kmers_2)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples: 1 for equal texts, near 0 for unrelated ones, falling with the edit distance."""
    return float((a == b).mean())


def neighbours(df: DataFrame, id: str, text: str) -> DataFrame:
    """(_part, _halo, _id, _text): the rows in descending order of id within each of several ranges of ids, each range
    followed by a copy of the rows that begin the next (_halo 1), the last by a copy of the first rows of all.

    The bounds of the ranges are ids that occur, found from the id column alone, so texts are shuffled once. Null ids come
    last; rows of one id are ordered by text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 10_000).alias("bounds"), F.max("_id").alias("most")).first()
    bounds = sorted(set(found["bounds"] or []))
    listed = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("_id").isNull(), len(bounds)).otherwise(F.size(F.filter(listed, lambda b: b >= F.col("_id"))))
    place = lambda p, halo: F.struct(p.cast("int").alias("part"), F.lit(halo).alias("halo"))
    none = F.array().cast("array<struct<part:int,halo:int>>")
    places = F.concat(
        F.array(place(part, 0)),
        F.when(F.array_contains(listed, F.col("_id")), F.array(place(part - 1, 1))).otherwise(none),
        F.when(F.col("_id") == F.lit(found["most"]), F.array(place(F.lit(len(bounds)), 1))).otherwise(none),
    )
    dealt = rows.select("_id", "_text", F.explode(places).alias("p")).select(F.col("p.part").alias("_part"), F.col("p.halo").alias("_halo"), "_id", "_text")
    return dealt.repartition("_part").sortWithinPartitions("_part", "_halo", F.col("_id").desc_nulls_last(), "_text")


def with_next(batches):
    """(id, text, next text) for each row of neighbours() that is not a copy, one after another."""
    part = held = first = None
    copied = False
    for batch in batches:
        parts, halos, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_texts(batch.column(3))
        for i, body in enumerate(texts):
            if parts[i] != part:
                if held is not None:  # all ids are null: after the last comes the first of this range
                    yield *held, first
                part, held, first, copied = parts[i], None, body, False
            if copied:
                continue
            if held is not None:
                yield *held, body
            copied = halos[i] == 1
            held = None if copied else (batch.column(2).slice(i, 1), body)
    if held is not None:
        yield *held, first


def compare_with_next(df: DataFrame, id: str = "doc_id", text: str = "text", method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many code points from the
    start of the next document's (all, if it has fewer), in descending order of id; after the last comes the first. Null
    texts are empty. Null ids come last, rows of one id are ordered by text, a single row is its own next. Fingerprints are
    hexadecimal. Other columns are dropped; an empty table gives an empty table. Memory is two texts and one Arrow batch.
    """
    out = T.StructType([T.StructField(id, df.schema[id].dataType)] + list(struct_type(n_chars=T.LongType(), edited_sha256=T.StringType(), fingerprint=T.StringType(), edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType())))

    def run(batches):
        orders, done, held = method.orders(), [], None

        def release(own: np.ndarray | None, body: str | None) -> None:
            """Completes the row held back, whose next text is mostly the one just fingerprinted."""
            if held is not None:
                *row, own_before, after = held
                done.append((*row, likeness(own_before, own if after is body else method.fingerprint(after))))

        def batch() -> pa.RecordBatch:
            ids, *rest = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, rest)], names=out.names)

        for which, body, after in with_next(batches):
            cut = len(body) - len(body) // 2
            edited = body[:cut] + after[: len(body) // 2]
            own, changed = method.pair(body, edited, cut, orders)
            release(own, body)
            hexed = [x.astype(">u4").tobytes().hex() for x in (own, changed)]
            held = (which, len(body), hashlib.sha256(edited.encode()).hexdigest(), *hexed, likeness(own, changed), own, after)
            if len(done) >= 1000:
                yield batch()
        release(None, None)
        if done:
            yield batch()

    return neighbours(df, id, text).mapInArrow(run, out)
