"""SimHash near-duplicates: fingerprints that differ in a few bits, found by joining on blocks of them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import add_columns, as_bytes, cut, struct_type
from lexquarry.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: bytes, shingle: int = 3) -> int:
    """64 bits, each set where over half the hashes of the word shingles have it; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(begins, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        bits = np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += np.einsum("ij->j", bits, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Adds simhash (long, the 64 bits as a signed number). Words: lower-cased A-Z, split at the six ASCII blanks; a text
    shorter than the shingle is one shingle, and a null, empty or blank one has simhash 0. No shuffle."""
    at = df.columns.index(text)

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(np.array([simhash(b, shingle) for b in as_bytes(batch.column(at))], dtype=np.uint64).view(np.int64))]

        return work

    return add_columns(df, struct_type(simhash=T.LongType()), start, carry)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


#: Fingerprints that differ in so many bits or fewer are linked; large buckets are exact for this number only.
BITS = 2


def links(prints: DataFrame, blocks: int = 4, small: int = 32) -> DataFrame:
    """(a, b), a < b: links between distinct 64-bit fingerprints (column simhash, without repeats) that have the same
    connected components as all pairs differing in at most two bits (BITS); every link holds such a pair.

    Pigeonhole: of `blocks` equal blocks of bits at least blocks - 2 are equal in a close pair, so each choice of that
    many blocks is a key, and close pairs share one. A bucket of up to `small` fingerprints is joined with itself and the
    distances are verified. A larger one (thousands of near copies) is not paired: with two differing bits there is a value
    one bit from both, so each member is listed under itself and its one-bit variants outside the key; the members listed
    under a value differ from it in one bit each, are at most one for each bit and one more, and link to their least.
    """
    width = 64 // blocks
    choices = list(combinations(range(blocks), blocks - BITS))
    masks = [sum(((1 << width) - 1) << (width * b) for b in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("simhash", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("simhash").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(signed)])).alias("key")).select("simhash", "key.choice", "key.block")
    sizes = keyed.groupBy("choice", "block").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(keyed.join(sizes, ["choice", "block"]))
    few = shared.where(F.col("size") <= small)
    pairs = (
        few.select("choice", "block", F.col("simhash").alias("a"))
        .join(few.select("choice", "block", F.col("simhash").alias("b")), ["choice", "block"])
        .where((F.col("a") < F.col("b")) & (_distance("a", "b") <= BITS))
        .select("a", "b")
    )
    mask = reduce(lambda out, x: out.when(F.col("choice") == x[0], F.lit(x[1])), enumerate(signed[1:], 1), F.when(F.col("choice") == 0, F.lit(signed[0])))
    flips = F.array(F.lit(0), *[F.lit(v - (1 << 64) if v >> 63 else v) for v in (1 << k for k in range(64))])
    stars = (
        shared.where(F.col("size") > small)
        .withColumn("mask", mask)
        .select("choice", "simhash", F.explode(F.filter(flips, lambda v: v.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
        .groupBy("choice", F.col("simhash").bitwiseXOR(F.col("flip")).alias("value"))
        .agg(F.min("simhash").alias("a"), F.collect_list("simhash").alias("members"))
        .where(F.size("members") > 1)
        .select("a", F.explode("members").alias("b"))
        .where("a < b")
    )
    return pairs.union(stars).distinct()


def _grouped(df: DataFrame, id: str, text: str, shingle: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _text_hash, simhash) for each row of df, and (simhash, root) for each distinct simhash."""
    rows = df.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash"), F.col(text).alias("_text"))
    prints = cut(fingerprints(rows, "_text", shingle, carry=["_id", "_text_hash"]))
    nodes = prints.select("simhash").distinct()
    found = components(links(cut(nodes), blocks)).withColumnRenamed("node", "simhash")
    return prints, found


def _rooted(prints: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each distinct simhash: simhash, root, and the least (id, text hash) of its rows, null ids last."""
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text_hash").alias("text"))
    nodes = prints.groupBy("simhash").agg(F.min(own).alias("least"))
    return nodes.join(found, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, blocks: int = 4) -> DataFrame:
    """(id, simhash, component_id): one row for each row of df; component_id is the least id that links reach.

    Equal fingerprints are one node, so copies are never paired, whatever their number. Documents without words share
    fingerprint 0 and link like any other. Null ids are rows like any other and never the least id of a component that
    has another. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    prints, found = _grouped(df, id, text, shingle, blocks)
    rooted = _rooted(prints, found)
    least = rooted.groupBy("root").agg(F.min("least.id").alias("component_id"))
    named = rooted.join(least, "root").select("simhash", "component_id")
    return prints.join(named, "simhash").select(F.col("_id").alias(id), "simhash", "component_id")
