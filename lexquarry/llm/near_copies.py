"""Near copies by the Jaccard similarity of word shingles: candidates have SimHash fingerprints a few bits apart, or, further apart,
share a band of minhashes; each is verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import add_columns, as_bytes, broadcast_small, cut, struct_type
from lexquarry.llm.components import components
from lexquarry.llm.simhash import LOWER, simhash
from lexquarry.llm.simhash import links as close_prints

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending. Words are op9's: A-Z lower-cased, split at the six ASCII blanks; a
    text shorter than the shingle is one shingle, and one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : len(words) - k + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Bands:
    """Band keys of a set: each hashes `rows` minhashes, so two sets of Jaccard similarity s share one of the `bands` keys with
    probability 1 - (1 - s ** rows) ** bands."""

    def __init__(self, bands: int, rows: int, step: int = 2048):
        draw = np.random.default_rng(9)
        self.shape, self.step = (bands, rows), step
        self.flip = draw.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
        self.times = draw.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) | np.uint64(1)
        self.number = np.arange(1, bands + 1, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flip), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), self.step):
            np.minimum(least, ((hashes[at : at + self.step] ^ self.flip) * self.times).min(axis=1), out=least)
        key, least = self.number * MIX, least.reshape(self.shape)
        for i in range(self.shape[1]):
            key = (key ^ least[:, i]) * MIX
            key ^= key >> np.uint64(31)
        return key


def banded(df: DataFrame, text: str, shingle: int, bands: int, rows: int, carry: list[str]) -> DataFrame:
    """carry, then node (a hash of the set of shingles), n (its size), simhash (op9's fingerprint, of these shingles) and bands (its
    keys). No shuffle."""
    at = df.columns.index(text)

    def start():
        from xxhash import xxh64_intdigest

        keys = Bands(bands, rows)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            bodies = as_bytes(batch.column(at))
            sets = [shingles(b, shingle) for b in bodies]
            prints = np.array([simhash(b, shingle) for b in bodies], np.uint64).view(np.int64)
            node = np.array([xxh64_intdigest(s.tobytes(), 5) for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate([keys.of(s) for s in sets]).view(np.int64)
            return [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(flat))]

        return work

    return add_columns(df, struct_type(node=T.LongType(), n=T.LongType(), simhash=T.LongType(), bands=T.ArrayType(T.LongType())), start, carry)


def _like(threshold: float) -> Column:
    """Whether the sizes n and m allow the similarity."""
    return F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9


def _pairs(left: DataFrame, right: DataFrame, allowed: Column) -> DataFrame:
    """(a, b), a < b, of the nodes of left and right that share a key."""
    met = left.join(right, "key").where(allowed)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _by_prints(heads: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates by op9's rule. Nodes of one fingerprint meet its least node; the least nodes of fingerprints that
    differ in two bits or fewer, or of such a chain, meet along its links. At most a few rows for each node, whatever the groups."""
    prints = heads.select("node", "simhash")
    first = cut(prints.groupBy("simhash").agg(F.min("node").alias("first")))
    same = prints.join(first, "simhash").where("node != first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    named = [first.select(F.col("simhash").alias(k), F.col("first").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    near = close_prints(first.select("simhash")).join(named[0], "a").join(named[1], "b").select("x", "y")
    return same.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sets(asked: DataFrame, heads: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, members): the sets of the nodes asked for, made anew from one text of each."""
    wanted = cut(heads.join(asked, "node", "left_semi").select("node", F.col("least.id").alias("_first_id"), F.col("least.text").alias("_first_text")))
    found = texts.join(broadcast_small(wanted), (F.col("_text_hash") == F.col("_first_text")) & F.col("_id").eqNullSafe(F.col("_first_id"))).select("node", "_text")

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([shingles(b, shingle).view(np.int64) for b in as_bytes(batch.column(1))], pa.list_(pa.int64()))]

        return work

    return cut(add_columns(found, struct_type(members=T.ArrayType(T.LongType())), start, ["node"]).dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets of shingles are as similar as the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return cut(both.where(common * (1 + threshold) >= threshold * (F.size("s") + F.size("t")) - 1e-9).select("a", "b"))


def _hubs(many: DataFrame, most: int = 1000) -> DataFrame:
    """(hub, node, held, salts, salt): the nodes of each large bucket (key, node, size) in one group, named by a node that many
    others meet in large buckets. Two nodes that share a bucket share a group. A group of many nodes is dealt over several salts."""
    placed = many.join(many.groupBy("node").agg(F.sum("size").alias("met")), "node")
    first = placed.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("first"))
    named = placed.select("key", "node").join(first, "key")
    # the buckets of one group may have several such nodes; each takes the name that most of its nodes meet most often
    often = named.groupBy("node", "first").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("first", F.struct("c", "first")).alias("first"))
    votes = placed.select("key", "node").join(often, "node").groupBy("key", "first").agg(F.count("*").alias("c"))
    hubs = votes.groupBy("key").agg(F.max_by("first", F.struct("c", "first")).alias("hub"))
    held = cut(placed.join(hubs, "key").select("hub", "node").distinct())
    sizes = held.groupBy("hub").agg(F.count("*").alias("held")).withColumn("salts", F.ceil(F.col("held") / most))
    return held.join(sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))


def _cores(held: DataFrame, sets: DataFrame, some: int = 32) -> DataFrame:
    """(hub, salts, t): the shingles that over half of some nodes of a group have, in edited copies those of the text they were
    made from. Any set t gives right results, as it only serves bounds, so about `some` nodes of a group are enough."""
    every = F.ceil(F.col("held") / some)
    asked = held.where((F.pmod(F.xxhash64("node", F.lit(3)), every) == 0) | (F.col("node") == F.col("hub"))).select("hub", "salts", "node")
    sizes = asked.groupBy("hub", "salts").agg(F.count("*").alias("of"))
    common = asked.join(sets, "node").select("hub", F.explode("members").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("c"))
    kept = common.join(sizes, "hub").where("2 * c > of").groupBy("hub").agg(F.collect_list("e").alias("t"))
    return cut(sizes.drop("of").join(kept, "hub", "left").withColumn("t", F.coalesce("t", F.array().cast("array<bigint>"))))


def _against_cores(held: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(hub, node, n, d, u, diff): a node's size, the members that only it or only its group's core has, their number d, and
    u = d - (1 - threshold) / (1 + threshold) * n. Sets A and B are similar enough if they differ in at most
    (1 - threshold) / (1 + threshold) * (n of A + n of B) members, so their diffs must share (u of A + u of B) / 2 at least."""
    cores = _cores(held, sets).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    both = held.select("hub", "salt", "node").join(sets.withColumnRenamed("members", "s"), "node").join(cores, ["hub", "salt"])
    near = both.select("hub", "node", F.size("s").alias("n"), F.concat(F.array_except("s", "t"), F.array_except("t", "s")).alias("diff"))
    return cut(near.withColumn("d", F.size("diff")).withColumn("u", F.col("d") - (1 - threshold) / (1 + threshold) * F.col("n")))


def _least_shared(u: Column, v: Column) -> Column:
    """How many members the diffs of two similar sets share at least, if it is one or more."""
    return F.greatest(F.ceil((u + v) / 2 - 1e-6), F.lit(1))


def _beside_cores(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of a stray and another node of its group, in different components, that can be as similar as the threshold.

    placed has (hub, node, n, d, u, diff, root, stray, least_u, least_stray_u). A stray A is not similar to the centre C, which
    has the least u, so u of A + u of C > 0, and with any other node the sum is as large: its diff shares a member with that of
    each similar node. Prefix filter: with all diffs in one order, the rarest members of the group first, two that share k
    members share one among the first d - k + 1 of each. Members that edits made are rare and come first, so those that are
    missing in many copies are seldom listed, and members that one node alone has need no listing.
    """
    members = placed.select("hub", "node", F.explode("diff").alias("e"))
    repeated = members.groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1")
    ranked = members.join(repeated, ["hub", "e"], "left").groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "e"))).alias("ranked"))
    rows = placed.drop("diff").join(ranked, ["hub", "node"])
    partner = F.when(F.col("stray"), F.col("least_u")).otherwise(F.col("least_stray_u"))
    upto = F.greatest(F.col("d") - _least_shared(F.col("u"), partner) + 1, F.lit(0)).cast("int")
    listed = cut(rows.select("hub", "node", "n", "d", "u", "root", "stray", F.posexplode(F.slice("ranked", 1, upto)).alias("p", "m")).where("m.c > 1").withColumn("e", F.col("m.e")).drop("m"))
    mine = listed.where("stray").select("hub", "e", F.col("node").alias("x"), "n", "d", "u", "p", F.col("root").alias("r"))
    other = listed.select("hub", "e", F.col("node").alias("y"), F.col("n").alias("m"), F.col("d").alias("f"), F.col("u").alias("v"), F.col("p").alias("q"), "root", "stray")
    shared = _least_shared(F.col("u"), F.col("v"))
    able = (F.col("r") != F.col("root")) & (~F.col("stray") | (F.col("x") < F.col("y"))) & _like(threshold) & (F.col("p") <= F.col("d") - shared) & (F.col("q") <= F.col("f") - shared)
    return mine.join(other, ["hub", "e"]).where(able).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(heads: DataFrame, texts: DataFrame, shingle: int, threshold: float, small: int) -> DataFrame:
    """(node, root) of the components of all candidate pairs that are as similar as the threshold.

    Candidates are nodes that op9's rule links by their fingerprints (_by_prints), and, for those further apart, nodes that
    share a band key. A bucket of up to `small` nodes is paired. The nodes of larger ones (thousands of
    near copies) form groups with a core; they are first compared with the node nearest to the core, then every node outside
    that one's component is compared with those nodes of other components that have enough of their differences from the core
    in common. Two nodes of a bucket are then compared, too unlike by these differences, or known to be in one component, so
    the components are those of all pairs, while near copies of one text give a few rows each.
    """
    keyed = heads.select("node", "n", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(keyed.join(sizes, "key"))
    few, many = shared.where(F.col("size") <= small), shared.where(F.col("size") > small)
    y = [F.col("node").alias("y"), F.col("n").alias("m")]
    banded = _pairs(few.select("key", F.col("node").alias("x"), "n"), few.select("key", *y), (F.col("x") < F.col("y")) & _like(threshold))
    pairs = cut(_by_prints(heads).union(banded).distinct())
    held = cut(_hubs(many))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(held.select("node")).distinct()
    sets = _sets(asked, heads, texts, shingle)
    links = _verified(pairs, sets, threshold)
    if held.isEmpty():
        return components(links)

    near = _against_cores(held, sets, threshold)
    centres = cut(near.groupBy("hub").agg(F.min(F.struct("u", "node")).alias("c")).select("hub", F.col("c.node").alias("centre"), F.col("c.u").alias("least_u")))
    stars = near.select("hub", "node").join(centres, "hub").where("node != centre")
    stars = cut(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = links.union(_verified(stars, sets, threshold)).distinct()
    found = components(links)
    rooted = cut(near.select("hub", "node", "u").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = centres.join(rooted.select("hub", F.col("node").alias("centre"), F.col("root").alias("main")), ["hub", "centre"])
    told = cut(rooted.join(main, "hub").select("hub", "node", "root", "least_u", "u", (F.col("root") != F.col("main")).alias("stray")))
    strays = told.where("stray").groupBy("hub").agg(F.min("u").alias("least_stray_u"))
    placed = cut(near.join(told.drop("u").join(strays, "hub"), ["hub", "node"]))
    if placed.isEmpty():
        return found
    more = cut(_beside_cores(placed, threshold))
    if more.isEmpty():
        return found
    # the stars found join the same nodes as the links they came from, and settle in fewer rounds
    known = found.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(known.union(_verified(more, sets, threshold)).distinct())


def keep_first(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 4, small: int = 8) -> DataFrame:
    """One row of df for each group of near copies: that of the least id (null ids last), of rows that share it the one
    whose text has the least hash, and one of equal rows. The columns are df's.

    Texts are linked whose sets of shingles have at least the Jaccard similarity `threshold`; groups are the connected
    components. Equal sets are one node, so copies are never paired, whatever their number; texts without words are equal.
    Candidates come from SimHash fingerprints of the same shingles at op9's two bits, and from bands for those further apart.
    With 32 bands of 4 minhashes a pair at 0.8 is missed with probability 5e-8, a nearer one less often; no pair below the
    threshold is linked. An empty table gives an empty one.
    """
    texts = df.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash"), F.col(text).alias("_text"))
    prints = cut(banded(texts, "_text", shingle, bands, rows, ["_id", "_text_hash"]))
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text_hash").alias("text"))
    heads = cut(prints.groupBy("node").agg(F.min(own).alias("least"), F.first("n").alias("n"), F.min("simhash").alias("simhash"), F.first("bands").alias("bands")))
    rooted = heads.select("node", "least").join(linked(heads, texts, shingle, threshold, small), "node", "left")
    first = cut(rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.id").alias("_first_id"), F.col("least.text").alias("_first_text")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash"))
    same = (F.col("_text_hash") == F.col("_first_text")) & F.col("_id").eqNullSafe(F.col("_first_id"))
    # most texts stay where they lie if few go
    others = cut(prints.select("_id", "_text_hash").distinct().join(first, same, "left_anti").select(F.col("_id").alias("_first_id"), F.col("_text_hash").alias("_first_text")))
    going = broadcast_small(others)
    kept = rows.join(first, same, "left_semi") if going is others else rows.join(going, same, "left_anti")
    # texts are shuffled again only if some rows are repeated
    if not prints.groupBy("_id", "_text_hash").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        kept = kept.dropDuplicates(["_text_hash", "_id"])
    return kept.select("_row.*")
