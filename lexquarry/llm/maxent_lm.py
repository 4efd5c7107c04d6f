"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside add-one unigrams.

A token's leaf is a number of twelve bits: a class by its ending, then a hash of the whole. Three factors of four bits name
it, each a softmax over 16 outcomes: P(token | history) = P(class | history) * P(subclass | class, history) *
P(leaf | subclass, history) * P(token | leaf). The logits of a factor are sums of weights of hashed features: the leaf before
(with the bits already named, an n-gram of two), the two leaves before together (of three), and, skipping one, the leaf before
that. Within a leaf, tokens follow their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import as_bytes, fold, stored, struct_type
from lexquarry.llm.simhash import LOWER

#: The token after the last word; no word holds a blank.
END = b" "
WIDE, FACTORS, LEAVES = 16, 3, 4096
START = LEAVES
#: The features of each factor and the bits of their hashes: every feature has its own rows of the weights.
FAMILIES = [[("one", 12), ("two", 12), ("pair", 15)], [("one", 15), ("two", 15), ("pair", 15)], [("one", 15), ("two", 15)]]
BEGINS = np.cumsum([0] + [1 << bits for factor in FAMILIES for _, bits in factor])
ROWS = int(BEGINS[-1])
#: Slices in which the weights of all tasks meet.
SLICES = 64
ONES = np.ones(WIDE, np.float32)


def leaf(token: bytes) -> int:
    return crc32(token[-3:]) % 64 * 64 + crc32(token) % 64


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split() + [END]


@dataclass
class Model:
    """What scoring needs besides the counts of a block's own tokens; its size does not depend on the corpus."""

    tokens: int
    sizes: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, WIDE), np.float32))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(ROWS, np.float32))

    def bias(self) -> list[np.ndarray]:
        """The logarithm of each outcome's share of the tokens, given the bits before it: a row for each such prefix."""
        n = self.sizes.reshape(WIDE, WIDE, WIDE) + 0.5
        shares = n.sum((1, 2))[None] / n.sum(), n.sum(2) / n.sum((1, 2))[:, None], (n / n.sum(2, keepdims=True)).reshape(-1, WIDE)
        return [np.log(x).astype(np.float32) for x in shares]


def hashed(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    x = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE3D)
    return (x >> np.uint32(32 - bits)).astype(np.uint16)


def features(codes: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each factor: the outcome of each token, the prefix of bits it follows, and its rows in each family.

    codes are the leaves of the tokens of texts in a row, which begin at begins; before a text comes START."""
    codes = codes.astype(np.uint32)
    places = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))

    def before(k: int) -> np.ndarray:
        out = np.full(len(codes), START, np.uint32)
        out[k:] = np.where(places[k:] >= k, codes[:-k], START)
        return out

    known = {"one": before(1), "two": before(2)}
    known["pair"] = known["one"] * np.uint32(LEAVES + 1) + known["two"]
    out = []
    for i, families in enumerate(FAMILIES):
        prefix = codes >> np.uint32(4 * (FACTORS - i))
        outcome = (codes >> np.uint32(4 * (FACTORS - 1 - i))) & np.uint32(15)
        out.append((outcome.astype(np.intp), prefix.astype(np.intp), [hashed(known[name], prefix, bits) for name, bits in families]))
    return out


def logits(weights: np.ndarray, bias: list[np.ndarray], i: int, prefix: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Of the outcomes of factor i. Weights are clipped, so no exponential of a sum of them overflows."""
    out = np.take(bias[i], prefix, axis=0)
    first = sum(map(len, FAMILIES[:i]))
    for k, r in enumerate(rows, first):
        out += np.take(weights[BEGINS[k] : BEGINS[k + 1]], r, axis=0)
    return out


def gradient(weights: np.ndarray, bias: list[np.ndarray], i: int, outcome: np.ndarray, prefix: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family of factor i: the rows that occur, how often, and the gradient of the tokens' log-likelihood there."""
    chances = logits(weights, bias, i, prefix, rows)
    np.exp(chances, out=chances)
    chances *= (-1 / (chances @ ONES))[:, None]
    chances[np.arange(len(outcome)), outcome] += 1
    for k, r in enumerate(rows, sum(map(len, FAMILIES[:i]))):
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        sums = np.add.reduceat(np.take(chances, order, axis=0), first, axis=0)
        yield ordered[first].astype(np.intp) + BEGINS[k], np.diff(np.append(first, len(r))), sums


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as all their lowest bytes, then the next and so on, as the high ones are mostly 0 and shrink well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def text_runs(arrays: list[np.ndarray], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """The texts in runs of about so many tokens."""
    begin = size = 0
    for i, a in enumerate(arrays):
        size += len(a)
        if size > most or i + 1 == len(arrays):
            yield begin, i + 1
            begin, size = i + 1, 0


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a row, and where each begins."""
    return np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(a) for a in arrays])[:-1]]).astype(np.int64)


class Trainer:
    """Gradient ascent with a step for each weight that falls with its own past gradients."""

    def __init__(self, model: Model, rate: float, batch: int):
        self.weights, self.bias, self.rate, self.batch = model.weights.copy(), model.bias(), rate, batch
        # what rounds before have seen counts as so many gradients of a middling outcome
        self.squares = np.ones((ROWS, WIDE), np.float32) + 0.04 * model.seen[:, None]
        self.seen = np.zeros(ROWS, np.float32)

    def take(self, texts: list[np.ndarray]) -> None:
        codes, begins = joined(texts)
        factors = features(codes, begins)
        for at in range(0, len(codes), self.batch):
            some = slice(at, at + self.batch)
            for i, (outcome, prefix, rows) in enumerate(factors):
                for where, times, sums in list(gradient(self.weights, self.bias, i, outcome[some], prefix[some], [r[some] for r in rows])):
                    self.seen[where] += times
                    squares = np.take(self.squares, where, axis=0)
                    squares += sums * sums
                    self.squares[where] = squares
                    sums *= self.rate
                    sums /= np.sqrt(squares)
                    self.weights[where] = (np.take(self.weights, where, axis=0) + sums).clip(-8, 8)


def mixed(parts: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """How often each row was seen by any task, and its weights: the mean over tasks, each counted as often as it saw the row."""
    seen = total = None
    for n, w in parts:
        n, w = np.frombuffer(n, np.float32), np.frombuffer(w, np.float16).reshape(-1, WIDE)
        seen, total = (n.copy(), n[:, None] * w) if seen is None else (seen + n, total + n[:, None] * w)
    return seen, total / np.maximum(seen, 1)[:, None]


def train_round(codes: DataFrame, model: Model, rate: float, batch: int, task_tokens: int) -> Model:
    """The model after one round of distributed gradient updates over all rows of codes (column codes: leaves, 16 bits).

    Every task begins with the model's weights and takes gradient steps over its rows, then the tasks' weights are averaged,
    each row by how often a task saw it. Weights meet by slice, in two steps, so that no task reads what all others have.
    There are as many tasks as cores, or more, so that none has over task_tokens."""
    width = -(-ROWS // SLICES)
    names = ["slice", "n", "w"]
    schema = "slice int, n binary, w binary"

    def run(batches):
        trainer, held, size = Trainer(model, rate, batch), [], 0
        for each in batches:
            for raw in each.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint16))
                size += len(held[-1])
                if size > 500_000:
                    trainer.take(held)
                    held, size = [], 0
        if held:
            trainer.take(held)
        for s in range(SLICES):
            some = slice(s * width, (s + 1) * width)
            if trainer.seen[some].any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([trainer.seen[some].tobytes()], pa.binary()), pa.array([trainer.weights[some].astype(np.float16).tobytes()], pa.binary())], names=names)

    def mix(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w = mixed((n, w) for b in batches for n, w in zip(b.column("n").to_pylist(), b.column("w").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([w.astype(np.float16).tobytes()], pa.binary())], names=names)

    tasks = max(codes.sparkSession.sparkContext.defaultParallelism, -(-model.tokens // task_tokens))
    parts = codes.select("codes").coalesce(tasks).mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 64)
    out = Model(model.tokens, model.sizes, model.kinds, model.weights.copy(), model.seen.copy())
    for s, n, w in parts.groupBy("slice", "salt").applyInArrow(mix, schema).groupBy("slice").applyInArrow(mix, schema).collect():
        n, at = np.frombuffer(n, np.float32), slice(s * width, (s + 1) * width)
        new = np.frombuffer(w, np.float16).reshape(-1, WIDE)
        out.weights[at] = np.where(n[:, None] > 0, new, out.weights[at])
        out.seen[at] += n
    return out


def coded(rows: DataFrame, rounds: int, block_chars: int) -> DataFrame:
    """Rows (_id, _text, _held) as one table of two kinds of rows, written once.

    Texts: _block, _id, _held, share (of the rounds), numbers (the tokens' numbers in their block, packed), codes (their
    leaves, 16 bits). Tokens of a block: _block, number, token, n (times in rows learnt from), leaf. A block is a run of
    texts of one input partition, of about block_chars characters, so no text is shuffled.
    """
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), *struct_type(_held=T.BooleanType(), share=T.IntegerType(), numbers=T.BinaryType(), codes=T.BinaryType(), _block=T.LongType(), number=T.IntegerType(), token=T.BinaryType(), n=T.LongType(), leaf=T.IntegerType())])
    names = schema.names

    def run(batches):
        index: dict[bytes, int] = {}
        leaves, learnt, size, block, dealt = np.empty(0, np.uint16), np.empty(0, np.int64), 0, TaskContext.get().partitionId() << 32, 0
        waiting, waited = [], 0

        def texts() -> pa.RecordBatch:
            """The rows of the texts read since the last call."""
            nonlocal leaves, learnt, waiting, waited, dealt
            new = list(index)[len(leaves) :]
            leaves = np.append(leaves, np.fromiter(map(leaf, new), np.uint16, len(new)))
            learnt = np.append(learnt, np.zeros(len(new), np.int64))
            ids, held, numbers = zip(*waiting)
            learnt = learnt + np.bincount(np.concatenate([n for n, h in zip(numbers, held) if not h] or [np.empty(0, np.int32)]), minlength=len(learnt))
            count = len(ids)
            shares = [(dealt + i) % rounds for i in range(count)]
            dealt += count
            columns = [pa.concat_arrays(ids), pa.array(held), pa.array(shares, pa.int32()), pa.array([packed(n) for n in numbers], pa.binary()), pa.array([leaves[n].tobytes() for n in numbers], pa.binary()), pa.array([block] * count, pa.int64())]
            waiting, waited = [], 0
            return pa.RecordBatch.from_arrays(columns + [pa.nulls(count, t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int32())], names=names)

        def tokens():
            known = list(index)
            for at in range(0, len(known), 50_000):
                some = known[at : at + 50_000]
                count = len(some)
                empty = [pa.nulls(count, f.type) for f in pa.schema([("_id", id_type), ("_held", pa.bool_()), ("share", pa.int32()), ("numbers", pa.binary()), ("codes", pa.binary())])]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([block] * count, pa.int64()), pa.array(range(at, at + count), pa.int32()), pa.array(some, pa.binary()), pa.array(learnt[at : at + count]), pa.array(leaves[at : at + count].astype(np.int32))], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for i, (body, h) in enumerate(zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())):
                words = tokens_of(body)
                numbers = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words))
                waiting.append((batch.column(0).slice(i, 1), h, numbers))
                waited += len(words)
                size += len(body)
                if waited > 200_000 or len(waiting) == 1000:
                    yield texts()
                if size > block_chars:
                    if waiting:
                        yield texts()
                    yield from tokens()
                    index.clear()
                    leaves, learnt, size, block = leaves[:0], learnt[:0], 0, block + 1
        if waiting:
            yield texts()
        if index:
            yield from tokens()

    return stored(rows.mapInArrow(run, schema))


def fit(seen: DataFrame, counts: DataFrame, rounds: int, rate: float, batch: int, task_tokens: int) -> Model:
    """The model of all rows of coded() that are not held out, each of which is in one round."""
    sizes, kinds = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in counts.groupBy("leaf").agg(F.sum("c").alias("size"), F.count("*").alias("kinds")).collect():
        sizes[r["leaf"]], kinds[r["leaf"]] = r["size"], r["kinds"]
    model = Model(int(sizes.sum()), sizes, kinds)
    if model.tokens:
        for i in range(rounds):
            model = train_round(seen.where((F.col("share") == i) & ~F.col("_held")), model, rate, batch, task_tokens)
    return model


class Scorer:
    """log10 probabilities of texts given as leaves and counts of their tokens."""

    def __init__(self, model: Model):
        self.model, self.bias = model, model.bias()
        self.within = np.log(model.sizes + model.kinds + 1)

    def score(self, codes: np.ndarray, c: np.ndarray, begins: np.ndarray, step: int = 16_384) -> np.ndarray:
        each = np.log(c + 1.0) - self.within[codes]
        for i, (outcome, prefix, rows) in enumerate(features(codes, begins)):
            for at in range(0, len(codes), step):
                some = slice(at, at + step)
                found = logits(self.model.weights, self.bias, i, prefix[some], [r[some] for r in rows])
                each[some] += found[np.arange(len(found)), outcome[some]]
                each[some] -= np.log(np.exp(found, out=found) @ ONES)
        return np.add.reduceat(each, begins) / np.log(10)


def score(df: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, rounds: int = 2, rate: float = 0.2, batch: int = 8192, block_chars: int = 32_000_000, task_tokens: int = 20_000_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of df.

    Rows with crc32(id as text) mod folds = held are held out; all others are learnt from, each in one of the rounds. Tokens
    are words (A-Z lower-cased, split at the six ASCII blanks) and one END a text; a null text has only that. base_score sums
    log10((c + 1) / (N + V + 1)), score is the model's log10 probability of all tokens. Null ids are learnt from; repeated
    rows count each time; other columns are dropped; an empty table gives an empty table.

    The vocabulary grows with the corpus and is never broadcast or collected. Texts are read once: a block of them gives its
    distinct tokens with their counts, which are summed by token and joined back to the blocks' tokens, and meet the block's
    texts, by then numbers, where these are scored with a table of the block's own tokens. A frequent token has a row for each
    block, not for each place. The model has a fixed number of features (FAMILIES). Weights depend a little on how many tasks
    there are.
    """
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), (fold(F.col(id), folds) == held).alias("_held"))
    seen = coded(rows, rounds, block_chars)
    tokens = seen.where(F.col("token").isNotNull())
    counts = stored(tokens.groupBy("token").agg(F.sum("n").alias("c"), F.first("leaf").alias("leaf")).where("c > 0"))
    model = fit(seen, counts, rounds, rate, batch, task_tokens)
    distinct = int(model.kinds.sum())

    out = T.StructType([T.StructField(id, df.schema[id].dataType)] + list(struct_type(held_out=T.BooleanType(), n_tokens=T.LongType(), n_known=T.LongType(), train_tokens=T.LongType(), base_score=T.DoubleType(), score=T.DoubleType())))

    def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
        number = known.column("number").to_numpy()
        c, leaves = np.zeros(len(number)), np.zeros(len(number), np.uint16)
        c[number], leaves[number] = known.column("c").to_numpy(), known.column("leaf").to_numpy()
        scorer, numbers = Scorer(model), [unpacked(x) for x in texts.column("numbers").to_pylist()]
        n_tokens, n_known, base, full = [], [], [], []
        for begin, end in text_runs(numbers):
            n, begins = joined(numbers[begin:end])
            times = c[n]
            n_tokens += [len(x) for x in numbers[begin:end]]
            n_known += np.add.reduceat((times > 0).astype(np.int64), begins).tolist()
            base += np.add.reduceat(np.log10((times + 1) / (model.tokens + distinct + 1)), begins).tolist()
            full += scorer.score(leaves[n], times, begins).tolist()
        return pa.table([texts.column("_id"), texts.column("_held"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([model.tokens] * len(full), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=out.names)

    tables = tokens.select("_block", "number", "token", "leaf").join(counts.select("token", "c"), "token", "left").select("_block", "number", F.coalesce("c", F.lit(0)).cast("double").alias("c"), "leaf")
    texts = seen.where(F.col("codes").isNotNull()).select(F.col("_block").alias("_of"), "_id", "_held", "numbers")
    return texts.groupBy("_of").cogroup(tables.groupBy("_block")).applyInArrow(scored, out)
