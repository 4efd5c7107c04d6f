"""SentencePiece encoding and decoding: the segmentation of the largest summed score, with giant texts in parallel chunks.

Best scores follow a recursion over positions in the (max, +) semiring, so a chunk acts on the scores of the last few
positions before it as a matrix; matrices combine associatively, and then every chunk can be traced back on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import as_texts, sliced, stored, struct_type

LOW = float("-inf")
SPACE = "▁"
#: Stands in a text for the space sign itself, which would else come back as a space: half a surrogate, which no text can hold.
LITERAL = "\ud800"


class Pieces:
    """A vocabulary with scores. Spaces are SPACE, one is put before the text; a code point that is no piece is its bytes.

    Pieces that hold SPACE after their first code point are runs of spaces, which their scores exclude; they are left out.
    Of equal sums the one with the longest last piece counts, then the longest before it, and so on.
    """

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What an id stands for, unless it is a byte above 127, which needs those beside it.
        self.texts = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else n.replace(SPACE, " ") for i, n in enumerate(self.names)]
        self.joined = np.array([self.byte_of.get(i, 0) > 127 for i in range(len(self.names))])
        plain = [i for i, n in enumerate(self.names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in n[1:]]
        self.ids = {self.names[i]: i for i in plain}
        self.length = max(map(len, self.ids))
        self.unknown = min(s for s in map(model.get_score, plain) if s > -1e6) - 10  # lower scores exclude a piece
        #: The score of each piece; None for what only begins one.
        self.table: dict[str, float | None] = {n[:k]: None for n in self.ids for k in range(1, len(n))}
        self.table |= {n: model.get_score(i) for n, i in self.ids.items()}
        self.most = most
        ends = SPACE if "\n" in self.ids else SPACE + "\n"
        self.unit = re.compile(f"[{ends}][^{ends}]*|[^{ends}]+")
        self.known = self.Known(self.segment)

    class Known(dict):
        """word -> its ids and score; a word not yet known is segmented and kept."""

        def __init__(self, find):
            self.find = find

        def __missing__(self, word):
            out = self[word] = self.find(word)
            return out

    def relax(self, text: str, best: list, back: list[int], after: int, until: int) -> None:
        """Extends the best scores from positions before `until` to ends after `after`."""
        table, n = self.table, len(text)
        for i in range(until):
            from_here = best[i]
            if from_here == LOW:
                continue
            if self.table.get(text[i]) is None and i + 1 > after and from_here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = from_here + self.unknown, i
            for j in range(i + 1, n + 1):
                score = table.get(text[i:j], LOW)
                if score is LOW:
                    break
                if score is not None and j > after and from_here + score > best[j]:
                    best[j], back[j] = from_here + score, i

    def matrix(self, text: str) -> np.ndarray:
        """[p, q]: the best score from the q-th of the first `length` positions to the p-th of the last, for pieces that end
        after the first ones. All paths meet before a SPACE, so that from there on one path is followed."""
        size, n = self.length, len(text)
        first = size - 1
        last = n - first
        meet = next((h for h in range(first, last + 1) if self.cuts(text, h)), None)
        until = n if meet is None else meet
        best = np.full((n + 1 if meet is None else until + 1, size), LOW)
        best[:size][np.arange(size), np.arange(size)] = 0
        for i in range(until):
            if self.table.get(text[i]) is None and i + 1 > first:
                best[i + 1] = np.maximum(best[i + 1], best[i] + self.unknown)
            for j in range(i + 1, min(until, i + size) + 1):
                score = self.table.get(text[i:j], LOW)
                if score is LOW:
                    break
                if score is not None and j > first:
                    best[j] = np.maximum(best[j], best[i] + score)
        if meet is None:
            return best[last:]
        rest = [LOW] * (n - meet + 1)
        rest[0] = 0.0
        self.relax(text[meet:], rest, [0] * len(rest), 0, n - meet)
        return np.array(rest[last - meet :])[:, None] + best[meet][None, :]

    def cuts(self, text: str, h: int) -> bool:
        """Whether no piece can hold both neighbours of a position."""
        return text[h] == SPACE or self.table.get(text[h], LOW) is LOW or self.table.get(text[h - 1], LOW) is LOW

    def traced(self, text: str, back: list[int], end: int, begin: int) -> tuple[list[int], int]:
        """The ids on the way back from a position to one not after begin, in order, and that position."""
        out: list[int] = []
        while end > begin:
            start = back[end]
            piece = self.ids.get(text[start:end])
            out += [piece] if piece is not None else [self.bytes[b] for b in reversed((SPACE if text[start] == LITERAL else text[start]).encode())]
            end = start
        return out[::-1], end

    def segment(self, text: str) -> tuple[bytes, float]:
        """Ids (little-endian, 32 bits) and score of a text as prepare() makes it, by the recursion from end to end."""
        best, back = [0.0] + [LOW] * len(text), [0] * (len(text) + 1)
        self.relax(text, best, back, 0, len(text))
        return np.array(self.traced(text, back, len(text), 0)[0], dtype="<i4").tobytes(), best[-1]

    def encode(self, text: str) -> tuple[bytes, float]:
        """As segment(prepare(text)), word by word: no piece reaches over the start of a word or over a line end."""
        if len(self.known) > self.most:
            self.known.clear()
        words = self.unit.findall(prepare(text))
        if not words:
            return b"", 0.0
        parts, scores = zip(*map(self.known.__getitem__, words))
        return b"".join(parts), sum(scores)

    def decode(self, ids: np.ndarray) -> str:
        """The text; the space put before it is taken off by whoever holds its first ids."""
        parts = list(map(self.texts.__getitem__, ids.tolist()))
        end = -1
        for k in np.flatnonzero(self.joined[ids]).tolist():
            if k >= end:
                end = k + 1
                while end < len(ids) and self.joined[ids[end]]:
                    end += 1
                parts[k:end] = [bytes(self.byte_of[int(i)] for i in ids[k:end]).decode(errors="replace"), *[""] * (end - k - 1)]
        return "".join(parts)


def prepare(text: str) -> str:
    return (SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else ""


def bodies(chunks: pa.Array) -> list[str]:
    """Chunks of prepared texts, as they are kept between stages."""
    return [b.decode("utf-8", "surrogatepass") for b in chunks.to_pylist()]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices in the (max, +) semiring, over the first axis."""
    return np.max(a[:, :, :, None] + b[:, None, :, :], axis=2)


def scanned(matrices: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, 3, ... matrices, later ones to the left: an associative scan by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        with np.errstate(invalid="ignore"):
            out[step:] = np.concatenate([times(out[i : i + 256], out[i - step : i - step + 256][: len(out[i : i + 256])]) for i in range(step, len(out), 256)])
        step *= 2
    return out


ENCODED = struct_type(chunk=T.LongType(), ids=T.BinaryType(), score=T.DoubleType())


def encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", chunk_chars: int = 65_536) -> DataFrame:
    """(id, chunk, ids, score): the ids (binary, little-endian, 32 bits) of each text, and the sum of their scores.

    A text of less than two chunks is one row (chunk 0). A longer one has a row for each chunk, in order, whose ids together
    are those of the whole text, the same as without chunks; so no task holds more than a chunk's work, wherever the text has
    spaces or none. Null and empty texts have no ids. Repeated rows and ids are encoded each; other columns are dropped.
    """
    rows = df.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), *ENCODED])
    names = schema.names

    def whole(batches):
        vocab = pieces(path)
        for batch in sliced(batches):
            got = [vocab.encode(t) for t in as_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.float64())], names=names)

    short = rows.where(F.length("_text") < 2 * chunk_chars).mapInArrow(whole, schema)

    def split(batches):
        size = pieces(path).length
        for batch in batches:
            for i, t in enumerate(as_texts(batch.column(2))):
                t = "\0" * (size - 1) + prepare(t)
                count = (len(t) - size + 1) // chunk_chars
                for c in range(count):
                    body = t[c * chunk_chars : (c + 1) * chunk_chars + size - 1 if c + 1 < count else len(t)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([c], pa.int64()), pa.array([body.encode("utf-8", "surrogatepass")])], names=["_row", "_id", "chunk", "body"])

    chunked = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_id", df.schema[id].dataType), T.StructField("chunk", T.LongType()), T.StructField("body", T.BinaryType())])
    long = rows.where(F.length("_text") >= 2 * chunk_chars).select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    chunks = stored(long.mapInArrow(split, chunked).repartition(F.col("_row"), F.col("chunk")))

    def matrices(batches):
        vocab = pieces(path)
        for batch in batches:
            got = [vocab.matrix(b).tobytes() for b in bodies(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["_row", "chunk", "data"])

    small = "_row long, chunk long, data binary"

    def entries(table: pa.Table) -> pa.Table:
        """The best scores of the positions before each chunk of one text (at most 2 GiB, so some ten thousand chunks)."""
        table = table.sort_by("chunk")
        each = np.stack([np.frombuffer(x).reshape(pieces(path).length, -1) for x in table.column("data").to_pylist()])
        start = np.full(each.shape[1], LOW)
        start[-1] = 0.0
        after = (scanned(each) + start[None, None, :]).max(axis=2)
        return table.set_column(2, "data", pa.array([x.tobytes() for x in np.vstack([start, after[:-1]])], pa.binary()))

    def forward(vocab: Pieces, body: str, data: bytes) -> tuple[list, list]:
        best = np.frombuffer(data).tolist() + [LOW] * (len(body) - vocab.length + 1)
        back = [0] * len(best)
        vocab.relax(body, best, back, vocab.length - 1, len(body))
        return best, back

    def exits(batches):
        vocab = pieces(path)
        for batch in batches:
            got = []
            for body, data in zip(bodies(batch.column(2)), batch.column(3).to_pylist()):
                best, back = forward(vocab, body, data)
                ends = range(len(body) - vocab.length + 1, len(body) + 1)
                memo: dict[int, int] = {}
                for e in ends:
                    at = e
                    while best[e] != LOW and at > vocab.length - 1 and at not in memo:
                        at = back[at]
                    memo[e] = memo.get(at, at) if best[e] != LOW else -1
                got.append(np.array([memo[e] for e in ends], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["_row", "chunk", "data"])

    def chosen(table: pa.Table) -> pa.Table:
        """Where the best path leaves each chunk: the last at its end, any other where the next is entered."""
        table = table.sort_by("chunk")
        out = [pieces(path).length - 1]
        for data in reversed(table.column("data").to_pylist()[1:]):
            out.append(int(np.frombuffer(data, np.int64)[out[-1]]))
        return table.set_column(2, "data", pa.array([np.int64(x).tobytes() for x in reversed(out)], pa.binary()))

    def trace(batches):
        vocab = pieces(path)
        for batch in batches:
            ids, scores = [], []
            for body, data, leave in zip(bodies(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                best, back = forward(vocab, body, data)
                end = len(body) - vocab.length + 1 + int(np.frombuffer(leave, np.int64)[0])
                got, begin = vocab.traced(body, back, end, vocab.length - 1)
                ids.append(np.array(got, dtype="<i4").tobytes())
                scores.append(best[end] - best[begin])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(scores, pa.float64())], names=names)

    entered = chunks.select("_row", "chunk", "body").mapInArrow(matrices, small).groupBy("_row").applyInArrow(entries, small)
    at_entry = stored(chunks.join(entered, ["_row", "chunk"]))
    left = at_entry.select("_row", "chunk", "body", "data").mapInArrow(exits, small).groupBy("_row").applyInArrow(chosen, small).withColumnRenamed("data", "leave")
    traced = at_entry.join(left, ["_row", "chunk"]).select("_id", "chunk", "body", "data", "leave").mapInArrow(trace, schema)
    return short.union(traced)


def decode(encoded: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """encode()'s rows with text (the decoded text of the row) in the place of ids, and n_ids and ids_crc32 (unsigned)."""
    at = [encoded.columns.index(c) for c in (id, "chunk", "ids", "score")]
    schema = T.StructType([encoded.schema[id], *struct_type(chunk=T.LongType(), score=T.DoubleType(), n_ids=T.LongType(), ids_crc32=T.LongType(), text=T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        vocab = pieces(path)
        for batch in sliced(batches):
            n, sums, texts = [], [], []
            for raw, chunk in zip(batch.column(at[2]).to_pylist(), batch.column(at[1]).to_pylist()):
                ids = np.frombuffer(raw, dtype="<i4")
                text = vocab.decode(ids)
                n.append(len(ids))
                sums.append(crc32(raw))
                texts.append(text[1:] if chunk == 0 else text)
            yield pa.RecordBatch.from_arrays([batch.column(at[0]), batch.column(at[1]), batch.column(at[3]), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
