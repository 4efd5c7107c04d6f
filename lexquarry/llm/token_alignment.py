"""Alignment of two tokenizers over a corpus: which tokens of one overlap which of the other, byte by byte.

Texts are cut before runs of blanks, where no entry of either vocabulary can reach across, so that a text's tokens are those of
its segments one after another. Each distinct segment is tokenized and aligned once, and what was found is joined back to the
blocks of texts that hold it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexquarry.llm.common import as_texts, broadcast_small, cut, sliced, stored, struct_type

SPACE = "▁"
#: A block ends with the text that brings it to so many characters.
BLOCK_CHARS = 32_000_000
#: Where a text may be cut: before a space that follows something else than white space, or B's sign for it.
BORDER = re.compile(rf"(?<=[^\s{SPACE}])(?= )")
#: Any other space, which the pieces between spaces would be cut at.
INSIDE = re.compile(rf"[\s{SPACE}] ")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b if b in visible else 256 + hidden.index(b)): b for b in range(256)}


#: Fixed value: how byte-level BPE parts a text into words before it merges bytes.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """A byte-level BPE tokenizer (A) and a SentencePiece model (B), each with the bytes of its tokens.

    A's entries are numbered in the order of their merges (else its own library encodes), so they serve as ranks for an encoder
    that is several times as fast on short texts.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs, vocabulary = byte_signs(), self.a.get_vocab(with_added_tokens=False)
        entries = {t: i for t, i in vocabulary.items() if all(c in signs for c in t)}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {bytes(signs[c] for c in t): i for t, i in entries.items() if t not in special}
        self.bytes_a = {i: b for b, i in ranks.items()} | {self.a.token_to_id(t): t.encode() for t in special}
        merges = [self.a.token_to_id("".join(m)) for m in (x if isinstance(x, list) else x.split(" ") for x in json.loads(self.a.to_str())["model"]["merges"])]
        self.ranked = None
        if merges == sorted(merges) and len(ranks) == len(merges) + 256:
            self.ranked = tiktoken.Encoding("A", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.cuttable = self.parts_at_spaces()

    def parts_at_spaces(self) -> bool:
        """Whether no entry of either vocabulary reaches across a place where texts may be cut, and A's rule for words begins a new
        one at every such place. If not, texts are not cut."""
        across = any(BORDER.search(t.decode(errors="replace")) for t in [*self.bytes_a.values(), *self.bytes_b])
        splitter = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        return not across and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") is True and not splitter.get("add_prefix_space")

    def segments(self, text: str) -> list[str]:
        """The segments of " " + text without the space that each begins with, so that joined by spaces they give the text."""
        if not self.cuttable or " " not in text:
            return [text]
        if not (text[0] == " " or text[-1] == " " or INSIDE.search(text)):
            return text.split(" ")
        parts = BORDER.split(" " + text)
        if len(parts) > 1 and not parts[-1].strip(" "):  # a run of spaces at the end is no segment of its own
            parts[-2:] = [parts[-2] + parts[-1]]
        return [p[1:] for p in parts]

    def encoded_a(self, segments: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + s) for s in segments]
        return [e.ids for e in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]

    def aligned(self, segments: list[str]) -> dict[str, list | pa.Array]:
        """For each segment: tokens of A; the groups' text, which is empty if a tokenizer does not give the segment back; and the
        links, pairs of tokens that share a byte: A's id, shifted by 32 bits, and B's.

        All segments are one string of bytes here, and every token a range of it.
        """
        a, b = self.encoded_a(segments), self.b.encode(segments, num_threads=1)
        raw = [(" " + s).encode() for s in segments]
        if not all(b"".join(map(t.__getitem__, chain.from_iterable(ids))) == b"".join(raw) for t, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            for k, r in enumerate(raw):
                if any(b"".join(map(t.__getitem__, ids[k])) != r for t, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                    a[k], b[k], raw[k] = [], [], b""
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        sizes_a, sizes_b = self.sizes_a[ids_a], self.sizes_b[ids_b]
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        # groups end where tokens of both do
        ends, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        names_a, names_b = [list(map(str, ids.tolist())) for ids in (ids_a, ids_b)]
        groups, i, j = [], 0, 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            groups.append(",".join(names_a[i:p]) + "|" + ",".join(names_b[j:q]))
            i, j = p, q
        own = np.searchsorted(ends, np.cumsum([len(r) for r in raw]), side="right").tolist()
        # the tokens of B that a token of A overlaps: from the one that holds its first byte to the one that holds its last
        first = np.searchsorted(ends_b, ends_a - sizes_a, side="right")
        count = np.searchsorted(ends_b, ends_a, side="left") - first + 1
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
        links = np.repeat(ids_a, count) << 32 | ids_b[other]
        bounds = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum([len(x) for x in a])])]
        return {
            "n_a": pa.array([len(x) for x in a], pa.int32()), "groups": pa.array([";".join(groups[x:y]) for x, y in zip([0, *own], own)], pa.string()),
            "links": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(links)),
        }


_loaded: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One for each Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def shrunk(codes: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of one place together, compressed."""
    return pa.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def grown(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * count, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def blocks(docs: DataFrame, path_a: str, path_b: str, id: str, text: str) -> DataFrame:
    """(block, ids, ends, codes, segments, counts): texts in blocks, as numbers of the block's distinct segments.

    A block is named by its partition and its place there. Its segments are listed once, with how often they occur; ends are the
    sums of the texts' numbers of segments. A null or empty text has none. A very long text is a block of its own.
    """
    schema = struct_type(block=T.LongType(), ids=T.ArrayType(docs.schema[id].dataType), ends=T.ArrayType(T.LongType()), codes=T.BinaryType(), segments=T.ArrayType(T.StringType()), counts=T.ArrayType(T.LongType()))
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, part, made = pair(path_a, path_b), 0, 0
        ids, ends, codes, known, chars = [], [0], [], {}, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            row = [part << 32 | made, ids, ends[1:], shrunk(flat), list(known), np.bincount(flat, minlength=len(known)).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=schema.names)

        for batch in batches:
            for part, which, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_texts(batch.column(2))):
                own = [known.setdefault(s, len(known)) for s in cutter.segments(body)] if body else []
                ids.append(which)
                ends.append(ends[-1] + len(own))
                codes.append(np.array(own, np.int32))
                chars += len(body)
                if chars >= BLOCK_CHARS:
                    yield block()
                    made += 1
                    ids, ends, codes, known, chars = [], [0], [], {}, 0
        if ids:
            yield block()

    return docs.select(F.spark_partition_id().alias("_part"), F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


ALIGNED = struct_type(segment=T.StringType(), n=T.LongType(), n_a=T.IntegerType(), groups=T.StringType(), links=T.ArrayType(T.LongType()))


def align_segments(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(segment, n) with what both tokenizers make of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in sliced(batches, 5000):
            found = both.aligned(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.values()], names=ALIGNED.names)

    return distinct.select("segment", "n").mapInArrow(run, ALIGNED)


def in_spoiled_texts(held: DataFrame, entries: DataFrame, aligned: DataFrame) -> DataFrame:
    """(segment, gone): how often segments occur in texts that hold a segment which a tokenizer does not give back."""
    bad = aligned.where("groups = ''").select("segment")
    spots = entries.join(bad, "segment", "left_semi").groupBy("block").agg(F.collect_list("pos").alias("bad"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ends, raw, segments, bad in zip(*(batch.column(k).to_pylist() for k in range(4))):
                codes, spoiled = grown(raw, ends[-1]), np.zeros(len(segments), bool)
                spoiled[bad] = True
                begins = [0, *ends[:-1]]
                gone = np.zeros(len(segments), np.int64)
                for begin, end in zip(begins, ends):
                    if spoiled[codes[begin:end]].any():
                        gone += np.bincount(codes[begin:end], minlength=len(segments))
                some = np.flatnonzero(gone)
                yield pa.RecordBatch.from_arrays([pa.array([segments[k] for k in some.tolist()], pa.string()), pa.array(gone[some])], names=["segment", "gone"])

    return held.join(spots, "block").select("ends", "codes", "segments", "bad").mapInArrow(run, "segment string, gone long").groupBy("segment").agg(F.sum("gone").alias("gone"))


def packed(told: DataFrame) -> DataFrame:
    """(block, part): the rows (block, pos, n_a, groups, n_best, count_sum) of each block in a partition as one compressed Arrow
    batch, so that what goes back to the blocks is a few values for each rather than a row for each segment."""
    schema = struct_type(block=T.LongType(), part=T.BinaryType())
    names = ["pos", "n_a", "groups", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
            parts = []
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(of)]):
                some = pa.RecordBatch.from_arrays([c.slice(begin, end - begin) for c in batch.columns[1:]], names=names)
                some = some.take(pc.sort_indices(some.column(0)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                parts.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(of[begins], pa.int64()), pa.array(parts, pa.binary())], names=schema.names)

    return told.select("block", *names).sortWithinPartitions("block").mapInArrow(run, schema)


COLUMNS = struct_type(n_a=T.LongType(), n_b=T.LongType(), n_groups=T.LongType(), n_links=T.LongType(), n_best=T.LongType(), count_sum=T.LongType(), groups_sha256=T.StringType())


def compose(found: DataFrame, id: str, id_type: T.DataType) -> DataFrame:
    """Rows of documents from (ids, ends, codes, known), known being packed(): the sums over their segments and the hash of their groups in order."""
    schema = T.StructType([T.StructField(id, id_type), *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ends = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
                codes = grown(batch.column(2)[row].as_py(), int(ends[-1]))
                bounds, sums, hashes = np.concatenate([[0], ends]), np.zeros((6, len(ends)), np.int64), [""] * len(ends)
                if len(codes):
                    known = pa.concat_tables(pa.ipc.open_stream(part.as_buffer()).read_all() for part in batch.column(3)[row].values)
                    known = known.take(pc.sort_indices(known.column("pos"))).combine_chunks()
                    n_a, groups, n_best, count_sum = (known.column(c).chunk(0) for c in ("n_a", "groups", "n_best", "count_sum"))
                    bad = pc.equal(groups, "").to_numpy(zero_copy_only=False)
                    n_a = n_a.to_numpy(zero_copy_only=False).astype(np.int64)
                    n_groups = (pc.count_substring(groups, ";").to_numpy() + ~bad).astype(np.int64)
                    n_links = pc.count_substring(groups, ",").to_numpy() + n_groups  # in a group, each link but the last ends one token
                    each = [bad, n_a, n_links + n_groups - n_a, n_groups, n_links, n_best.to_numpy(zero_copy_only=False), count_sum.to_numpy(zero_copy_only=False)]
                    total = np.array([np.diff(np.concatenate([[0], np.cumsum(x[codes], dtype=np.int64)])[bounds]) for x in each])
                    whole = (total[0] == 0) & (bounds[1:] > bounds[:-1])
                    sums = total[1:] * whole
                    text = list(map(str.encode, groups.to_pylist()))
                    for k in np.flatnonzero(whole).tolist():
                        hashes[k] = sha256(b";".join(map(text.__getitem__, codes[bounds[k] : bounds[k + 1]].tolist()))).hexdigest()
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, *map(pa.array, sums), pa.array(hashes, pa.string())], names=schema.names)

    return found.select("ids", "ends", "codes", "known").mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A encodes a space and the text, B the text, to which it adds a space itself; special tokens' strings are plain text. Where
    tokens of both end, they are cut into groups; tokens that share a byte are linked. A pair's count is how many links of the
    corpus hold it. A text that is null or empty, or that the bytes of A's or B's tokens do not give back (as one with B's
    sign for spaces), has zeros, no hash, and counts for nothing. Repeated rows and ids count each; other columns go.
    """
    held = stored(blocks(docs, path_a, path_b, id, text))
    entries = held.select("block", F.posexplode(F.arrays_zip("segments", "counts")).alias("pos", "s")).select("block", "pos", F.col("s.segments").alias("segment"), F.col("s.counts").alias("count"))
    aligned = stored(align_segments(entries.groupBy("segment").agg(F.sum("count").alias("n")), path_a, path_b))
    used = aligned.where("groups <> ''")
    if not aligned.where("groups = ''").isEmpty():
        used = used.join(in_spoiled_texts(held, entries, aligned), "segment", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    counts = used.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    of_b = F.col("link").bitwiseAND(0xFFFFFFFF)
    ranked = cut(counts.withColumn("is_best", (F.col("count") == F.max("count").over(Window.partitionBy(of_b))).cast("int")))  # an id of B has at most as many rows as A has ids
    scored = used.select("segment", F.explode("links").alias("link")).join(broadcast_small(ranked), "link").groupBy("segment").agg(F.sum("is_best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
    told = aligned.select("segment", "n_a", "groups").join(scored, "segment", "left")
    found = entries.select("block", "pos", "segment").join(told, "segment").select("block", "pos", "n_a", "groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
    known = packed(found).groupBy("block").agg(F.collect_list("part").alias("known"))
    return compose(held.select("block", "ids", "ends", "codes").join(known, "block", "left"), id, docs.schema[id].dataType)
