"""Packing: documents cut into pieces whose lengths are powers of two, each a sequence of its own."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import BLANKS, as_texts, give_back, sliced


#: What a byte of UTF-8 is to a tokenizer with word ends: a blank, of a run of letters, of a run of signs, or of a word that goes
#: whole through the tokenizer. 0xFF, which UTF-8 does not have, ends a text.
BLANK, LETTER, SIGN, ODD, END = range(5)
KINDS = np.full(256, ODD, np.uint8)
KINDS[list(BLANKS)] = BLANK
KINDS[[0xC3, *range(0x80, 0xC0), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KINDS[[b for b in range(33, 127) if re.match(r"[!-&(-/:-@\[-`{-~]", chr(b))]] = SIGN
KINDS[0xFF] = END
KINDS = KINDS.tobytes()
LOWER = bytes(range(256)).lower()


class WordTokens:
    """Ids of whole texts by a tokenizer with word ends that lower-cases and drops white space; known parts are kept.

    A text of ASCII signs and Latin-1 letters, without digits and apostrophes, is a sequence of runs of letters and runs of
    signs, which the tokenizer takes one by one; its model is asked once for each. Any other text goes word by word: such a
    word the same way, another through the whole tokenizer. The kept parts are short and go when there are `most`,
    so memory is bounded in bytes.
    """

    run = r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+"
    plain = re.compile(r"[\t-\r -&(-/:-~À-ÖØ-öø-ÿ]*")
    runs = re.compile(run)

    class Parts(dict):
        """part -> its ids as bytes; a part not yet known is looked up and, unless it is long, kept."""

        def __init__(self, find, longest: int = 64):
            self.find, self.longest = find, longest

        def __missing__(self, part):
            out = self.find(part)
            if len(part) <= self.longest:
                self[part] = out
            return out

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.most = self.tokenizer.model, most
        self.parts, self.words = self.Parts(self._part), self.Parts(self._word)
        self.kept: dict[bytes, bytes] = {}
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.signs = {b: b if b in visible else 256 + hidden.index(b) for b in range(256)}

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.plain.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, self.runs.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if len(self.parts) + len(self.words) > self.most:
            self.parts.clear()
            self.words.clear()
        if self.plain.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, self.runs.findall(text.lower())))
        return b"".join([self.words[w.decode()] for w in text.encode().split()])

    def encode_all(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) with end_id after each, and where each text's ids end; as encode() gives them.

        The texts are cut at once into runs of letters, signs or blanks and odd words, each of which is looked up once and, unless
        it is long, kept for the texts to come. When too many are kept, the later half goes, as what is frequent comes early.
        """
        raw = b"\xff".join([*texts, b""])
        if raw.count(b"\xff") != len(texts):
            raise ValueError("a text is not UTF-8")
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int32)
        data = np.frombuffer(raw, np.uint8)
        kinds, lower = self._marked(raw, data)
        new = kinds[1:] != kinds[:-1]
        new |= kinds[1:] == END
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(data)]]).astype(np.int32)
        kinds = kinds[cuts[:-1]]
        runs = pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(cuts), pa.py_buffer(lower)]).dictionary_encode()
        own = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        kind = np.zeros(len(own), np.uint8)
        kind[runs.indices.to_numpy()] = kinds
        if len(self.kept) > 4 * self.most:
            for _ in range(len(self.kept) // 2):
                self.kept.popitem()
        ids = list(map(self.kept.get, own))
        for i, what in enumerate(kind.tolist()):
            if ids[i] is None:
                if what in (LETTER, SIGN):
                    ids[i] = self._part(own[i].decode())
                elif what == ODD:
                    ids[i] = array("I", self.tokenizer.encode(own[i].decode(), add_special_tokens=False).ids).tobytes()
                else:
                    ids[i] = b"" if what == BLANK else array("I", [end_id]).tobytes()
                if len(own[i]) <= 64 and what != END:
                    self.kept[own[i]] = ids[i]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        found = pc.take(each, runs.indices)
        return found.flatten().to_numpy(), found.offsets.to_numpy()[1:][kinds == END]

    @staticmethod
    def _marked(raw: bytes, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each byte, and the bytes with the letters of all but odd words in lower case."""
        kinds, lower = (np.frombuffer(bytearray(raw.translate(t)), np.uint8) for t in (KINDS, LOWER))
        second = np.flatnonzero(data == 0xC3) + 1  # of a sign from U+00C0 to U+00FF
        after = data[second]
        times = (after == 0x97) | (after == 0xB7)  # and the sign of division
        lower[second[(after < 0x9F) & ~times]] += 0x20
        kinds[second[times]] = ODD
        odd = np.flatnonzero(kinds == ODD)
        if len(odd):
            borders = np.flatnonzero((kinds == BLANK) | (kinds == END))
            word = np.searchsorted(borders, odd)
            word = word[np.diff(word, prepend=-1) > 0]
            change = np.zeros(len(data), np.int8)
            change[np.where(word > 0, borders[word - 1] + 1, 0)] += 1
            change[borders[word]] -= 1
            inside = np.cumsum(change, dtype=np.int8).astype(bool)
            kinds[inside], lower[inside] = ODD, data[inside]
        return kinds, lower


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def binary_lengths(total: int, most: int) -> list[int]:
    """total as `most` again and again, then its binary digits, the largest first."""
    rest = total % most
    return [most] * (total // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 1, ids: bool = True) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and (unless ids is false) ids.

    A document's ids and one end id are cut into pieces of `most` ids (a power of two), then by the binary digits of the
    rest. Each piece is a sequence: its length is a power of two, so nothing is padded, no sequence crosses documents, and
    sequences of equal length form a bucket (see write_buckets). sequence_id is unique for the rows of one input whose
    partitions stay the same, as those of files do; offset is 0. A null or empty text is one piece holding the end id.
    Repeated rows and null ids are packed like others, each on its own. There is no shuffle, and other columns are dropped.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    fields = [df.schema[id].dataType, *[T.LongType()] * 4]
    schema = T.StructType([T.StructField(n, t) for n, t in zip([id, "start", "length", "ids_crc32", "doc_tokens"], fields)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        tokens, end = word_tokens(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches, 1000):
            which, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
            for row, b in enumerate(as_texts(batch.column(1))):
                data = tokens.encode(b) + end
                total, at = len(data) // 4, 0
                for size in binary_lengths(total, most):
                    piece = data[4 * at : 4 * (at + size)]
                    which.append(row)
                    starts.append(at)
                    lengths.append(size)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    if ids:
                        pieces.append(piece)
                    at += size
            columns = [batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(pieces), dtype="<u4").astype(np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
        give_back()

    packed = rows.mapInArrow(run, schema)
    return packed.select(id, "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences of pack() to a folder for each length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("length").parquet(path)
