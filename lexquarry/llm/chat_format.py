"""Chat formatting at token level: segments encoded one by one, reserved ids between them, loss masks by prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import as_texts, struct_type

#: The control strings, in the order of their reserved ids, which follow the vocabulary's.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROLS))

#: A control string, or one with backslashes after its first character.
CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\])|</?SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\])|</?SYS>>)")


def escape(text: str) -> str:
    """The text with one more backslash after the first character of each control string; unescape() takes it out again."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class Vocabulary:
    """A byte-level vocabulary in a rank file; encoding then decoding gives any text back."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path, pattern)
    return _loaded[path]


def assemble(segments: list[np.ndarray], trained: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The segments' ids in a row, and whether each is trained on: +1 where a trained segment begins and -1 where it ends,
    at the prefix sums of the lengths, summed up."""
    ends = np.cumsum([len(s) for s in segments])
    begins = np.concatenate([[0], ends[:-1]])
    marks = np.zeros(ends[-1] + 1, np.int64)
    on = np.array(trained, bool)
    np.add.at(marks, begins[on], 1)
    np.add.at(marks, ends[on], -1)
    return np.concatenate(segments), np.cumsum(marks)[:-1] > 0


def turn_segments(role: str, text: np.ndarray, name: np.ndarray, base: int) -> tuple[list[np.ndarray], list[bool]]:
    """A turn: user <s>[INST]text[/INST], assistant text</s>, system <s><<SYS>>text<</SYS>>, any other
    [ROLE]name[/ROLE]text</s>. Each opens in its own way, so the ids tell the turns apart. Only assistant texts are trained."""

    def ids(*controls: int) -> np.ndarray:
        return np.array(controls, dtype="<u4") + np.uint32(base)

    if role == "user":
        parts = [(ids(BOS, INST), False), (text, False), (ids(INST_END), False)]
    elif role == "assistant":
        parts = [(text, True), (ids(EOS), False)]
    elif role == "system":
        parts = [(ids(BOS, SYS), False), (text, False), (ids(SYS_END), False)]
    else:
        parts = [(ids(ROLE), False), (name, False), (ids(ROLE_END), False), (text, False), (ids(EOS), False)]
    return [p for p, _ in parts], [t for _, t in parts]


def format_conversations(df: DataFrame, path: str, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 4096, part_tokens: int = 131_072) -> DataFrame:
    """(conv, block, part, n_turns, input_ids, loss_mask): the turns of each conversation in order, in parts.

    Turns are formatted where they lie, then shuffled by conversation and block of `block` turn numbers, so a conversation
    of any length is spread over many tasks, and joined in parts that close after part_tokens ids at a turn's end; parts in
    order of (block, part) are the conversation. A null text is empty, a null role is a role with an empty name, a null
    turn comes first; turns of one number are ordered by role and ids; null conversations are one conversation; repeated
    rows are repeated turns. Other columns are dropped. An empty table gives an empty table.
    """
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    turns = T.StructType([rows.schema["_conv"], rows.schema["_turn"], T.StructField("_role", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("loss", T.BinaryType())])

    def encode(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            ids, masks = [], []
            for r, t in zip(as_texts(batch.column(2)), as_texts(batch.column(3))):
                named = vocab.encode(escape(r)) if r not in ("user", "assistant", "system") else None
                joined, mask = assemble(*turn_segments(r, vocab.encode(escape(t)), named, vocab.base))
                ids.append(joined.tobytes())
                masks.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=turns.names)

    parts = T.StructType([T.StructField(conv, rows.schema["_conv"].dataType), T.StructField("block", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])

    def join(batches):
        key, part, ids, masks = None, 0, [], []

        def close():
            joined = pa.array(np.concatenate(ids).astype(np.int32))
            mask = pa.array(np.concatenate(masks))
            ends = pa.array([0, len(joined)], pa.int32())
            return pa.RecordBatch.from_arrays([key[0], key[1], pa.array([part], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(ends, joined), pa.ListArray.from_arrays(ends, mask)], names=parts.names)

        size = 0
        for batch in batches:
            convs, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (raw, bits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                here = (convs[i], blocks[i])
                if ids and (here != key[2] or size > part_tokens):
                    yield close()
                    part, ids, masks, size = (part + 1 if here == key[2] else 0), [], [], 0
                if not ids:
                    key = (batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), here)
                each = np.frombuffer(raw, dtype="<u4")
                ids.append(each)
                masks.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(each)).astype(bool))
                size += len(each)
        if ids:
            yield close()

    encoded = rows.mapInArrow(encode, turns).withColumn("_block", F.floor(F.col("_turn") / block))
    dealt = encoded.repartition("_conv", "_block").sortWithinPartitions("_conv", "_block", "_turn", "_role", "ids")
    return dealt.select("_conv", "_block", "ids", "loss").mapInArrow(join, parts)


def read_back(formatted: DataFrame, path: str, pattern: str, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the ids and masks.

    A digest of a whole conversation needs its parts in order, so they are shuffled by conversation and streamed: a part is
    the most that is held. turns_sha256 is of role, newline, text, newline for each turn; loss_* of what the mask covers.
    """
    out = T.StructType([formatted.schema[conv]] + list(struct_type(n_turns=T.LongType(), turns_sha256=T.StringType(), loss_chars=T.LongType(), loss_sha256=T.StringType(), formatted_chars=T.LongType())))

    def run(batches):
        vocab = vocabulary(path, pattern)
        roles = {INST: ("user", INST_END), SYS: ("system", SYS_END)}
        key = turns = None

        def close():
            return pa.RecordBatch.from_arrays([key[0], *[pa.array([x]) for x in (n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)]], names=out.names)

        for batch in batches:
            convs = batch.column(0).to_pylist()
            values, masks, ends = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            for i, c in enumerate(convs):
                if key is None or c != key[1]:
                    if key is not None:
                        yield close()
                    key, n, turns, loss, loss_chars, chars = (batch.column(0).slice(i, 1), c), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                ids, mask = values[ends[i] : ends[i + 1]], masks[ends[i] : ends[i + 1]]
                at, role, begin = np.flatnonzero(ids >= vocab.base).tolist(), None, 0
                for p in at:
                    control = int(ids[p]) - vocab.base
                    chars += len(CONTROLS[control])
                    if control in (INST_END, SYS_END, EOS, ROLE_END):
                        written = vocab.decode(ids[begin:p])
                        chars += len(written)
                        if control == ROLE_END:
                            role = unescape(written)
                        else:
                            role = "assistant" if role is None else role
                            body = unescape(written)
                            turns.update(f"{role}\n{body}\n".encode())
                            n += 1
                            covered = mask[begin:p]
                            if covered.any():
                                trained = unescape(vocab.decode(ids[begin:p][covered]))
                                loss.update(trained.encode())
                                loss_chars += len(trained)
                            role = None
                    elif control in roles:
                        role = roles[control][0]
                    begin = p + 1
        if key is not None:
            yield close()

    dealt = formatted.repartition(conv).sortWithinPartitions(conv, "block", "part")
    return dealt.select(conv, "input_ids", "loss_mask").mapInArrow(run, out)
