"""Quality rules: repetition inside a text, found with a suffix array over its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import BLANKS, add_columns, as_bytes, struct_type

SYMBOLS = b"#*$%&|<>"

FIELDS = struct_type(
    n_words=T.LongType(),
    word_chars=T.LongType(),
    n_symbols=T.LongType(),
    n_dup_lines=T.LongType(),
    n_repeat_words=T.LongType(),
    repeat_chars=T.LongType(),
    longest_repeat=T.LongType(),
    n_repeats=T.LongType(),
    repeats=T.ArrayType(struct_type(start=T.IntegerType(), words=T.IntegerType(), times=T.IntegerType())),
)


def repeated_windows(words: list[bytes], size: int) -> np.ndarray:
    """Starts of the windows of so many words whose hash occurs twice: all that a repeat of that length can start at."""
    n = len(words) - size + 1
    if n < 2:
        return np.empty(0, np.int64)
    each = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    sums = each[:n].copy()
    for k in range(1, size):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    ordered = np.sort(sums)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty(0, np.int64)
    found = np.minimum(np.searchsorted(twice, sums), len(twice) - 1)
    return np.flatnonzero(twice[found] == sums)


def heads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of keys, the first key being the most significant, and where the rows equal to each begin in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def suffix_array(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order, and the common prefix of each with the one before, in words.

    starts must hold every suffix that shares size words with another. Prefix doubling: all suffixes are ranked by size
    words, those at starts then by twice as many, and so on. A rank is the number of suffixes before, so that the suffixes
    that share no window keep theirs.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.full(size, -1)])
    order, head = heads(*[padded[k : k + n] for k in range(size)])
    rank = np.full(n + 1, -1)
    rank[order] = head
    levels, span = [rank], size
    while span < n:
        now, after = rank[starts], rank[np.minimum(starts + span, n)]
        order, head = heads(now, after)
        first = np.maximum.accumulate(np.where(np.append(True, now[order][1:] != now[order][:-1]), np.arange(len(order)), 0))
        rank = rank.copy()
        rank[starts[order]] = now[order] + head - first
        levels.append(rank)
        span *= 2
        if (np.diff(head) > 0).all():
            break
    order = starts[np.argsort(rank[starts], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += (size << k) * ((levels[k][x] == levels[k][y]) & (x < n) & (y < n))
    alike = np.ones(len(a), bool)
    for _ in range(size - 1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        alike &= (padded[x] == padded[y]) & (x < n) & (y < n)
        common += alike
    return order, np.concatenate([[0], common])


def maximal_repeats(ids: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, words, times) of each repeat that neither a word before nor a word after prolongs at all its places: the
    intervals of the common prefixes whose suffixes do not all follow the same word. Linear: an interval's first place is
    carried along with it."""
    before = np.where(order > 0, ids[order - 1], -1 - np.arange(len(order)))
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist()
    places, out, open_ = order.tolist(), [], []
    for i, height in enumerate([*common[1:].tolist(), 0], 1):
        left, first = i - 1, places[i - 1]
        while open_ and open_[-1][0] > height:
            tall, left, begun = open_.pop()
            first = min(first, begun)
            if tall >= least and turns[i - 1] > turns[left]:
                out.append((first, tall, i - left))
        if not open_ or open_[-1][0] < height:
            open_.append((height, left, first))
        else:
            open_[-1] = (height, open_[-1][1], min(first, open_[-1][2]))
    return sorted(out)


def repetition(words: list[bytes], least: int) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """The places of the words that lie in repeats of at least so many words, the longest repeat in words, and the maximal
    repeats. A suffix's tallest interval has the longer of the prefixes it shares with its neighbours; the union of these is
    that of all places of all repeats."""
    starts = repeated_windows(words, least)
    if not len(starts):
        return starts, 0, []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    order, common = suffix_array(ids, starts, least)
    most = np.maximum(common, np.append(common[1:], 0))
    edges = np.zeros(len(words) + 1, np.int64)
    long = most >= least
    np.add.at(edges, order[long], 1)
    np.add.at(edges, order[long] + most[long], -1)
    found = maximal_repeats(ids, order, common, least)
    return np.flatnonzero(np.cumsum(edges) > 0), max((w for _, w, _ in found), default=0), found


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x and not x.isspace()]
    return len(worded) - len(set(worded))


def measure(df: DataFrame, text: str = "text", least: int = 5, carry: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat, n_repeats and repeats.

    Words are the runs of anything but the six ASCII blanks. Repeats are stretches of at least `least` words found twice or
    more in the same text; n_repeat_words is the union of all their places, repeat_chars the code points of its words, and
    `repeats` lists the maximal ones (start in words, words, times), longest_repeat being the longest. A null or empty text has no words and counts 0 throughout. Rows
    are taken one by one, so repeated rows and ids and null ids pass through; an input column of a new column's name (in
    any case) is replaced. Nothing is shuffled; memory is that of one Arrow batch and one text.
    """
    at = df.columns.index(text)

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = as_bytes(batch.column(at))
            chars = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            rows = []
            for b, c in zip(texts, chars):
                words = b.split()
                covered, longest, found = repetition(words, least)
                size, inside = len(b), sum(len(words[i].decode(errors="replace")) for i in covered.tolist())
                rows.append((len(words), c - size + len(b.translate(None, BLANKS)), size - len(b.translate(None, SYMBOLS)), duplicate_lines(b), len(covered), inside, longest, len(found), [{"start": s, "words": w, "times": t} for s, w, t in found]))
            columns = list(zip(*rows))
            return [pa.array(x, pa.int64()) for x in columns[:-1]] + [pa.array(columns[-1], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("times", pa.int32())])))]

        return work

    return add_columns(df, FIELDS, start, carry)


def judge(df: DataFrame, text: str = "text", max_covered: float = 0.15, max_longest: int = 50, min_words: int = 10, carry: list[str] | None = None) -> DataFrame:
    """measure() with base_failed and kept.

    base_failed: under min_words words, or over a fifth of the words in repeats. kept: not base_failed, repeats cover at
    most max_covered of the code points of all words, and none is longer than max_longest words. An empty text fails.
    """
    out = measure(df, text, carry=carry).drop("base_failed", "kept")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (F.col("repeat_chars") <= max_covered * F.col("word_chars")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that judge() keeps, with df's own columns."""
    judged = judge(df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select(F.col(text).alias("_text"), "_row"), "_text", carry=["_row"])
    return judged.where("kept").select("_row.*")
