"""Toxicity: a support vector machine over a gap-tolerant subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import add_columns, as_texts, fold, give_back, sliced, struct_type

#: Mark the start of a word, so that its first letters count for more, and its end, so that a stem alone differs from a
#: longer word that begins with it.
START, END = "^^", "$"
WINDOW, STEP = 32, 16
TOPS, LIMIT = 3, 4.0
SPELLED = re.compile(r"(?<!\S)\w(?:\W?\s+\w(?![^\s\W])){3,}")


def letters(word: str) -> str:
    """A word's letters and digits, so that signs put between them do not count."""
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def units(word: str) -> list[str]:
    """What is scored for one word: the word between START and END, in windows where it is long."""
    word = START + letters(word) + END
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - STEP, STEP)]


def words_of(text: str) -> list[str]:
    """Lower-cased words, and words spelled out letter by letter put together."""
    text = text.lower()
    return text.split() + [letters(m[0]) for m in SPELLED.finditer(text)]


class SubsequenceKernel:
    """Counts common subsequences of n characters, each place weighted by decay for every character it skips.

    The kernel of two words is divided by what words of their lengths, up to `level`, would have with themselves were all
    their characters different; so a long word that holds a short one keeps most of its likeness.
    """

    def __init__(self, n: int = 4, decay: float = 0.6, level: int = 8):
        self.n, self.decay, self.level = n, decay, level
        self.own = np.ones(level + 1)
        for k in range(n, level + 1):
            text = "".join(map(chr, range(97, 97 + k)))
            self.own[k] = self._raw(self.codes([text]), text)[0]

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """A row of code points for each word, filled up with zeros."""
        width = max(map(len, words), default=0)
        return np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(words), -1) if width else np.zeros((len(words), 0), np.uint32)

    def _raw(self, codes: np.ndarray, other: str) -> np.ndarray:
        """The kernel of each row with one word: Lodhi's recursion, for all rows at once. Rows come by rising length; those
        that have ended take no part in further steps."""
        rows, n, decay, width = len(codes), self.n, np.float32(self.decay), len(other)
        total = np.zeros(rows, np.float32)
        # part[i][j]: weights of the subsequences of i characters in what is read of the rows and in other[:j], up to their ends
        part = np.zeros((n, width + 1, rows), np.float32)
        part[0] = 1
        lengths = (codes != 0).sum(axis=1)
        run, more = np.empty(rows, np.float32), np.empty(rows, np.float32)
        for k, first in enumerate(np.searchsorted(lengths, np.arange(codes.shape[1]), side="right").tolist()):
            if first == rows:
                break
            now = codes[first:, k]
            each = {c: (now == ord(c)).astype(np.float32) for c in set(other)}
            hits = [each[c] for c in other]
            here, sums, r, m = part[:, :, first:], total[first:], run[first:], more[first:]
            for j in range(n - 1, width):
                sums += np.multiply(hits[j], here[n - 1, j], out=m)
            for i in range(min(n - 1, k + 1), 0, -1):  # no subsequence is longer than what is read
                r.fill(0)
                for j in range(i, width + 1):
                    r *= decay
                    r += np.multiply(hits[j - 1], here[i - 1, j - 1], out=m)
                    at = here[i, j]
                    at *= decay
                    at += r
        return total

    def against(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark. Words that lack over a third of its letters count as unlike: 0."""
        out = np.zeros((len(words), len(landmarks)), np.float32)
        own = [Counter(mark) for mark in landmarks]
        # a letter that occurs k times is held once for each number up to k, so what two words share is a matrix product
        times = sorted({(c, k) for held in own for c, n in held.items() if c not in START + END for k in range(1, n + 1)})
        wanted = np.array([[held[c] >= k for held in own] for c, k in times], np.float32).reshape(len(times), len(landmarks))
        letters = {c: i for i, c in enumerate(sorted({c for c, _ in times}), 1)}
        kind = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        kind[[ord(c) for c in letters]] = list(letters.values())
        least = np.array([-(-2 * len(mark.strip(START + END)) // 3) for mark in landmarks])
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            codes = self.codes([words[i] for i in some])
            if codes.shape[1] < self.n:
                continue
            sizes = np.fromiter((len(words[i]) for i in some), np.int64, len(some))
            scale = np.sqrt(self.own[np.minimum(sizes, self.level)])
            filled = codes != 0
            each = kind[np.minimum(codes[filled], len(kind) - 1)] + np.repeat(np.arange(len(some)) * (len(letters) + 1), filled.sum(axis=1))
            counts = np.bincount(each, minlength=len(some) * (len(letters) + 1)).reshape(len(some), -1)
            held = np.array([counts[:, letters[c]] >= k for c, k in times], np.float32).reshape(len(times), len(some))
            alike = held.T @ wanted >= least
            for j, mark in enumerate(landmarks):
                can = np.flatnonzero(alike[:, j])
                if len(can):
                    out[some[can], j] = self._raw(codes[can], mark) / (scale[can] * np.sqrt(self.own[min(len(mark), self.level)]))
        return out


@dataclass
class Model:
    """margin = kernel(word, landmarks) @ weights + bias; a text's chance comes from its words' (see tops).

    alone: for each landmark, the margin at which one word that is likest to it is enough."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float
    alone: np.ndarray
    n: int = 4
    decay: float = 0.6

    def chances(self, best: np.ndarray) -> np.ndarray:
        """Of texts, from their tops: from all of them together, or from one word that is enough alone (0 or more over)."""
        return 1 / (1 + np.exp(-np.clip(np.maximum(np.minimum(best[:, :TOPS], 2.0) @ self.slopes + self.shift, 4 * best[:, TOPS]), -30, 30)))

    def margins(self, kernel: SubsequenceKernel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, and how far it is over what is enough alone."""
        parts = [units(w) for w in words]
        if not parts:
            return np.empty(0), np.empty(0)
        rows = kernel.against([u for p in parts for u in p], self.landmarks)
        each = rows @ self.weights + self.bias
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        return np.maximum.reduceat(each, begins), np.maximum.reduceat(each - self.alone[rows.argmax(axis=1)], begins)


def tops(words) -> list[float]:
    """Of the (margin, excess) of a text's words: the TOPS largest different margins, held between -LIMIT and LIMIT, and the
    largest excess; -LIMIT for what there is not."""
    words = list(words)
    best = nlargest(TOPS, {m for m, _ in words})
    return [min(max(m, -LIMIT), LIMIT) for m in best] + [-LIMIT] * (TOPS - len(best)) + [max((e for _, e in words), default=-LIMIT)]


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int, plain: int, least: int = 3) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that mark toxic texts: in `least` of them, three times as often as in others, and oftener
    than chance would give to any of so many; the longest of those that occur alike, none the beginning of another. And
    words of the other texts: for each mark the commonest that begins with it, then common ones."""

    def starts(words: set[str]) -> set[str]:
        return {u[0][:k] for u in map(units, words) for k in (5, 6, 7, 8, 9, len(u[0])) if 5 <= k <= len(u[0])}

    counts, usual = Counter(), Counter()
    alone = {tuple(sorted(crc32(w.encode()) for w in t)[:2]): t for t in toxic}  # one of each group of near copies
    for t in alone.values():  # one at a time: the beginnings of all texts would take far more room than their counts
        counts.update(starts(t))
    likely = {s for s, c in counts.items() if c >= least}
    for c in clean:
        usual.update(starts(c) & likely)
    ratio, share = len(alone) / len(clean), len(alone) / (len(alone) + len(clean))

    def surprise(k: int, others: int) -> float:
        """Chernoff's bound on the chance that so many of the texts with a word are toxic, as a negative logarithm."""
        n = k + others
        return k * log(k / n / share) + (others * log(others / n / (1 - share)) if others else 0)

    gain = {s: counts[s] - 3 * ratio * usual[s] for s in likely if counts[s] > 3 * ratio * usual[s] and surprise(counts[s], usual[s]) > log(10 * len(likely))}
    step = max(1, len(alone) / 50)
    marks: list[str] = []
    for s in sorted(gain, key=lambda s: (-round(gain[s] / step), -len(s), s)):
        if len(marks) < most and not any(s.startswith(m) or m.startswith(s) for m in marks):
            marks.append(s)
    common = Counter(u for c in clean for w in c if len(w) >= 3 for u in units(w)[:1])
    ordered = [s for s, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if s not in marks]
    near = [next((s for s in ordered if s.startswith(m)), None) for m in marks]
    return marks, list(dict.fromkeys([s for s in near if s] + [s for s in ordered[: plain + len(marks)] if len(s) <= 10][:plain]))


#: Stand for letters that a word does not have: in words that are toxic, and in words that are not.
PUT_IN, BESIDE = "\u00b7", "\u00a4"


def gapped(word: str, usual: str = "") -> list[str]:
    """The word with a foreign sign, and with each of the usual letters, put in at each place after its first letter."""
    inside = range(len(START) + 1, len(word) + (not word.endswith(END)))
    return [word[:i] + c + word[i:] for i in inside for c in (PUT_IN, *usual)]


def beside(mark: str, sign: str) -> list[str]:
    """Words that hold a whole word but are others: it after one or two letters, before two or three, and without its first,
    or with another in its place."""
    inner = mark[len(START) : -len(END)]
    return [START + x + END for x in (sign + inner, inner + 2 * sign, 2 * sign + inner, inner + 3 * sign, inner[1:], sign + inner[1:])]


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights, the last being the bias, of a linear support vector machine, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(rounds):
        on = y * (x @ w) < 1
        some, each = x[on], cost[on].astype(x.dtype)
        new = np.linalg.solve(keep + (some * each[:, None]).T @ some, some.T @ (each * y[on].astype(x.dtype)))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none below 0.05) and shift that turn a text's largest margins into its chance, with the counts' own smoothing
    of the targets."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.append(np.ones(x.shape[1] - 1), 0.0)
    first = w.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - target) + 1e-2 * (w - first))
        w = w - np.clip(step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0.05)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str], labels: list[int], most_landmarks: int = 200, plain_landmarks: int = 4, cost: float = 40.0, rounds: int = 4, strays: float = 0.001, least_alone: float = 0.15) -> Model:
    """Multiple-instance training: a toxic text has at least one toxic word, its witness; other texts have none.

    Witnesses begin as the words that begin with a landmark and no other text has; then in turn a machine is fitted to the
    witnesses, and to them with a gap at each place, against all words of the other texts, and the witnesses are chosen
    anew: those still on the right side and the best of each text. A text's chance is fitted to its largest margins; the
    share `strays` of the other texts has a word that would be enough alone. Without texts of both labels, nothing is toxic.
    """
    model, kernel = Model([START + "none"], np.zeros(1), -1.0, np.ones(TOPS), -1.0, np.ones(1)), SubsequenceKernel()
    one: dict[str, str] = {}
    bags = [({one.setdefault(w, w) for w in map(letters, words_of(t))} - {""}, y) for t, y in zip(texts, labels)]
    toxic, clean = [b for b, y in bags if y and b], [b for b, y in bags if not y and b]
    if not toxic or not clean:
        return model
    marks, plain = choose_landmarks(toxic, clean, most_landmarks, plain_landmarks)
    if not marks:
        return model
    whole = [m for m in marks if m.endswith(END)]
    plain += [START + BESIDE + m[len(START) :] for m in whole]
    usual = "".join(c for c, _ in Counter(c for b in clean for w in b for c in w).most_common(3))
    vocabulary = sorted(set().union(*toxic, *clean))
    place = {w: i for i, w in enumerate(vocabulary)}
    owner, parts = zip(*[(i, u) for i, w in enumerate(vocabulary) for u in units(w)])
    rows = np.zeros((len(vocabulary), len(marks) + len(plain)), np.float32)
    np.maximum.at(rows, np.array(owner), kernel.against(list(parts), marks + plain))
    values, vectors = np.linalg.eigh(kernel.against(marks + plain, marks + plain).astype(np.float64))
    root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
    inside = [np.fromiter((place[w] for w in b), np.int64, len(b)) for b in toxic]
    others = np.unique(np.concatenate([np.fromiter((place[w] for w in b), np.int64, len(b)) for b in clean]))
    strange = [b for m in whole for b in beside(m, BESIDE)]
    # words hardly like any landmark are all as one
    negatives = np.vstack([rows[others[rows[others].max(axis=1) > 0.1]] @ root, np.zeros((1, rows.shape[1]), np.float32), kernel.against(strange, marks + plain) @ root])
    heavy = np.append(np.ones(len(negatives) - len(strange)), np.full(len(strange), len(toxic) / 100))
    seen = np.zeros(len(vocabulary), bool)
    seen[others] = True
    marked = np.array([any(u.startswith(m) for u in units(w) for m in marks) for w in vocabulary]) & ~seen
    margins = np.where(marked, 1.0, rows[:, : len(marks)].max(axis=1) - 1)
    for _ in range(rounds):
        best, times = np.unique(np.concatenate([np.append(bag[marked[bag] & (margins[bag] > 0)], bag[np.argmax(margins[bag])]) for bag in inside]), return_counts=True)
        own = ~seen[best] if (~seen[best]).any() else np.ones(len(best), bool)
        best, times = best[own], times[own]
        variants = [gapped(units(vocabulary[i])[0][: WINDOW // 2], usual) for i in best]
        shares = [t / max(1, len(v)) for t, v in zip(times, variants) for _ in v]
        positives = np.vstack([rows[best] @ root, kernel.against([g for v in variants for g in v], marks + plain) @ root])
        x = np.vstack([positives, negatives])
        y = np.append(np.ones(len(positives)), -np.ones(len(negatives)))
        weight = np.append(times, shares)
        w = squared_hinge(x, y, cost * np.append(weight, heavy))
        margins = rows @ (root @ w[:-1]).astype(np.float32) + np.float32(w[-1])
    # a word that is likest to no mark is never enough alone
    likest, alone = rows.argmax(axis=1), np.full(rows.shape[1], 2 * LIMIT)
    free = [np.fromiter((place[v] for v in b), np.int64, len(b)) for b in clean]
    for m in range(len(marks)):
        most = np.array([margins[b[likest[b] == m]].max(initial=-LIMIT) for b in free])
        alone[m] = max(least_alone, float(np.quantile(most, 1 - strays)))
    excess = margins - alone[likest]
    at_text = np.array([tops(zip(margins[b].tolist(), excess[b].tolist())) for b in inside + free])
    of = np.array([1] * len(inside) + [0] * len(free))
    slopes, shift = logistic(np.minimum(at_text[:, :TOPS], 2.0), of)
    return Model(marks + plain, root @ w[:-1], float(w[-1]), slopes, shift, alone)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, per_label: int = 2000, max_chars: int = 20_000) -> Model:
    """A model from at most per_label documents of each label (those of the least id hash), of at most max_chars each.

    Only rows whose crc32(id as text) mod folds is not 0 are used. Labels other than 0 and 1 and null ids are not used; an
    id that repeats counts each time, within the bound. The sample of ids is bounded, so it is broadcast.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id", folds) != 0)).distinct()
    some = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * per_label) for y in (0, 1)]
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some[0].union(some[1])), "_id").where(F.length("_text").between(1, max_chars))
    picked = [rows.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(per_label) for y in (0, 1)]
    got = picked[0].union(picked[1]).select("_text", "_label").collect()
    model = train([r[0] for r in got], [r[1] for r in got])
    del got
    give_back()  # the driver's process goes on to other work
    return model


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, most_known: int = 400_000) -> DataFrame:
    """Adds toxicity, between 0 and 1: from the most toxic words of the whole text. A null, empty or blank text has the score
    of a text without any toxic word. No shuffle; the words already scored are kept, and dropped when there are most_known."""
    at = df.columns.index(text)

    def start():
        kernel, known, alike = SubsequenceKernel(model.n, model.decay), {}, {}  # alike: each pair of margins once

        def margins(texts: list[str]) -> list[list[float]]:
            lists = [words_of(t) for t in texts]
            new = {w for ws in lists for w in ws if w not in known}
            if len(known) + len(new) > most_known:
                known.clear()
                alike.clear()
                new = {w for ws in lists for w in ws}
            bare = {letters(w) for w in new}
            bare = sorted(bare)
            got = {w: alike.setdefault(m, m) for w, m in zip(bare, zip(*(x.tolist() for x in model.margins(kernel, bare))))}
            known.update((w, got[letters(w)]) for w in new)
            return [tops(map(known.__getitem__, set(ws))) for ws in lists]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for some in sliced([batch]):
                texts, begin, size = as_texts(some.column(at)), 0, 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size > 500_000 or i + 1 == len(texts):
                        out += margins(texts[begin : i + 1])
                        begin, size = i + 1, 0
            return [pa.array(model.chances(np.array(out, np.float64).reshape(-1, TOPS + 1)))]

        return work

    return add_columns(df, struct_type(toxicity=T.DoubleType()), start, carry)


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose toxicity is below the threshold, with df's own columns."""
    rows = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select(F.col(text).alias("_text"), "_row")
    return score(rows, model, "_text", carry=["_row"]).where(F.col("toxicity") < threshold).select("_row.*")
