"""Sample blocks as arrays: levels, averages, blocks of a fixed size."""

from __future__ import annotations

from struct import calcsize, pack, unpack_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 without samples."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples))).otherwise(0.0)


def downsampled(samples: Column, factor: int) -> Column:
    """Means of `factor` neighbours; a rest that does not fill one is dropped."""
    count = F.floor(F.size(samples) / factor).cast("int")
    means = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.aggregate(F.slice(samples, i * factor + 1, factor), F.lit(0.0), lambda a, x: a + x.cast("double")) / factor)
    return F.when(count > 0, means).otherwise(F.array().cast("array<double>"))


def pcm16(samples: Column) -> Column:
    """Samples between -1 and 1 (clamped) as 16-bit numbers, cut toward 0; -1 is -32768 and 1 is 32767."""
    clamped = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double")))
    return F.transform(samples, lambda x: (clamped(x) * F.when(x < 0, 32768).otherwise(32767)).cast("int"))


def resampled(samples: Column, from_rate: Column, to_rate: int) -> Column:
    """Samples at a lower rate, each the mean of those that fall on it: from floor(i * ratio) up to floor((i + 1) * ratio), whole or
    not; what does not fill the last one is dropped. At a rate that is not lower they stay."""
    ratio = from_rate.cast("double") / to_rate
    count = F.floor(F.size(samples) / ratio).cast("int")
    first = lambda i: F.floor(i * ratio).cast("int")

    def mean(i: Column) -> Column:
        end = F.least(F.size(samples), first(i + 1))
        part = F.slice(samples, first(i) + 1, F.greatest(end - first(i), F.lit(0)))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.lit(1), end - first(i))

    lower = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), mean)).otherwise(F.array().cast("array<double>"))
    return F.when(from_rate <= to_rate, samples.cast("array<double>")).otherwise(lower)


#: Fixed value: the head of a WAV file with one channel of 16-bit samples, little-endian.
HEAD = "<4sI4s4sIHHIIHH4sI"


@F.arrow_udf(T.BinaryType())
def _wav(samples: pa.Array, rates: pa.Array) -> pa.Array:
    out = []
    for values, rate in zip(samples, rates.to_pylist()):
        if not values.is_valid or rate is None:
            out.append(None)
            continue
        x = np.clip(pc.fill_null(values.values, 0.0).to_numpy(zero_copy_only=False), -1, 1)
        body = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
        out.append(pack(HEAD, b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body)
    return pa.array(out, pa.binary())


def wav(samples: Column, rate: Column) -> Column:
    """A WAV file as bytes: one channel, 16 bits, samples clamped to -1 and 1 and cut toward 0; a null sample is silence."""
    return _wav(samples.cast("array<double>"), rate.cast("int"))


@F.arrow_udf(T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.DoubleType()))]))
def wav_read(files: pa.Array) -> pa.Array:
    """(rate, samples) of WAV files as wav() writes them, samples between -1 and 1; null for any other bytes."""
    out = []
    for data in files.to_pylist():
        head = unpack_from(HEAD, data) if data is not None and len(data) >= calcsize(HEAD) else None
        if head is None or (head[0], head[2], head[5], head[6], head[10], head[11]) != (b"RIFF", b"WAVE", 1, 1, 16, b"data") or len(data) < calcsize(HEAD) + head[12]:
            out.append(None)
            continue
        x = np.frombuffer(data, "<i2", head[12] // 2, calcsize(HEAD)).astype(float)
        out.append({"rate": head[7], "samples": np.where(x < 0, x / 32768, x / 32767).tolist()})
    return pa.array(out, pa.struct([("rate", pa.int32()), ("samples", pa.list_(pa.float64()))]))


def spoken(frames: DataFrame, signals: DataFrame, stream: str, seq: str, samples: str, rate: int, preroll: int = 10, least: float = 0.5, bucket: int = 64) -> DataFrame:
    """(stream, start, end, samples): utterances from numbered frames and the signals (stream, seq, signal) of voice activity.

    Each runs from the last `preroll` frames at its start to its end, both with their frames; one without an end is left out, as is
    one under `least` seconds. Frames meet the utterances that cover their bucket of numbers by equality, then by range, so no
    stream is sorted or gathered; an utterance's frames are, which voice activity bounds.
    """
    following = Window.partitionBy(stream).orderBy(seq)
    ends = signals.withColumn("end", F.when(F.lead("signal").over(following) == "end", F.lead(seq).over(following))).where((F.col("signal") == "start") & F.col("end").isNotNull())
    first = F.col(seq) - (preroll - 1)
    spans = ends.select(F.col(stream).alias("_stream"), F.col(seq).alias("start"), "end", first.alias("_first"), F.explode(F.sequence(F.floor(first / bucket), F.floor(F.col("end") / bucket))).alias("_bucket"))
    held = frames.select(stream, F.col(seq).alias("_seq"), F.col(samples).alias("_x"), F.floor(F.col(seq) / bucket).alias("_bucket"))
    met = held.join(spans, (F.col(stream) == F.col("_stream")) & (held["_bucket"] == spans["_bucket"]) & F.col("_seq").between(F.col("_first"), F.col("end")))
    whole = met.groupBy(stream, "start", "end").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_x"))), lambda s: s["_x"])).alias("samples"))
    return whole.where(F.size("samples") >= least * rate)


def reblocked(frames: DataFrame, stream: str, seq: str, samples: str, size: int = 2048) -> DataFrame:
    """(stream, block, samples): the samples of each stream in blocks of one size, the last one short.

    A frame's first sample number is the sum of the lengths before it, so samples are dealt by their block and no stream
    is gathered as a whole.
    """
    before = F.sum(F.size(samples)).over(Window.partitionBy(stream).orderBy(seq)) - F.size(samples)
    placed = frames.select(stream, before.alias("_from"), samples).select(stream, "_from", F.posexplode(samples).alias("_i", "_x"))
    numbered = placed.select(stream, F.floor((F.col("_from") + F.col("_i")) / size).alias("block"), (F.col("_from") + F.col("_i")).alias("_n"), "_x")
    return numbered.groupBy(stream, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda s: s["_x"]).alias("samples"))
