"""WAV bytes, rates and utterances."""

import io
import math
import random
import wave

from pyspark.sql import functions as F

from lexquarry.functions import audio


def test_wav_round_trip(spark):
    samples = [0.0, 1.0, -1.0, 0.5, -0.5, 2.0, -3.0, 1e-9, None]
    df = spark.createDataFrame([(samples,), ([],), (None,)], "x array<double>").withColumn("wav", audio.wav(F.col("x"), F.lit(16000)))
    rows = df.select("wav", audio.wav_read("wav").alias("r")).collect()
    with wave.open(io.BytesIO(bytes(rows[0].wav))) as f:  # the standard library reads it as well
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (1, 2, 16000, 9)
    assert rows[0].r.rate == 16000 and [round(x, 3) for x in rows[0].r.samples] == [0, 1, -1, 0.5, -0.5, 1, -1, 0, 0]
    assert len(rows[1].wav) == 44 and rows[1].r.samples == [] and rows[2].wav is None
    bad = spark.createDataFrame([(bytearray(b"RIFF"),), (bytearray(rows[0].wav[:50]),), (bytearray(b"x" * 60),), (None,)], "wav binary")
    assert [r[0] for r in bad.select(audio.wav_read("wav")).collect()] == [None] * 4


def test_resampled(spark):
    def plain(x, a, b):
        if b >= a:
            return x
        ratio = a / b
        out = []
        for i in range(math.floor(len(x) / ratio)):
            start, end = math.floor(i * ratio), min(len(x), math.floor((i + 1) * ratio))
            out.append(sum(x[start:end]) / max(1, end - start))
        return out

    draw = random.Random(1)
    cases = [([draw.uniform(-1, 1) for _ in range(n)], a, b) for n in (0, 1, 2, 7, 480, 481) for a, b in ((48000, 44100), (48000, 16000), (44100, 16000), (8000, 16000), (16000, 16000), (48000, 7))]
    for b in {c[2] for c in cases}:
        own = [c for c in cases if c[2] == b]
        df = spark.createDataFrame([(i, x, a) for i, (x, a, _) in enumerate(own)], "i int, x array<double>, a int")
        got = {r.i: r.y for r in df.select("i", audio.resampled(F.col("x"), F.col("a"), b).alias("y")).collect()}
        for i, (x, a, _) in enumerate(own):
            want = plain(x, a, b)
            assert len(got[i]) == len(want) and all(abs(p - q) < 1e-12 for p, q in zip(got[i], want)), (a, b, len(x))


def test_spoken(spark):
    """Pre-roll with the frame of the start; frames of both streams apart; short and unfinished ones left out."""
    frames = spark.createDataFrame([(s, n, [n * 1.0, n + 0.5]) for s in "ab" for n in range(1, 200)], "s string, n long, x array<double>")
    signals = spark.createDataFrame([("a", 5, "start"), ("a", 20, "end"), ("a", 25, "start"), ("a", 150, "end"), ("a", 190, "start"), ("b", 100, "start"), ("b", 101, "end")], "s string, n long, signal string")
    got = {(r.s, r.start, r.end): r.samples for r in audio.spoken(frames, signals, "s", "n", "x", rate=4, least=6.0, bucket=16).collect()}
    assert set(got) == {("a", 5, 20), ("a", 25, 150)}  # 20 and 135 frames of half a second; b has eleven
    assert got["a", 5, 20] == [v for n in range(1, 21) for v in (n * 1.0, n + 0.5)]
    assert got["a", 25, 150] == [v for n in range(16, 151) for v in (n * 1.0, n + 0.5)]
