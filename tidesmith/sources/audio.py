"""Audio files and embedded audio as tables of signals."""

from __future__ import annotations

import base64
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.spectral import SAMPLE_RATE, resample


def decode_wav(data: bytes, sr: int = SAMPLE_RATE) -> np.ndarray:
    """Mono samples in [-1, 1]: channels are averaged first, then the rate is changed. PCM of 8, 16, 24 and 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return resample(x.reshape(-1, channels).mean(axis=1), rate, sr)


def encode_wav(x: np.ndarray, sr: int = SAMPLE_RATE, guard: bool = True) -> tuple[bytes, float]:
    """(PCM 16 file, gain): with `guard`, what would clip is scaled to a peak of 1."""
    x = np.asarray(x, float)
    peak = np.abs(x).max(initial=0)
    gain = 1 / peak if guard and peak > 1 else 1.0
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.clip(np.rint(x * gain * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue(), gain


def wav_base64(x: np.ndarray, sr: int = SAMPLE_RATE) -> str:
    return base64.b64encode(encode_wav(x, sr)[0]).decode()


def _decoded(df: DataFrame, content: str, sr: int) -> DataFrame:
    """df with samples and sr instead of the content; samples is null and error says why for what cannot be read."""
    rest = [f for f in df.schema if f.name != content]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            samples, errors = [], []
            for data in p.pop(content):
                try:
                    samples.append(decode_wav(bytes(data), sr))
                    errors.append(None)
                except (wave.Error, EOFError, TypeError, ValueError) as e:
                    samples.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield p.assign(sr=sr, samples=samples, error=errors)

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "sr int, samples array<double>, error string"]))


def scan(spark: SparkSession, path: str | list[str], pattern: str = "*.{wav,WAV,flac,FLAC}") -> DataFrame:
    """Files under the folders, recursively, each once, in order of path: path, length, modificationTime. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", "modificationTime").dropDuplicates(["path"]).orderBy("path")


def read_audio(spark: SparkSession, path: str | list[str], sr: int = SAMPLE_RATE, pattern: str = "*.{wav,WAV}", allow_empty: bool = False) -> DataFrame:
    """(path, sr, samples, error) of the audio files under the folders; none at all is an error unless allowed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if not allow_empty and files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} under {path}")
    return _decoded(files.select("path", "content"), "content", sr)


def embedded_audio(frame: DataFrame, id_fields: list[str], content: Column, text: Column, limit: int | None = None, seconds: tuple[float, float] = (3.0, 15.0), least_chars: int = 5) -> DataFrame:
    """(source_id, text, samples) of rows with audio inside: the first id field that is not null, of right duration and with enough text; unreadable rows are left out."""
    rows = frame.select(F.coalesce(*(F.col(c).cast("string") for c in id_fields)).alias("source_id"), text.alias("text"), content.alias("content"))
    rows = rows.filter(F.col("content").isNotNull() & (F.length(F.regexp_replace("text", r"(?U)\s", "")) >= least_chars))
    seconds_of = F.size("samples") / SAMPLE_RATE
    good = _decoded(rows, "content", SAMPLE_RATE).filter("error IS NULL").filter(seconds_of.between(*seconds)).select("source_id", "text", "samples")
    return good if limit is None else good.limit(limit)


def to_files(df: DataFrame, samples: str = "samples") -> DataFrame:
    """df with `content` (a WAV file) and `gain` instead of the samples: a table of files, which any sink can hold."""
    rest = [f for f in df.schema if f.name != samples]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = [encode_wav(x) for x in p.pop(samples)]
            yield p.assign(content=[d for d, _ in done], gain=[g for _, g in done])

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "content binary, gain double"]))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
