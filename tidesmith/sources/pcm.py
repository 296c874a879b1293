"""WAV files as Python data sources: `pcm` reads them in parts, `paced_pcm` plays them back as live sessions.

    spark.dataSource.register(Pcm); spark.read.format("pcm").load(folder)
    spark.dataSource.register(PacedPcm); spark.readStream.format("paced_pcm").load(folder)

`pcm` gives a row for each piece of `frames_per_row` frames: path, sample_rate,
channels, frames and duration_s of its file, the place of its first frame, and
the samples, channels averaged. A file is split into byte ranges of `part_bytes`,
which tasks read at once; small files share a task. Filters on the path are
applied to the list of files, those on what a header says before any samples are
read (with spark.sql.python.filterPushdown.enabled). A file that is no WAV file
is a row whose error says why. PCM of 8, 16, 24 and 32 bits and floats of 32 and
64; RF64 and data sizes left open are read to the end of the file. Paths may be
of any store that Arrow knows.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from ..streaming.sessions import CHUNKS

ROWS = "path string, sample_rate int, channels int, frames bigint, duration_s double, start bigint, samples array<float>, error string"
HEADER = ("sample_rate", "channels", "frames", "duration_s")


@dataclass(frozen=True)
class Layout:
    sample_rate: int
    channels: int
    bits: int
    floating: bool
    begin: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8

    @property
    def duration_s(self) -> float:
        return self.frames / self.sample_rate


def layout(file, size: int) -> Layout:
    """What the header of a WAV file says; only its chunks' heads are read."""
    riff = file.read_at(12, 0)
    if len(riff) < 12 or riff[:4] not in (b"RIFF", b"RF64") or riff[8:] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, long = 12, None, None
    while at + 8 <= size:
        head = file.read_at(8, at)
        name, n = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"ds64":
            long = struct.unpack("<Q", file.read_at(8, at + 16))[0]
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
            if kind == 0xFFFE:  # extensible: the kind is in the sub-format
                kind = struct.unpack("<H", file.read_at(2, at + 32))[0]
            if kind not in (1, 3) or bits not in ((8, 16, 24, 32) if kind == 1 else (32, 64)) or not channels or not rate:
                raise ValueError(f"format {kind} of {bits} bits is not supported")
            form = rate, channels, bits, kind == 3
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            n = long if n == 0xFFFFFFFF and long else size - at - 8 if n in (0, 0xFFFFFFFF) else n
            return Layout(*form, at + 8, min(n, size - at - 8) // (form[1] * form[2] // 8))
        at += 8 + n + n % 2
    raise ValueError("no data")


def samples_of(raw: bytes, form: Layout) -> np.ndarray:
    """Mono samples in [-1, 1] of whole frames."""
    if form.floating:
        x = np.frombuffer(raw, f"<f{form.bits // 8}").astype(float)
    elif form.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif form.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{form.bits // 8}") / float(1 << (form.bits - 1))
    return x.reshape(-1, form.channels).mean(axis=1)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the WAV files under a folder, recursively, or of one file, in order."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = store.get_file_info(place)
    found = store.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == place or f.path.lower().endswith(".wav")))


def opened(path: str):
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


#: What each kind of filter asks of a value.
TESTS = {
    ds.EqualTo: lambda v, x: v == x, ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x, ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x, ds.StringStartsWith: lambda v, x: v.startswith(x), ds.StringEndsWith: lambda v, x: v.endswith(x), ds.StringContains: lambda v, x: x in v,
}


@dataclass
class Parts(ds.InputPartition):
    """(path, file size, first byte, byte behind the last) of the pieces of one task."""

    parts: list[tuple[str, int, int, int]]


class PcmReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.part_bytes, self.row_frames = int(options.get("part_bytes", 64 << 20)), int(options.get("frames_per_row", 1 << 16))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) is ds.IsNotNull and name == "path":
                continue
            if type(f) in TESTS and (name == "path" or name in HEADER):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def _passes(self, held: dict) -> bool:
        return all(TESTS[kind](held[name], x) for name, kind, x in self.tests if name in held)

    def partitions(self) -> list[Parts]:
        out, now, size = [], [], 0
        for path, n in listed(self.path):
            if not self._passes({"path": path}):
                continue
            for a in range(0, max(n, 1), self.part_bytes):
                z = min(a + self.part_bytes, n)
                if now and size + z - a > self.part_bytes:
                    out.append(Parts(now))
                    now, size = [], 0
                now.append((path, n, a, z))
                size += z - a
        return [*out, Parts(now)]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration_s", pa.float64()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
        for path, size, a, z in partition.parts:
            with opened(path) as file:
                try:
                    form = layout(file, size)
                except (ValueError, struct.error) as e:
                    if a == 0 and not any(name in HEADER for name, *_ in self.tests):  # nothing is known of it, so no test on its header is met
                        yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema)
                    continue
                if not self._passes({name: getattr(form, name) for name in HEADER}):
                    continue
                # the frames that begin in this range
                first, behind = (min(max(-(-(x - form.begin) // form.frame_bytes), 0), form.frames) for x in (a, z))
                for at in range(first, behind, self.row_frames):
                    n = min(self.row_frames, behind - at)
                    x = samples_of(file.read_at(n * form.frame_bytes, form.begin + at * form.frame_bytes), form)
                    fixed = [[path], [form.sample_rate], [form.channels], [form.frames], [form.duration_s], [at]]
                    samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(fixed, schema, strict=False)), samples, pa.array([None], pa.string())], schema=schema)


class Pcm(ds.DataSource):
    """Options: path; part_bytes (64 MB) of a task; frames_per_row (65,536)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: T.StructType) -> PcmReader:
        return PcmReader(self.options)


class PacedReader(ds.SimpleDataSourceStreamReader):
    """Offsets are numbers of chunks. A read gives the chunks that have come due since the last one, so a restarted stream goes on where it was, at the pace of the clock, and one that fails half-way gives the same chunks again."""

    def __init__(self, options: dict) -> None:
        self.path, self.chunk, self.speed = options["path"], int(options.get("chunk", 1280)), float(options.get("speed", 1))
        self.loop, self.burst = str(options.get("loop", "true")).lower() == "true", int(options.get("burst", 64))
        self.files: list[tuple[str, int, Layout]] = []
        self.last: float | None = None

    def _open(self) -> None:
        if not self.files:
            for path, size in listed(self.path):
                with opened(path) as file:
                    self.files.append((path, size, layout(file, size)))

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def _count(self, form: Layout) -> int:
        return -(-form.frames // self.chunk)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._open()
        now = time.monotonic()
        if self.last is None:
            self.last = now
        period = self.chunk / max((form.sample_rate for *_, form in self.files), default=16_000)
        due = self.burst if self.speed <= 0 else min(int((now - self.last) * self.speed / period), self.burst)
        self.last = now if self.speed <= 0 or due == self.burst else self.last + due * period / self.speed
        end = start["chunk"] + due
        if not self.loop:
            end = max(start["chunk"], min(end, max((self._count(form) for *_, form in self.files), default=0)))
        return self.readBetweenOffsets(start, {"chunk": end}), {"chunk": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        self._open()
        out = []
        for path, _, form in self.files:
            count = self._count(form)
            with opened(path) as file:
                for k in range(start["chunk"], end["chunk"]):
                    if not count or not self.loop and k >= count:
                        break
                    at = k % count * self.chunk
                    n = min(self.chunk, form.frames - at)
                    x = samples_of(file.read_at(n * form.frame_bytes, form.begin + at * form.frame_bytes), form)
                    out.append((path, k, np.pad(x, (0, self.chunk - n)).astype(np.float32).tolist(), None))
        return iter(out)

    def commit(self, end: dict) -> None:
        pass


class PacedPcm(ds.DataSource):
    """Each file is a session of chunks (session, seq, pcm, control), as a microphone would send them; the last chunk of a file is padded with zeros.

    Options: path; chunk (1280 samples); loop (true); speed (1: real time; 0: as
    fast as they are read); burst (64): most chunks of a read, what the clock has
    beyond that is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "paced_pcm"

    def schema(self) -> str:
        return CHUNKS

    def simpleStreamReader(self, schema: T.StructType) -> PacedReader:
        return PacedReader(self.options)
