"""Live sessions as stateful streams: chunks of any length in, whole blocks out, one pipeline a session.

Chunks carry (session, seq, pcm, control). Within a micro-batch a session's
chunks are put in order by seq; chunks whose seq was passed are dropped and
counted. A control row replaces the configuration, and so the whole state, if
it changes anything; 'reset' clears it. The batch kernel and the stream share
their steps, so both give the same samples.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels.enhance import Pipeline
from ..kernels.spectral import DEFAULT, Framing

CHUNKS = "session string, seq bigint, pcm array<float>, control string"
BLOCKS = "session string, block bigint, samples array<double>, is_speech boolean, vad_prob double, gate double, late bigint"
CONFIG = {"method": "none", "gated": False}


def _timeout(idle_s: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_s else GroupStateTimeout.NoTimeout


class Session:
    """Re-chunking with a rest, and the pipeline behind it."""

    def __init__(self, f: Framing = DEFAULT, config: dict | None = None) -> None:
        self.f, self.config = f, CONFIG | (config or {})
        self.rebuild()
        self.next, self.late = 0, 0

    def rebuild(self) -> None:
        self.pipeline = Pipeline(self.config["method"], self.f, self.config["gated"])
        self.rest = np.empty(0)

    def control(self, text: str) -> None:
        asked = json.loads(text)
        if asked.get("op") == "reset":
            self.rebuild()
            return
        new = self.config | {k: v for k, v in asked.items() if k in CONFIG}
        if new != self.config:
            self.config = new
            self.rebuild()

    def feed(self, pcm: np.ndarray) -> list[tuple[np.ndarray, dict]]:
        x = np.concatenate([self.rest, np.asarray(pcm, float)])
        whole = len(x) // self.f.hop * self.f.hop
        self.rest = x[whole:]
        return self.pipeline.blocks(x[:whole])

    def dump(self) -> bytes:
        return pickle.dumps((self.config, self.rest, self.next, self.late, self.pipeline.dump()))

    @classmethod
    def load(cls, data: bytes, f: Framing = DEFAULT) -> Session:
        config, rest, seq, late, pipeline = pickle.loads(data)
        self = cls(f, config)
        self.rest, self.next, self.late = rest, seq, late
        self.pipeline.load(pipeline)
        return self

    def take(self, name: str, chunks: pd.DataFrame) -> pd.DataFrame:
        """Feeds a session's chunks in order of seq, those between controls and late ones at once; gives the blocks that are whole."""
        rows, held = [], []

        def feed() -> None:
            if held:
                rows.extend((name, r["t"], y, r["is_speech"], r["vad_prob"], r["gate"], self.late) for y, r in self.feed(np.concatenate(held)))
                held.clear()

        for c in chunks.sort_values("seq", kind="stable").itertuples():
            if c.seq < self.next:
                feed()
                self.late += 1
                continue
            self.next = c.seq + 1
            if c.control:
                feed()
                self.control(c.control)
            if c.pcm is not None and len(c.pcm):
                held.append(np.asarray(c.pcm, float))
        feed()
        return pd.DataFrame(rows, columns=[f.split()[0] for f in BLOCKS.split(", ")])


def enhance_stream(chunks: DataFrame, framing: Framing = DEFAULT, config: dict | None = None, idle_s: int | None = None) -> DataFrame:
    """Blocks of the sessions in CHUNKS, a stream or a table of whole sessions. A stream forgets a session that is idle for `idle_s` seconds; a job that never ends should set it."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Session.load(state.get[0], framing) if state.exists else Session(framing, config)
        out = own.take(key[0], pd.concat(list(parts)))
        state.update((own.dump(),))
        if idle_s:
            state.setTimeoutDuration(1000 * idle_s)
        yield out

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return Session(framing, config).take(key[0], rows)

    by = chunks.groupBy("session")
    return by.applyInPandasWithState(run, BLOCKS, "held binary", "append", _timeout(idle_s)) if chunks.isStreaming else by.applyInPandas(whole, BLOCKS)


class Segmenter:
    """Cuts frames into segments of speech with the silence around and behind it.

    A segment begins with a frame of speech and holds every frame from there on.
    It is given out once there are `least` frames of speech and `quiet` silent
    ones since the last of them, or when it is longer than `longest`. Silence
    before there is speech enough only counts: the segment goes on.
    """

    def __init__(self, quiet: int = 30, least: int = 38, longest: int = 750) -> None:
        self.quiet, self.least, self.longest = quiet, least, longest
        self.start, self.speech, self.silence, self.t = -1, 0, 0, 0

    def step(self, is_speech: bool) -> tuple[int, int] | None:
        self.t += 1
        self.speech += is_speech
        self.silence = (self.silence + 1) * (not is_speech)
        if is_speech and self.start < 0:
            self.start = self.t - 1
        if self.start < 0:
            return None
        ended = self.silence >= self.quiet and self.speech >= self.least
        if not ended and self.t - self.start <= self.longest:
            return None
        found = self.start, self.t
        self.start, self.speech, self.silence = -1, 0, 0
        return found

    def take(self, name: str, frames: pd.DataFrame) -> pd.DataFrame:
        cuts = [self.step(bool(c.is_speech)) for c in frames.sort_values("t", kind="stable").itertuples()]
        return pd.DataFrame([(name, *c) for c in cuts if c is not None], columns=["session", "start", "end"])


def segment_stream(frames: DataFrame, quiet: int = 30, least: int = 38, longest: int = 750, idle_s: int | None = None) -> DataFrame:
    """(session, start, end) from rows (session, t, is_speech), a stream or a table, in order of t within a micro-batch. A stream forgets a session that is idle for `idle_s` seconds, which a job that never ends should set; what it had open is not given out."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Segmenter(quiet, least, longest)
        if state.exists:
            own.start, own.speech, own.silence, own.t = state.get
        out = own.take(key[0], pd.concat(list(parts)))
        state.update((own.start, own.speech, own.silence, own.t))
        if idle_s:
            state.setTimeoutDuration(1000 * idle_s)
        yield out

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return Segmenter(quiet, least, longest).take(key[0], rows)

    out, held = "session string, start bigint, end bigint", "start bigint, speech bigint, silence bigint, t bigint"
    by = frames.groupBy("session")
    return by.applyInPandasWithState(run, out, held, "append", _timeout(idle_s)) if frames.isStreaming else by.applyInPandas(whole, out)


def replay(spark, path: str, schema: str = CHUNKS, files_per_batch: int = 1) -> DataFrame:
    """A stream of recorded chunks, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
