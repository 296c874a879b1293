"""Live sessions whose chunks arrive in any order: a reorder buffer in list state, and timers.

A chunk whose turn it is goes through the session's pipeline at once; one that
is early waits in a list. When the gap before it closes, the list is drained in
order. A timer gives a gap up after `wait_ms`, and so do more than `most_waiting`
early chunks: the session then goes on with the earliest one, and what is
missing counts as lost. Chunks that were passed, and repeated ones, are dropped
and counted as late. A session that gets nothing for `idle_ms` gives out what
still waits and is forgotten.

The pipeline is that of batch sessions, so the samples are the same for any
order of arrival and any cut into micro-batches. State is typed: the place, the
waiting list and the pipeline are separate, and a waiting chunk is written once.
Null chunks count as empty. Needs a state store with timers (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..kernels.spectral import DEFAULT, Framing
from .sessions import BLOCKS, Segmenter, Session

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDERED = f"{BLOCKS}, lost bigint"
NAMES = [f.split()[0] for f in ORDERED.split(", ")]


class Reorder(StatefulProcessor):
    def __init__(self, framing: Framing, config: dict | None, wait_ms: int, idle_ms: int, most_waiting: int) -> None:
        self.framing, self.config = framing, config
        self.wait_ms, self.idle_ms, self.most_waiting = wait_ms, idle_ms, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seq bigint, late bigint, lost bigint, gap_until bigint, idle_until bigint")
        self.waiting = handle.getListState("waiting", "seq bigint, pcm binary, control string")
        self.pipeline = handle.getValueState("pipeline", "data binary")

    def _open(self) -> tuple[Session, list[int], dict[int, tuple[bytes, str | None]]]:
        place = list(self.place.get()) if self.place.exists() else [0, 0, 0, -1, -1]
        own = Session.load(bytes(self.pipeline.get()[0]), self.framing) if self.pipeline.exists() else Session(self.framing, self.config)
        held = {int(s): (bytes(p), c) for s, p, c in self.waiting.get()} if self.waiting.exists() else {}
        return own, place, held

    def _drained(self, name: str, own: Session, place: list[int], held: dict, give_up: bool) -> list[tuple]:
        """Rows of the chunks whose turn it is; with give_up also of those behind a gap."""
        rows: list[tuple] = []
        while held:
            first = min(held)
            if first > place[0]:
                if not give_up and len(held) <= self.most_waiting:
                    break
                place[2] += first - place[0]
            pcm, control = held.pop(first)
            place[0] = first + 1
            if control:
                own.control(control)
            rows += [(name, r["t"], y, r["is_speech"], r["vad_prob"], r["gate"], place[1], place[2]) for y, r in own.feed(np.frombuffer(pcm, np.float32))]
        return rows

    def _close(self, now: int, own: Session, place: list[int], held: dict, known: set[int]) -> None:
        """Writes the state back, and sets the timers. known: what the list already holds."""
        for at in place[3:]:
            if at >= 0:
                self.handle.deleteTimer(at)
        place[3], place[4] = (place[3] if held and place[3] > now else now + self.wait_ms if held else -1), now + self.idle_ms
        if place[3] == place[4]:
            place[4] += 1
        for at in place[3:]:
            if at >= 0:
                self.handle.registerTimer(at)
        self.place.update(tuple(place))
        self.pipeline.update((own.dump(),))
        if known - set(held):
            self.waiting.put([(s, *x) for s, x in sorted(held.items())]) if held else self.waiting.clear()
        elif new := set(held) - known:
            self.waiting.appendList([(s, *held[s]) for s in sorted(new)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, place, held = self._open()
        known = set(held)
        for part in rows:
            for c in part.itertuples():
                if c.seq < place[0] or c.seq in held:
                    place[1] += 1
                else:
                    held[int(c.seq)] = (np.asarray(c.pcm if c.pcm is not None else [], np.float32).tobytes(), c.control)
        out = self._drained(key[0], own, place, held, False)
        self._close(timerValues.getCurrentProcessingTimeInMs(), own, place, held, known)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, place, held = self._open()
        known, now, at = set(held), timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if at not in place[3:]:  # one that was set anew since
            return
        out = self._drained(key[0], own, place, held, True)
        if at == place[4]:
            for state in (self.place, self.waiting, self.pipeline):
                state.clear()
            if place[3] >= 0:
                self.handle.deleteTimer(place[3])
        else:
            idle = place[4]
            place[3] = -1
            self._close(now, own, place, held, known)
            self.handle.deleteTimer(place[4])
            self.handle.registerTimer(idle)
            place[4] = idle
            self.place.update(tuple(place))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def ordered_stream(chunks: DataFrame, framing: Framing = DEFAULT, config: dict | None = None, wait_ms: int = 5000, idle_ms: int = 600_000, most_waiting: int = 256) -> DataFrame:
    """ORDERED rows of a stream of CHUNKS (session, seq from 0, pcm, control), whatever their order."""
    return chunks.groupBy("session").transformWithStateInPandas(Reorder(framing, config, wait_ms, idle_ms, most_waiting), ORDERED, "append", "processingTime")


class Segments(StatefulProcessor):
    """The segment machine of a session; when it gets nothing for idle_ms, a segment that is open is given out and the session forgotten."""

    def __init__(self, quiet: int, least: int, longest: int, idle_ms: int) -> None:
        self.rule, self.idle_ms = (quiet, least, longest), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "start bigint, speech bigint, silence bigint, t bigint, until bigint")

    def _open(self) -> tuple[Segmenter, int]:
        own = Segmenter(*self.rule)
        if not self.machine.exists():
            return own, -1
        own.start, own.speech, own.silence, own.t, until = self.machine.get()
        return own, until

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, until = self._open()
        out = own.take(key[0], pd.concat(list(rows)))
        if until >= 0:
            self.handle.deleteTimer(until)
        until = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(until)
        self.machine.update((own.start, own.speech, own.silence, own.t, until))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, until = self._open()
        if expiredTimerInfo.getExpiryTimeInMs() != until:
            return
        self.machine.clear()
        yield pd.DataFrame([(key[0], own.start, own.t)] if own.start >= 0 else [], columns=["session", "start", "end"])

    def close(self) -> None:
        pass


def closing_segments(frames: DataFrame, quiet: int = 30, least: int = 38, longest: int = 750, idle_ms: int = 600_000) -> DataFrame:
    """(session, start, end) from a stream of (session, t, is_speech), in order of t within a micro-batch."""
    return frames.groupBy("session").transformWithStateInPandas(Segments(quiet, least, longest, idle_ms), "session string, start bigint, end bigint", "append", "processingTime")
