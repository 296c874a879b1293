"""Conversion of texts by a table of phrases: at each place the longest phrase that begins there.

The table's phrases are a trie with failure links, so a text is read once: a
character that goes on no phrase follows the links to the longest suffix that
may still become one. The table, at most MOST characters, goes to the tasks with
the code; a larger one is an error. Ties, phrases given twice with different
results, are an error too. Null texts stay null; empty phrases are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 20_000_000


class Automaton:
    def __init__(self, phrases: dict[str, str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.fail, self.out = [0], [0], [None]
        for source, target in phrases.items():
            node = 0
            for c in source:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.fail.append(0)
                    self.out.append(None)
                node = self.next[node][c]
            self.out[node] = target
        #: for each node the longest phrase on the way to it: its length and result
        self.best: list[tuple[int, str] | None] = [None] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                self.best[child] = (self.depth[child], self.out[child]) if self.out[child] is not None else self.best[node]
                if node:
                    back = self.fail[node]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[child] = self.next[back].get(c, 0)
                queue.append(child)

    def convert(self, text: str) -> str:
        out: list[str] = []
        node = 0
        for at in range(len(text) + 1):
            c = text[at] if at < len(text) else None
            while node and (c is None or c not in self.next[node]):
                # the place where the held stretch begins is settled: its longest phrase, or one character as it is
                start = at - self.depth[node]
                size, target = self.best[node] or (1, text[start])
                out.append(target)
                start += size
                # what is left of the stretch is read on from the longest node that it still is
                while node and at - self.depth[node] < start:
                    node = self.fail[node]
                kept = at - self.depth[node]
                if kept > start:  # characters between that begin no phrase as long as to here
                    node, tail = self._reread(text, start, at)
                    out += tail
            if c is None:
                break
            if c in self.next[node]:
                node = self.next[node][c]
            else:
                out.append(c)
        return "".join(out)

    def _reread(self, text: str, start: int, end: int) -> tuple[int, list[str]]:
        """From the root over text[start:end]: what is settled there, and the node at its end."""
        out: list[str] = []
        while start < end:
            node, at, best = 0, start, None
            while at < end and text[at] in self.next[node]:
                node = self.next[node][text[at]]
                at += 1
                if self.out[node] is not None:
                    best = (at - start, self.out[node])
            if at == end:
                return node, out
            size, target = best or (1, text[start])
            out.append(target)
            start += size
        return 0, out


def convert(df: DataFrame, text: str, phrases: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """df with its column `text` converted by the phrases (source, target)."""
    table = phrases.select(F.col(source).cast("string").alias("s"), F.col(target).cast("string").alias("t")).filter("s <> '' AND t IS NOT NULL").distinct()
    size, twice = table.agg(F.coalesce(F.sum(F.length("s") + F.length("t")), F.lit(0)), F.count("s") - F.countDistinct("s")).first()
    if size > MOST or twice:
        raise ValueError(f"phrases of {size} characters, {twice} of them with two results")
    known = {r["s"]: r["t"] for r in table.collect()}
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(known)
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([None if t is None else own.convert(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
