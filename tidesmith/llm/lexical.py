"""Ranked lexical search by Block-Max WAND.

A batch of documents is a segment: its posting lists, one for each term that is
asked for, are made where the texts are, and only those and the documents'
lengths are written. Collection statistics are sums over them. Segments are
dealt to shards; a shard cuts each list into blocks of fixed size, deltas and
counts packed in the fewest bytes that hold them, with the block's last
document and largest impact beside it. For an item, cursors ordered by their
document give the pivot, the first document at which the terms' largest
impacts together pass the k-th best score; the blocks around the pivot are
found from their last documents alone, and if their impacts cannot pass, all
cursors go beyond the nearest end of a block, so that skipped blocks are never
unpacked. The shards' best are merged by item.

Terms are maximal runs of ASCII letters and digits and of characters beyond
ASCII; only A-Z are lower-cased. Scores are exact whole numbers.

Null and empty texts and those without a term are no documents: they count in
no statistic and are never found. Rows without an id are counted and never
found. Rows that repeat an id are documents of their own; items that repeat an
id ask for the terms of all their rows; items without an id or a term find
nothing. Ties go to the smaller id, of equal ids either. Texts of any length
are read whole. An empty table of documents or items gives an empty one; extra
columns play no part.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, rows_by_batch, slim, table, written
from .wordscan import LOWER, Scan

#: Bytes of text whose postings are made at once, documents of a shard, postings of a block.
SEGMENT_BYTES, SHARD_DOCS, BLOCK = 4 << 20, 32_768, 64
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
END = 1 << 62


def term_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text of every term occurrence, and its term."""
    scan = Scan(texts)
    gap = GAP[scan.data]
    starts, ends = scan._runs(gap)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    return scan._text_of(starts), pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LOWER[scan.data[~gap]])])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, b in enumerate(rows_by_batch(batches, SEGMENT_BYTES)):
        of, terms = term_runs(b.column("text"))
        n = np.bincount(of, minlength=b.num_rows)
        seen = terms.dictionary_encode()
        term = seen.indices.to_numpy()
        pair, tf = np.unique(term.astype(np.int64) << 32 | of, return_counts=True)
        cut = np.flatnonzero(np.concatenate(([True], (pair[1:] >> 32) != (pair[:-1] >> 32), [True]))) if len(pair) else np.zeros(1, np.int64)
        docs, tf = (pair & 0xFFFFFFFF).astype("<u4"), tf.astype("<u4")
        binary = lambda x, at: pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
        lists = [seen.dictionary.cast(pa.string()), binary(docs, cut * 4), binary(tf, cut * 4), pa.array(np.diff(cut)), pa.nulls(len(cut) - 1, pa.int64())]
        # the documents themselves, under the term that is none
        ids = b.column("id")
        own = [pa.array([""]), pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.large_binary()), pa.array([n.astype("<i8").tobytes()], pa.large_binary()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])]
        columns = [pa.concat_arrays([x, y.cast(x.type)]) for x, y in zip(lists, own, strict=True)]
        segment = pa.array(np.full(len(cut), task << 32 | k))
        yield pa.RecordBatch.from_arrays([segment, columns[0], *(c.cast(pa.binary()) for c in columns[1:3]), *columns[3:]], names=["segment", "term", "docs", "tf", "n", "total"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of, terms = term_runs(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(of)), terms.cast(pa.string())], names=["item", "term"])


def part(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


class Postings:
    """One term's list in packed blocks: `last` document and largest `high` part of each."""

    def __init__(self, docs: np.ndarray, tf: np.ndarray, m: np.ndarray, block: int = BLOCK):
        parts = part(tf, m[docs])
        cuts = np.arange(0, len(docs), block)
        self.last = docs[np.minimum(cuts + block, len(docs)) - 1].tolist()
        self.high = np.maximum.reduceat(parts, cuts).tolist()
        self.most = max(self.high)
        self.packed = []
        for a in cuts.tolist():
            d = docs[a : a + block]
            gaps, counts = _narrow(np.diff(d, prepend=d[0])), _narrow(tf[a : a + block])
            self.packed.append((int(d[0]), len(d), gaps.dtype.str, counts.dtype.str, gaps.tobytes() + counts.tobytes()))

    def block(self, b: int) -> tuple[list[int], list[int]]:
        first, n, gap, count, data = self.packed[b]
        size = n * int(gap[-1])
        return (np.cumsum(np.frombuffer(data[:size], gap), dtype=np.int64) + first).tolist(), np.frombuffer(data[size:], count).tolist()


class Cursor:
    __slots__ = ("postings", "last", "high", "weight", "most", "shallow", "held", "docs", "counts", "place", "doc")

    def __init__(self, postings: Postings, weight: int):
        self.postings, self.weight = postings, weight
        self.last, self.high, self.most = postings.last, postings.high, weight * postings.most
        self.shallow = self.place = 0
        self.held = -1
        self.seek(0)

    def look(self, doc: int) -> None:
        """Moves the shallow pointer to the block that may hold `doc`; nothing is unpacked."""
        if self.shallow < len(self.last) and self.last[self.shallow] < doc:
            self.shallow = bisect_left(self.last, doc, self.shallow)

    def seek(self, doc: int) -> None:
        """The first posting at or behind `doc`."""
        self.look(doc)
        if (b := self.shallow) == len(self.last):
            self.doc = END
            return
        if b != self.held:
            (self.docs, self.counts), self.held, self.place = self.postings.block(b), b, 0
        self.place = bisect_left(self.docs, doc, self.place)
        self.doc = self.docs[self.place]


class Shard:
    """Documents in the order of their ids, and the packed lists of the terms asked for."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, lists: dict[str, tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, m = ids[order].tolist(), m[order]
        self.m = m.tolist()
        self.lists = {}
        for t, (docs, tf) in lists.items():
            docs = place[docs]
            by = np.argsort(docs)
            self.lists[t] = Postings(docs[by], tf[by].astype(np.int64), m, block)
        self.scored = 0  # documents that were scored

    def best(self, asked: list[tuple[str, int]], k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best documents, ties to the smaller id."""
        cursors = [Cursor(self.lists[t], w) for t, w in asked if w > 0 and t in self.lists]
        by_doc = lambda c: c.doc
        found: list[tuple[int, int]] = []  # a heap of (score, -place)
        floor = 0
        while cursors:
            cursors.sort(key=by_doc)
            total = 0
            for p, c in enumerate(cursors):
                total += c.most
                if total > floor:
                    break
            else:
                break
            pivot = c.doc
            if pivot == END:
                break
            while p + 1 < len(cursors) and cursors[p + 1].doc == pivot:
                p += 1
            bound, nearest = 0, END
            for c in cursors[: p + 1]:
                if (b := c.shallow) < len(c.last) and c.last[b] < pivot:
                    c.look(pivot)
                    b = c.shallow
                if b < len(c.last):
                    bound += c.weight * c.high[b]
                    if c.last[b] < nearest:
                        nearest = c.last[b]
            if bound > floor:
                if cursors[0].doc == pivot:
                    m, score = self.m[pivot], 0
                    for c in cursors[: p + 1]:
                        tf = c.counts[c.place]
                        score += c.weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                    self.scored += 1
                    if score > floor:
                        heapq.heappush(found, (score, -pivot))
                        if len(found) > k:
                            heapq.heappop(found)
                        if len(found) == k:
                            floor = found[0][0]
                    behind = pivot + 1
                else:
                    behind = pivot
            else:
                behind = nearest + 1
                if p + 1 < len(cursors) and cursors[p + 1].doc < behind:
                    behind = cursors[p + 1].doc
            for c in cursors[: p + 1]:
                if c.doc < behind:
                    c.seek(behind)
            if cursors[0].doc == END or any(c.doc == END for c in cursors[: p + 1]):
                cursors = [c for c in cursors if c.doc != END]
        return [(s, self.ids[-p]) for s, p in sorted(found, key=lambda x: (-x[0], -x[1]))]


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of the contract: 100 - 90 + 90 n N div L."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        return 10 + 90 * n * documents // terms
    return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)


def block_max_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text", shard_docs: int = SHARD_DOCS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of the highest scores above 0."""
    asked = written(items.select(named(item_key).cast("bigint").alias("item"), named(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").mapInArrow(_terms, "item bigint, term string").distinct(), "asked")
    wanted = written(asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct(), "asked-terms")
    schema = "segment bigint, term string, docs binary, tf binary, n bigint, total bigint"
    lists = docs.select(named(key).cast("bigint").alias("id"), named(text).alias("text")).filter("text IS NOT NULL").mapInArrow(slim(_segments), schema)
    index = written(lists.join(wanted, "term", "left_semi").select("segment", "term", "docs", "tf", "n", "total"), "postings")
    sums = index.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    n_docs, n_terms = next(((r["n"] or 0, r["total"] or 0) for r in sums.filter("term = ''").collect()), (0, 0))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("n").cast("double") + 1))).cast("bigint")
    queries = asked.join(sums.filter("term <> ''").select("term", weight.alias("weight")), "term").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("asks"))
    shards = max(1, -(-n_docs // shard_docs))
    index = index.select(F.pmod(F.xxhash64("segment"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "segment", "term", "docs", "tf", F.lit(None).cast("array<struct<term:string,weight:bigint>>").alias("asks"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), F.col("item").alias("segment"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("tf"), "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        gathered: dict[str, list] = {}
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = base = 0
        for b in batches:
            out = []
            columns = [b.column(c) for c in ("side", "segment", "term", "docs", "tf", "asks")]
            for i, side in enumerate(columns[0].to_pylist()):
                _, segment, term, data, tf, asks = (c[i] for c in columns)
                if side == 0:
                    data, tf = memoryview(data.as_buffer()), memoryview(tf.as_buffer())
                    if not term.as_py():  # the first row of a segment: its documents
                        n = np.frombuffer(tf, "<i8")
                        own.append((np.frombuffer(data[: 8 * len(n)], "<i8"), np.frombuffer(data[8 * len(n) :], bool), n))
                        base, size = size, size + len(n)
                    else:
                        gathered.setdefault(term.as_py(), []).append((np.frombuffer(data, "<u4").astype(np.int64) + base, np.frombuffer(tf, "<u4").astype(np.int64)))
                    continue
                if shard is None:
                    ids, valid, n = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
                    shard = _shard(ids, valid, lengths(n, n_docs, max(n_terms, 1)), gathered, block)
                    own, gathered = [], {}
                item = segment.as_py()
                out += [(item, doc, score) for score, doc in shard.best([(a["term"], a["weight"]) for a in asks.as_py()], k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["item_id", "doc_id", "score"])

    both = index.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "side", "segment", "term")
    best = both.mapInArrow(slim(run), "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _shard(ids: np.ndarray, valid: np.ndarray, m: np.ndarray, gathered: dict[str, list], block: int) -> Shard:
    """Rows without an id are left out of the lists."""
    lists = {}
    for t in list(gathered):
        docs, tf = (np.concatenate(x) for x in zip(*gathered.pop(t), strict=True))
        keep = valid[docs]
        if keep.any():
            lists[t] = (docs[keep], tf[keep])
    return Shard(ids, m, lists, block)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
z AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
o AS (SELECT row, unnest(ts) AS term FROM d),
p AS (SELECT row, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * z.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY term, z.n),
s AS (
  SELECT q.item_id, p.row, d.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * len(d.ts) * z.n) // z.l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row), z WHERE d.doc_id IS NOT NULL GROUP BY ALL
),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
