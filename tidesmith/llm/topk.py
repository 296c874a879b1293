"""Exact top-k search by inner product with MaxScore.

A vector's components are terms. Rows are dealt to shards of bounded size; a
shard keeps its components term by term, with the largest and smallest value of
each. For a query, a term's score bound follows from those. The terms whose
bounds alone cannot lift a row to the k-th best score so far are non-essential:
the others are traversed for all rows, then the non-essential ones are probed,
only for rows that can still compete. A few rows of each shard are scored whole
to have a floor from the start. The shards' best rows are merged by query.

Vectors that are null or hold null or non-finite components take no part.
Vectors meet only those of equal length. A row never finds rows of its own id;
ties go to the smaller id. Rows that repeat an id are found each; of queries
that do, the least vector is asked. Components are whole numbers of 64 bits and
scores are exact; what is larger is cut to the largest there is. Vectors of any
length are taken whole. An empty table gives an empty one; extra columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, table

#: Rows of a shard, rows that share bounds, and rows whose products seed the floor.
SHARD_ROWS, CHUNK, SEED = 16_384, 1024, 32
#: Terms that are traversed or probed at once.
STEP = 8


class Shard:
    """ids and term-major components of rows of equal length.

    A query takes its terms in the order of what they can add, so that those it
    starts with separate rows, and the rest is soon too small to matter.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], np.ascontiguousarray(rows[order].T)
        self.largest = float(np.abs(rows.astype(float)).max(initial=0))
        self.products = 0  # multiplications so far

    def _parts(self, kind) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x = self.terms.astype(kind)
        cuts = [0, *range(min(SEED, len(self.ids)), len(self.ids), CHUNK), len(self.ids)]
        return [(a, x[:, a:z], x[:, a:z].max(axis=1), x[:, a:z].min(axis=1)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows, ties to the smaller id."""
        # doubles are exact while sums stay below 2^53; beyond, Python's whole numbers are
        exact = len(q) * self.largest * float(np.abs(q.astype(float)).max(initial=0)) < 2.0**53
        kind = np.float64 if exact else object
        if getattr(self, "_kind", None) is not kind:
            self._kind, self._held = kind, self._parts(kind)
        q = q.astype(kind)
        by = np.argsort(-np.abs(q.astype(float)), kind="stable")
        scores, ids = np.empty(0, kind), np.empty(0, np.int64)
        for a, x, high, low in self._held:
            floor = scores[-1] if len(scores) == k else None
            s, at = self._traverse(q, by, x, np.maximum(q * high, q * low), floor)
            found = self.ids[a + at]
            keep = found != own
            scores, ids = np.concatenate([scores, s[keep]]), np.concatenate([ids, found[keep]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
        limit = np.iinfo(np.int64)
        return (scores.astype(np.int64) if exact else np.array([min(max(x, limit.min), limit.max) for x in scores], np.int64)), ids

    def _traverse(self, q: np.ndarray, by: np.ndarray, x: np.ndarray, bound: np.ndarray, floor) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the rows of one part that can reach `floor` (all without one)."""
        n = x.shape[1]
        if not len(q):
            return np.zeros(n, q.dtype), np.arange(n)
        rest = np.concatenate((np.cumsum(bound[by][::-1])[::-1], np.zeros(1, q.dtype)))  # what the terms from here on can add
        if floor is not None and rest[0] < floor:
            return rest[:0], np.arange(0)  # no row of this part competes
        essential = len(q) if floor is None else max(1, int((rest > floor).sum()))
        # essential terms for all rows: some at once, then only for rows that still compete
        total, alive, done = np.zeros(n, q.dtype), np.arange(n), 0
        while done < len(q) and len(alive):
            upto = len(q) if floor is None else min(done + STEP, len(q))
            if done < essential < upto:
                upto = essential
            self.products += (upto - done) * len(alive)
            terms = by[done:upto]
            part = x[terms] if len(alive) == n else x[np.ix_(terms, alive)]
            total, done = total + q[terms] @ part, upto
            if floor is not None:
                keep = total + rest[done] >= floor
                alive, total = alive[keep], total[keep]
        return total, alive


def _vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, d): whole-number components, valid vectors only."""
    x = named(vector)
    valid = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.filter(named(key).isNotNull()).filter(valid).select(named(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint")).alias("v"), F.size(x).alias("d"))


def max_score_search(data: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `data` with the highest inner products for each query."""
    shards = max(1, -(-data.count() // SHARD_ROWS))
    rows, asked = _vectors(data, key, vector, scale), _vectors(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int")).withColumn("side", F.lit(0))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("side", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, shard = None, [], [], None
        for b in batches:
            key_of = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "d", "side")])
            id_of = b.column("id").to_numpy(zero_copy_only=False)
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(key_of[1], dtype=np.int64)))
            cuts = np.flatnonzero(np.concatenate(([True], (key_of[:, 1:] != key_of[:, :-1]).any(axis=0), [True])))
            out: list[list[np.ndarray]] = [[], [], []]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                group, d, side = tuple(key_of[:2, a]), int(key_of[1, a]), key_of[2, a]
                if group != now:
                    now, ids, held, shard = group, [], [], None
                block = flat[at[a] : at[z]].reshape(z - a, d)
                if side == 0:
                    ids.append(id_of[a:z])
                    held.append(block)
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(held) if held else np.empty((0, d), np.int64))
                for own, q in zip(id_of[a:z].tolist(), block, strict=True):
                    s, found = shard.best(own, q, k)
                    out[0].append(np.full(len(s), own))
                    out[1].append(found)
                    out[2].append(s)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query_id", "vec_id", "score"])

    both = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "d", "side").select("shard", "d", "side", "id", "v")
    best = both.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return max_score_search(rows, rows.filter("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
