"""Similarity join of documents on the Jaccard index of their word shingles.

Equal shingle sets are one class from the start, named by a hash of the set.
Classes that can link share enough of the first shingles in a common order
(frequent ones last), so only those meet. Classes on a short list of a shingle
meet in pairs, gathered as stars of bounded size; long lists are cut into sides
of bounded size by a hash and the number of shingles, and two sides meet if
their size ranges can match. What meets is joined with signature trees: the leaves are classes
sorted by size, an inner node holds the OR of its children's token bitmaps and
their range of sizes, and two trees are traversed together, leaving out every
pair of nodes whose largest possible overlap is too small, or whose members
are linked already. A bitmap has a place for every token that two classes of
its block share, so at the leaves the overlap is exact.

A document is empty without words: 0 shingles, its own component. One of fewer
words than the width has its whole sequence as the only shingle. Rows with a
null id are returned with a null component. Rows that repeat an id, with equal
or other texts, share one component. Texts of any length are read whole. Ties do
not occur: the smallest id names a component. An empty table gives an empty one;
extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, rows_by_batch, slim, table, written
from .components import components
from .wordscan import Scan, mix

#: Shared prefix shingles that a pair must have; each adds one row a document and spares chance pairs.
SHARED = 8
#: Lists of more classes go to blocks instead of pairs.
LIST = 128
#: A block's side: classes, and shingles in all.
SIDE, SIDE_TOKENS = 1024, 1_000_000
#: Members of one star, apart from its head.
STAR = 256
#: Binary logarithm of the places of the table of shingle frequencies.
PLACES = 23
#: Bits of the bitmap that tells which documents' sets are needed.
BITS = 1 << 24


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


class SignatureTree:
    """The classes of one block. bits: a row for each class, a bit for each token that two classes share."""

    FAN, LEAF = 8, 16

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        tokens = np.concatenate([sets[i] for i in self.order])
        of = np.repeat(np.arange(len(sets)), self.size)
        known, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = times >= 2
        spot = np.cumsum(shared) - 1
        held = shared[place]
        of, at = of[held], spot[place[held]]
        flat = np.zeros((len(sets), max(1, -(-int(shared.sum()) // 64)) * 64 // 8), np.uint8)
        # one byte at a time: bits of a class are distinct, so OR is a sum
        np.add.at(flat.reshape(-1), of * flat.shape[1] + at // 8, (1 << (at % 8)).astype(np.uint8))
        self.bits = flat.view(np.uint64)
        self.root_of = np.arange(len(sets))
        self.levels = [[(i, min(i + self.LEAF, len(sets))) for i in range(0, len(sets), self.LEAF)]]
        self.ored = [np.array([np.bitwise_or.reduce(self.bits[a:b]) for a, b in self.levels[0]])]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            groups = [range(i, min(i + self.FAN, len(below))) for i in range(0, len(below), self.FAN)]
            self.levels.append([(below[g[0]][0], below[g[-1]][1]) for g in groups])
            self.ored.append(np.array([np.bitwise_or.reduce(self.ored[-1][g[0] : g[-1] + 1]) for g in groups]))

    def joined(self, a: int, b: int) -> None:
        ra, rb = self.root_of[a], self.root_of[b]
        if ra != rb:
            self.root_of[self.root_of == max(ra, rb)] = min(ra, rb)

    def one_component(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        r = self.root_of[x[0]]
        return bool((self.root_of[x[0] : x[1]] == r).all() and (self.root_of[y[0] : y[1]] == r).all())

    def may_link(self, level: int, i: int, j: int) -> bool:
        (a, b), (c, d) = self.levels[level][i], self.levels[level][j]
        low, low2, high, high2 = self.size[a], self.size[c], self.size[b - 1], self.size[d - 1]
        if 100 * min(high, high2) < self.percent * max(low, low2):
            return False
        common = int(np.bitwise_count(self.ored[level][i] & self.ored[level][j]).sum())
        return 100 * min(common, high, high2) >= self.percent * max(low, low2) and (100 + self.percent) * common >= self.percent * (low + low2)

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the linked classes, as (position of the root, position of another)."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            x, y = self.levels[level][i], self.levels[level][j]
            if self.one_component(x, y) or i != j and not self.may_link(level, i, j):
                continue
            if level:
                mine = range(i * self.FAN, min((i + 1) * self.FAN, len(self.levels[level - 1])))
                theirs = range(j * self.FAN, min((j + 1) * self.FAN, len(self.levels[level - 1])))
                pairs = [(level - 1, p, q) for p in mine for q in theirs if i != j or p <= q]
                stack += pairs[::-1]
                continue
            for p in range(*x):
                q = np.arange(max(y[0], p + 1), y[1])
                q = q[self.root_of[q] != self.root_of[p]]
                if not len(q):
                    continue
                overlap = np.bitwise_count(self.bits[q] & self.bits[p]).sum(axis=1, dtype=np.int64)
                for k in q[100 * overlap >= self.percent * (self.size[q] + self.size[p] - overlap)]:
                    self.joined(p, k)
        found = self.root_of
        return [(int(self.order[r]), int(self.order[k])) for k, r in enumerate(found) if r != k]


def _tokens(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row for each distinct shingle of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_by_batch(batches, column=text):
            sets = Scan(b.column(text), lower=True).shingle_sets(width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    return docs.select(text).mapInArrow(slim(run), "token bigint")


def frequencies(docs: DataFrame, key: str, text: str, width: int, one_in: int = 32, least: int = 2) -> np.ndarray:
    """For each place, which is the first bits of a shingle, a level of how often its most frequent shingle is met in a part of the documents; 0 below `least`.

    The levels only shape the common order, so neither the part nor shingles that share a place can lose a link.
    """
    part = docs.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(one_in)) == 0)
    often = _tokens(part, key, text, width).groupBy("token").count().filter(F.col("count") >= least)
    levels = often.groupBy(F.shiftrightunsigned("token", 64 - PLACES).alias("place")).agg(F.floor(4 * F.log2(F.max("count"))).alias("level"))
    # eight places are one number
    eights = levels.groupBy(F.expr("place div 8").alias("at")).agg(F.expr("bit_or(shiftleft(level, cast(8 * (place % 8) as int)))").alias("levels")).toArrow()
    out = np.zeros((1 << PLACES) // 8, "<i8")
    out[eights.column("at").to_numpy()] = eights.column("levels").to_numpy()
    return out.view(np.uint8)


def class_of(s: np.ndarray) -> np.uint64:
    """The name of a set of shingles: a hash of two fingerprints and its size."""
    if not len(s):
        return np.uint64(0)
    f1, f2 = np.bitwise_xor.reduce(mix(s ^ np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(2)))
    return mix(mix(np.array([f1]) ^ np.uint64(len(s))) ^ f2)[0]


def signatures(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, n, class, and the first shingles in the common order."""
    levels = frequencies(docs, key, text, width)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_by_batch(batches, column=text):
            sets = Scan(b.column(text), lower=True).shingle_sets(width)
            n = np.array([len(s) for s in sets], np.int64)
            first, cls = [], np.array([class_of(s) for s in sets], np.uint64)
            for s in sets:
                need = -(-percent * len(s) // 100)
                keep = len(s) - need + min(SHARED, need)
                # s is in the order of values, which a stable sort keeps within a level
                first.append(s[np.argsort(levels[s >> np.uint64(64 - PLACES)], kind="stable")[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n), pa.array(cls.view(np.int64)), pa.array(first, pa.list_(pa.int64()))], names=[key, "n", "class", "first"])

    return docs.select(key, text).mapInArrow(slim(run), f"`{key}` {kind}, n bigint, class bigint, first array<bigint>")


def least_shared(percent: int) -> Column:
    """How many of their first shingles two linked classes of na and nb shingles share at least.

    They have `overlap` in common. That class whose first shingles end earlier
    in the common order has least_overlap - SHARED behind them, so all others of
    the common ones are first ones of both.
    """
    overlap = F.expr(f"({percent} * (na + nb) + {100 + percent - 1}) div {100 + percent}")
    need = [F.expr(f"({percent} * {n} + 99) div 100") for n in ("na", "nb")]
    return F.least(*(overlap - n + F.least(n, F.lit(SHARED)) for n in need))


def _meet(postings: DataFrame, percent: int) -> DataFrame:
    """From postings (token, id, n), sorted by token in each partition: pairs (a, b, na, nb, shared) of short lists; rows of long lists as (token, id, n, null, null)."""

    def pairs(t: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, at = [], np.arange(len(t))
        for lag in range(1, LIST):
            at = at[: np.searchsorted(at, len(t) - lag)]
            at = at[t[at] == t[at + lag]]
            if not len(at):
                break
            x, y = n[at], n[at + lag]
            fit = at[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
            if len(fit):
                found.append(np.stack([d[fit], d[fit + lag], n[fit], n[fit + lag]]))
        if found:
            rows = np.concatenate(found, axis=1)
            swap = rows[0] > rows[1]
            rows[:, swap] = rows[[1, 0, 3, 2]][:, swap]
            order = np.lexsort(rows[:2])
            rows = rows[:, order]
            new = np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
            starts = np.flatnonzero(new)
            rows, shared = rows[:, starts], np.diff(np.append(starts, len(new)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, shared)], names=["a", "b", "na", "nb", "shared"])

    def long(t: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.array(n), none, none], names=["a", "b", "na", "nb", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_list = np.empty((3, 0), np.int64), None
        for b in _with_end(batches):
            if b is not None:
                rest = np.concatenate([rest, np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "id", "n")])], axis=1)
            if not rest.shape[1]:
                continue
            if open_list is not None:  # a long list goes on
                k = int(np.searchsorted(rest[0] != open_list, True)) if (rest[0] != open_list).any() else rest.shape[1]
                if k:
                    yield long(*rest[:, :k])
                    rest = rest[:, k:]
                if not rest.shape[1]:
                    continue
                open_list = None
            cut = rest.shape[1] if b is None else int(np.flatnonzero(rest[0] == rest[0, -1])[0])
            done, rest = rest[:, :cut], rest[:, cut:]
            if done.shape[1]:
                edge = np.concatenate(([True], done[0, 1:] != done[0, :-1]))
                size = np.diff(np.append(np.flatnonzero(edge), len(edge)))
                size = np.repeat(size, size)
                if (size > LIST).any():
                    yield long(*done[:, size > LIST])
                short = (size > 1) & (size <= LIST)
                if short.any():
                    yield from pairs(*done[:, short])
            if rest.shape[1] > LIST:
                open_list = rest[0, 0]
                yield long(*rest)
                rest = rest[:, :0]

    return postings.mapInArrow(slim(run), "a bigint, b bigint, na bigint, nb bigint, shared bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _marked(rows: DataFrame, column: str, marks: DataFrame) -> DataFrame:
    """rows with the bit of their `column` in `marked`: true for all values of the one column of marks, and for a few others.

    The bitmap, BITS / 64 rows at most, goes to every task, so rows stay where they are.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(41)), F.lit(BITS))
    words = marks.select(place(marks.columns[0]).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    dealt = rows.withColumn("at", place(column)).withColumn("word", F.expr("at div 64")).join(F.broadcast(words), "word", "left")
    return dealt.withColumn("marked", F.expr("shiftright(coalesce(bits, 0L), cast(at % 64 as int)) & 1") == 1).drop("at", "word", "bits")


def _sets(docs: DataFrame, needed: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, tokens): the shingle sets of the needed classes at least, as bytes, from the documents whose ids are the `rep` of one; a class may have several equal rows. A wrong mark costs a set that no join asks for."""
    marked = _marked(docs, key, needed.select("rep")).filter("marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in rows_by_batch(batches, column=text):
            ids, out = [], []
            for s in Scan(b.column(text), lower=True).shingle_sets(width):
                own = int(class_of(s).view(np.int64))
                if own not in done:
                    done.add(own)
                    ids.append(own)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "tokens"])

    return marked.select(text).mapInArrow(slim(run), "id bigint, tokens binary")


def _linked(blocks: DataFrame, percent: int) -> DataFrame:
    """From rows (star, block, side, id, tokens), sorted by star, block and side in each partition: links (u, v).

    star: side 0 is one class that is to be held against all others of its
    block, in pieces of bounded size. Else a block is small enough for one tree.
    """

    def tree(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        return [(rows[r][0], rows[k][0]) for r, k in SignatureTree([np.frombuffer(t, np.uint64) for _, t in rows], percent).links()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, rows, total, out = None, None, [], 0, []
        for b in _with_end(batches):
            for star, block, i, t in zip(*(b.column(c).to_pylist() for c in ("star", "block", "id", "tokens")), strict=True) if b is not None else [(False, None, 0, b"")]:
                if (star, block) != now or star and total > SIDE_TOKENS:
                    out += tree(rows)
                    rows, total = ([head] if (star, block) == now else []), 0
                if (star, block) != now:
                    now, head = (star, block), (i, t)
                rows.append((i, t))
                total += len(t) // 8
            if out:
                yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})
                out = []

    return blocks.mapInArrow(slim(run), "u bigint, v bigint")


def ngram_jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id: documents link when 100 * intersection >= percent * union of their shingle sets."""
    docs = docs.select(named(key).cast("bigint").alias("key"), named(text).alias("text"))
    sig = written(signatures(docs, "key", "text", width, percent), "signatures")
    full = sig.filter((F.col("n") > 0) & F.col("key").isNotNull())
    classes = written(full.groupBy("class").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    # one row of each class has its first shingles on; only classes that may have several rows are shuffled for that
    rows = _marked(full, "class", classes.filter("rows > 1").select("class"))
    one = rows.filter("marked").join(classes, "class").filter("key = rep").dropDuplicates(["class"]).select("class", "n", "first")
    postings = rows.filter("NOT marked").select("class", "n", "first").unionByName(one).select(F.explode("first").alias("token"), F.col("class").alias("id"), "n")
    met = written(_meet(postings.repartition("token").sortWithinPartitions("token", "id"), percent), "met")

    # short lists: pairs that share enough prefix shingles; each meets in a star of its smaller id
    need = least_shared(percent)
    pairs = written(met.filter("shared is not null").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= need).select("a", "b"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    members = pairs.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("block"), "a", "b")
    # long lists: blocks of two sides, for every two sides whose sizes can match
    sides, blocks = _sides(met, percent)

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(sides.select("id")).distinct()
    needed = ids.join(classes.withColumnRenamed("class", "id"), "id").select("rep")
    sets = written(_sets(docs, needed, "key", "text", width), "sets")
    stars = members.select("block", F.lit(0).alias("side"), F.col("a").alias("id")).distinct().unionByName(members.select("block", F.lit(1).alias("side"), F.col("b").alias("id")))
    met_sets = stars.withColumn("star", F.lit(True)).unionByName(blocks.withColumn("star", F.lit(False))).join(sets, "id").select("star", "block", "side", "id", "tokens")
    links = _linked(met_sets.repartition("star", "block").sortWithinPartitions("star", "block", "side", "id"), percent)
    # rows that repeat an id join the classes of their texts
    several = full.groupBy("key").agg(F.min("class").alias("u"), F.max("class").alias("last")).filter("u <> last").select("key", "u")
    same = full.join(written(several, "several"), "key").select("u", F.col("class").alias("v")).filter("u <> v").distinct()
    roots = written(components(links.unionByName(same)), "roots")
    joined = classes.join(roots.withColumnRenamed("u", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # only components of several classes look for another one's smallest id
    low = joined.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("rep").alias("low"))
    named_by = joined.join(low, "root", "left").select("class", F.coalesce("low", "rep").alias("component_id"))
    found = sig.join(named_by, "class", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def _sides(met: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of long lists: sides (token, band, part, id), and blocks (block, side, id) of one side or two that can match.

    Bands of sizes are as wide as two sizes that can match are apart, so only
    equal and neighbouring bands meet; a hash cuts a band into parts.
    """
    listed = met.filter("shared is null").select(F.col("a").alias("token"), F.col("b").alias("id"), F.col("na").alias("n"))
    listed = listed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))))
    size = listed.groupBy("token", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(F.sum("n") / SIDE_TOKENS)).alias("parts"))
    sides = written(listed.join(size, ["token", "band"]).select("token", "id", "n", "band", F.pmod(F.xxhash64("id", "token"), F.col("parts")).alias("part")), "sides")
    spans = written(sides.groupBy("token", "band", "part").agg(F.min("n").alias("low"), F.max("n").alias("high")), "spans")
    other = spans.select("token", *(F.col(c).alias(c + "2") for c in ("band", "part", "low", "high")))
    # rounding may set a size in the band beside its own, so bands up to two apart are tried
    near = spans.withColumn("band2", F.explode(F.array(*(F.col("band") + k for k in range(3))))).join(other, ["token", "band2"])
    near = near.filter((F.col("band") < F.col("band2")) | (F.col("part") <= F.col("part2"))).filter(100 * F.least("high", "high2") >= percent * F.greatest("low", "low2"))
    two = near.select("token", "band", "part", "band2", "part2", F.xxhash64("token", "band", "part", "band2", "part2").alias("block"))
    one = two.select("token", "band", "part", "block", F.lit(0).alias("side"))
    rest = two.filter("band <> band2 OR part <> part2").select("token", F.col("band2").alias("band"), F.col("part2").alias("part"), "block", F.lit(1).alias("side"))
    return sides, sides.join(one.unionByName(rest), ["token", "band", "part"]).select("block", "side", "id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT row, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END) AS s FROM w),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS shared FROM s a JOIN s b USING (s) WHERE a.row < b.row GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT row, row AS at FROM w UNION SELECT r.row, e.b FROM r JOIN e ON e.a = r.at)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(d.doc_id) AS component_id FROM w LEFT JOIN n USING (row) JOIN r USING (row) JOIN w d ON d.row = r.at GROUP BY w.row, w.doc_id
"""
