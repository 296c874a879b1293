"""Best-fit packing of token pieces into sequences.

Texts become token ids and an end id; longer ones are cut into full pieces and
a rest. The plan is made on the histogram of piece lengths alone, which has a
bounded number of bins whatever the corpus holds: the configuration linear
program (how often to use each way of filling a sequence) is solved by
multiplicative weights, where a knapsack over the prices of classes of lengths
finds the next configuration; weights are rounded to whole uses that take real
lengths of their classes, the last place going to what fits best. The program
is solved again on what remains, and the few last pieces go by best fit. Each
piece then finds its place by its rank among the pieces of its length.

Null and empty texts are the end id alone. Texts of any length are read whole.
An empty table gives an empty one. Repeated rows are packed one by one; pieces
of equal length, ties, take their places in the order of tasks and rows. Extra
columns play no part.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import by_arrow, named, rows_by_batch, table, written

#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 20

Use = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, and the lengths in each with their numbers


def pieces(docs: DataFrame, key: str, text: str, size: int, end_id: int, path: str | None = None) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, part, nth): nth counts the pieces of that length in the task `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, end = codec(path, library_merges=True), Counter(), end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        for b in rows_by_batch(batches, BATCH_BYTES):
            out: list[list] = [[], [], [], [], [], []]
            ids, begin = own.encode_batch(b.column("text"))
            for i, (a, z) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                data = memoryview(ids[a:z].tobytes() + end)
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    piece = data[at : at + 4 * size]
                    n = len(piece) // 4
                    for column, x in zip(out, (i, k, at // 4, n, zlib.crc32(piece), seen[n]), strict=True):
                        column.append(x)
                    seen[n] += 1
            rows = [pa.array(x, pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(key).take(rows[0]), rows[1].cast(pa.int32()), *rows[2:5], pa.array(np.full(len(rows[0]), part, np.int32)), rows[5]], names=[key, "piece", "start", "length", "ids_crc32", "part", "nth"])

    results = [T.StructField(c, T.IntegerType() if c in ("piece", "part") else T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "part", "nth")]
    return by_arrow(docs.select(named(key), named(text).alias("text")), run, [docs.schema[key], *results])


def _best_filling(size: int, lengths: np.ndarray, most: np.ndarray, prices: np.ndarray) -> tuple[tuple[int, int], ...]:
    """Bounded knapsack: (place in `lengths`, number) of what to take, at most `most` of each, so that prices sum highest within `size`."""
    value = np.zeros(size + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in range(len(lengths)):
        n, left, part = int(lengths[i]), int(most[i]), 1
        while left > 0:  # 1, 2, 4, ... and the rest make every number up to `most`
            k = min(part, left)
            if k * n <= size:
                other = value[: size + 1 - k * n] + k * prices[i]
                better = other > value[k * n :]
                steps.append((i, k, better))
                value[k * n :][better] = other[better]
            left, part = left - k, 2 * part
    found: Counter[int] = Counter()
    room = size
    for i, k, better in reversed(steps):
        if room >= lengths[i] * k and better[room - lengths[i] * k]:
            found[i] += k
            room -= int(lengths[i]) * k
    return tuple(sorted(found.items(), reverse=True))


def plan(histogram: dict[int, int], size: int, classes: int = 96, rounds: int = 120, told: dict[str, int] | None = None) -> list[Use]:
    """Fillings with their numbers of uses, which hold each length exactly as often as the histogram has it.

    Lengths are put into at most `classes` classes of about equal mass, so that
    each is wanted often and a configuration can be used often. The program is
    solved on the classes, its weights are rounded to whole uses, and each use
    takes real lengths of its classes; what room their differences leave goes to
    the lengths that fit best. So again on what is left, while columns place
    much of it; best fit alone places the few last pieces. `told` gets the
    tokens that best fit places at the end ("rest"), and of the others, before
    any of them are packed anew, those that the columns' classes hold
    ("columns") and those put into their room ("room"). Memory and time are
    those of the histogram's bins, `size` at most.
    """
    stock = _Stock({n: c for n, c in histogram.items() if c > 0})
    uses: list[Use] = []
    if size in stock.left:
        uses.append((stock.left[size], ((size, 1),)))
        stock.take(uses[-1])
    told = {} if told is None else told
    told.update(columns=0, room=0, rest=0)
    while stock.known:
        before, columns = stock.tokens(), _solved(stock.left, size, classes, rounds)
        for times, column in columns:
            while times > 0 and stock.known:
                filling, own = stock.filled(size, column)
                use = (min(times, *(stock.left[n] // c for n, c in filling.items())), tuple(sorted(filling.items(), reverse=True)))
                if not own or sum(n * c for n, c in filling.items()) < min(size - size // 64, stock.tokens()):
                    break  # its classes are used up
                uses.append(use)
                stock.take(use)
                times -= use[0]
                told["columns"] += use[0] * own
                told["room"] += use[0] * (sum(n * c for n, c in filling.items()) - own)
        if before - stock.tokens() < before / 20:
            break
    # the last pieces go by best fit. While that needs more sequences than all lengths sum to, more and more of those with the most room
    # left are packed anew with them, in the end all: so a plan never needs more sequences than best fit alone
    whole = [u for u in uses if u[1] == ((size, 1),)]
    loose = sorted((u for u in uses if u[1] != ((size, 1),)), key=lambda u: sum(n * c for n, c in u[1]))
    demand = -(-sum(n * c for n, c in histogram.items()) // size)
    step, found = max(1, sum(t for t, _ in uses) // 128), None
    while True:
        last = _last(_Stock(dict(stock.left)), size)
        number = sum(t for t, _ in whole + loose + last)
        if found is None or number < found[0]:
            found = number, whole + loose + last, stock.tokens()
        if number <= demand or not loose:
            told["rest"] = found[2]
            return found[1]
        back = 0
        while loose and back < step:
            times, filling = loose.pop(0)
            give = min(times, step - back)
            stock.give((give, filling))
            back += give
            if times > give:
                loose.insert(0, (times - give, filling))
        step *= 2


def _last(stock: _Stock, size: int) -> list[Use]:
    """Best-fit decreasing, whole runs of equal fillings at a time."""
    uses = []
    while stock.known:
        filling, _ = stock.filled(size, ())
        uses.append((min(stock.left[n] // c for n, c in filling.items()), tuple(sorted(filling.items(), reverse=True))))
        stock.take(uses[-1])
    return uses


def _solved(left: dict[int, int], size: int, classes: int, rounds: int, rate: float = 0.5) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """Columns as (uses, ((shortest, longest, number), ...)) by classes of lengths: multiplicative weights on the classes' demands, priced by the knapsack, rounded by largest fraction."""
    lengths = np.array(sorted(left))
    count = np.array([left[int(n)] for n in lengths], float)
    mass = np.cumsum(lengths * count)
    of = np.minimum((mass - lengths * count / 2) * classes / mass[-1], classes - 1).astype(int) if len(lengths) > classes else np.arange(len(lengths))
    of = np.unique(of, return_inverse=True)[1]
    demand = np.bincount(of, count)
    low, high = (f.reduceat(lengths, np.flatnonzero(np.diff(of, prepend=-1))) for f in (np.minimum, np.maximum))
    mean = np.ceil(np.bincount(of, count * lengths) / demand).astype(np.int64)
    bound = float(mass[-1] / size)
    most = np.minimum(size // mean, demand.astype(np.int64))
    weight, chosen = mean * demand, Counter()
    for _ in range(rounds):
        filling = _best_filling(size, mean, most, weight / weight.sum() / demand)
        chosen[filling] += 1
        cover = np.zeros(len(mean))
        for k, c in filling:
            cover[k] = c / demand[k]
        weight = weight * np.exp(-rate * cover / max(cover.max(), 1e-12))
    share = {filling: bound * times / rounds for filling, times in chosen.items()}
    uses = {filling: int(x) for filling, x in share.items()}
    for filling in sorted(share, key=lambda f: (uses[f] - share[f], f))[: max(0, round(bound) - sum(uses.values()))]:
        uses[filling] += 1
    return [(uses[f], tuple((int(low[k]), int(high[k]), c) for k, c in f)) for f in sorted(uses, key=lambda f: (-share[f], f)) if uses[f]]


class _Stock:
    """The pieces that are left, by length."""

    def __init__(self, left: dict[int, int]):
        self.left, self.known = left, sorted(left)
        self.total = sum(n * c for n, c in left.items())

    def tokens(self) -> int:
        return self.total

    def take(self, use: Use) -> None:
        times, filling = use
        for n, c in filling:
            self.total -= n * c * times
            self.left[n] -= c * times
            if not self.left[n]:
                del self.left[n]
                self.known.pop(bisect.bisect_left(self.known, n))

    def give(self, use: Use) -> None:
        times, filling = use
        for n, c in filling:
            self.total += n * c * times
            if n not in self.left:
                self.left[n] = 0
                bisect.insort(self.known, n)
            self.left[n] += c * times

    def largest(self, most: int, least: int, filling: Counter) -> int:
        """The largest length from `least` to `most` of which `filling` has not all; 0 if there is none."""
        for i in range(bisect.bisect_right(self.known, most) - 1, -1, -1):
            n = self.known[i]
            if n < least:
                break
            if filling[n] < self.left[n]:
                return n
        return 0

    def filled(self, size: int, column: tuple[tuple[int, int, int], ...]) -> tuple[Counter, int]:
        """One filling by a column, and the tokens of the column's classes in it. The last place, and what room is left, go to the piece or pair that fits best."""
        filling: Counter[int] = Counter()
        room, own = size, 0
        places = [(low, high) for low, high, c in column for _ in range(c)]
        for low, high in places[:-1]:
            if n := self.largest(min(high, room), low, filling):
                filling[n] += 1
                room, own = room - n, own + n
        while room > 0 and (n := self.largest(room, 1, filling)):
            best = (n,)
            if n < room and filling:
                gap = room - n
                for first in reversed(self.known[: bisect.bisect_right(self.known, room)]):
                    if 2 * first < room - gap:  # two such are shorter than what is found
                        break
                    if filling[first] < self.left[first]:
                        filling[first] += 1
                        second = self.largest(room - first, 1, filling)
                        filling[first] -= 1
                        if second and room - first - second < gap:
                            best, gap = (first, second), room - first - second
                            if not gap:
                                break
            for n in best:
                filling[n] += 1
                room -= n
                own += n if any(low <= n <= high for low, high in places) else 0
        return +filling, own


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset. Only counts by length and task are shuffled, and one count for each length reaches the driver."""
    cut = written(pieces(docs, key, text, size, end_id, path), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    uses = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    # by length: the ranks at which a configuration begins, its first sequence, its pieces of that length, and where they start in it
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    first = 0
    for times, filling in uses:
        at = 0
        for n, c in filling:
            places.setdefault(n, []).append((ranks[n], first, c, at))
            ranks[n] += times * c
            at += n * c
        first += times
    tables = {n: np.array(x, np.int64).T for n, x in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for one in np.unique(n):
                mine = n == one
                starts, base, c, at = tables[int(one)]
                k = np.searchsorted(starts, rank[mine], "right") - 1
                within = rank[mine] - starts[k]
                sequence[mine] = base[k] + within // c[k]
                offset[mine] = at[k] + within % c[k] * one
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [key, "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(before, ["part", "length"]).select(*map(named, names), (F.col("before") + F.col("nth")).alias("rank"))
    return by_arrow(ranked, run, [*(cut.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
