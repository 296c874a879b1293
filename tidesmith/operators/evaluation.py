"""The evaluation data-flow: pairing with a baseline, summaries, bootstrap intervals, strata, splits, sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import settled

DELTA_SEED = 20260819


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def against_baseline(rows: DataFrame, keys: Sequence[str], order: Column, baseline: str = "none") -> DataFrame:
    """rows with `base` and `delta`; keys that the baseline lacks are dropped. Of baseline rows with equal keys the last by `order` counts: rows of a table have no order of their own."""
    held = rows.withColumn("_order", order).filter(F.col("method") == baseline)
    base = held.groupBy(*keys).agg(F.max_by("score", "_order").alias("base"))
    return rows.join(base, list(keys)).withColumn("delta", F.col("score") - F.col("base"))


def summary(rows: DataFrame, baseline: str = "none", order: Column | None = None) -> DataFrame:
    """(method, n, mean, delta): means over finite scores, and the mean paired difference, which the baseline itself has not. Of repeated baseline rows the last by `order` counts, without one the best."""
    paired = against_baseline(rows, ["id", "stratum"], F.col("score") if order is None else order, baseline)
    means = rows.groupBy("method").agg(F.count(finite(F.col("score"))).alias("n"), F.avg(finite(F.col("score"))).alias("mean"))
    deltas = paired.filter(F.col("method") != baseline).groupBy("method").agg(F.avg(finite(F.col("delta"))).alias("delta"))
    return means.join(deltas, "method", "left")


def bootstrap_hashed(rows: DataFrame, by: str, value: str, order: str, resamples: int = 200, seed: int = 1) -> DataFrame:
    """The same interval from built-in functions: Poisson weights by a hash of row and resample, so groups of any size spread over tasks and rows are summed before they are shuffled."""
    u = F.pmod(F.xxhash64(F.col(order), F.col("b"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    edges, term, total = [], np.exp(-1.0), 0.0
    for k in range(8):
        total += term
        edges.append(total)
        term /= k + 1
    weight = reduce(lambda out, e: out + F.when(u > e, 1).otherwise(0), edges, F.lit(0))
    drawn = rows.filter(finite(F.col(value)).isNotNull()).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    means = drawn.withColumn("w", weight).groupBy(by, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def check_strata(rows: DataFrame, strata: Sequence[str]) -> None:
    """Strata must be declared, distinct, and columns of the rows."""
    if not strata or isinstance(strata, str) or len(set(strata)) != len(strata):
        raise ValueError(f"strata must be distinct names: {strata!r}")
    if missing := [s for s in strata if s not in rows.columns]:
        raise ValueError(f"rows lack the strata {missing}")


def first_of_strata(rows: DataFrame, strata: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of each cell in order, with `place`; the plan keeps k rows a cell before it shuffles."""
    check_strata(rows, strata)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("place") <= k)


def bucket(value: Column, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Half-open buckets [edge, next edge); null outside."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        hit = (value >= low) & (value < high)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def interval_join(values: DataFrame, value: str, intervals: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Each row of values with every interval [low, high) of a table that holds its value, the intervals' columns beside its own.

    An interval lies in one or two bins as wide as the power of two above its
    length; a value looks into its bin of every width that the intervals have, a
    few. So the join is one on equal keys for intervals of any lengths and any
    number. A null edge is open; empty intervals and null and NaN values meet
    nothing. Names must differ.
    """
    v, least, most = F.col(value).cast("double"), F.lit(float("-inf")), F.lit(float("inf"))
    ends = values.filter(~F.isnan(v)).agg(F.min(v), F.max(v)).first()
    bounded = intervals.withColumns({"_low": F.coalesce(F.col(low).cast("double"), least), "_high": F.coalesce(F.col(high).cast("double"), most)}).filter("_low < _high AND NOT isnan(_high)")
    if ends[0] is None:
        bounded = bounded.limit(0)
    # what lies beyond all values needs no bin
    a, z = F.greatest(F.col("_low"), F.lit(ends[0])), F.least(F.col("_high"), F.lit(ends[1]))
    bounded = bounded.withColumns({"_a": a, "_z": z}).filter("_a <= _z")
    bounded = bounded.withColumn("_width", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.greatest(F.col("_z") - F.col("_a"), F.lit(1e-300)))), F.lit(-900))))
    widths = F.lit([r[0] for r in bounded.select("_width").distinct().collect()]).cast("array<double>")  # at most 2,000, one for each power
    binned = bounded.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor(F.col("_a") / F.col("_width")), F.floor(F.col("_z") / F.col("_width")))).cast("array<double>"))).drop("_a", "_z")
    asked = values.filter(~F.isnan(v)).withColumn("_width", F.explode(widths)).withColumn("_bin", F.floor(v / F.col("_width")).cast("double"))
    met = asked.join(binned, ["_width", "_bin"]).filter((v >= F.col("_low")) & (v < F.col("_high")))
    return met.drop("_width", "_bin", "_low", "_high")


def _ranks(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(at, r) of all distinct points and edges (at), r being how many distinct points lie below, and the number of points: ranges are counted one by one and the ranges' counts before added."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = points.select("at", F.lit(1).alias("p")).unionAll(edges.select("at", F.lit(0))).groupBy("at").agg(F.max("p").alias("p"))
    laid = settled(both.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()))
    sizes = laid.groupBy("part").agg(F.sum("p").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    here = F.coalesce(F.sum("p").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.withColumn("here", here).join(F.broadcast(before), "part").select("at", (F.col("here") + F.col("before")).alias("r")), sizes.agg(F.sum("n")).first()[0] or 0


def interval_summary(values: DataFrame, value: str, intervals: DataFrame, least: str, low: str = "low", high: str = "high", top: int = 12) -> DataFrame:
    """The rows of values that lie in an interval [low, high), with `n`, how many do hold them, and `least`, the smallest of that column of those.

    What interval_join would give, summed up, but no pair is ever made. An
    interval is a range of ranks of the distinct values and so the union of at
    most two nodes of each level of the binary tree over them; nodes add up
    their intervals, and a value asks the one node of each level that is above
    it. The work grows as (values + intervals) * log(distinct values). The
    `top` levels, whose nodes all values ask, are broadcast. Edges are as in
    interval_join.
    """
    v = F.col(value).cast("double")
    held = values.withColumn("_at", v).filter("_at IS NOT NULL AND NOT isnan(_at)")
    spans = intervals.select(
        F.coalesce(F.col(low).cast("double"), F.lit(float("-inf"))).alias("_low"), F.coalesce(F.col(high).cast("double"), F.lit(float("inf"))).alias("_high"), F.col(least).alias("_least")
    ).filter("_low < _high AND NOT isnan(_high)")
    spans = spans.groupBy("_low", "_high").agg(F.count(F.lit(1)).alias("_n"), F.min("_least").alias("_least"))
    ranks, points = _ranks(held.select(F.col("_at").alias("at")), spans.select(F.explode(F.array("_low", "_high")).alias("at")))
    levels = max(points, 1).bit_length()
    a, z = (ranks.select(F.col("at").alias(c), F.col("r").alias(n)) for c, n in (("_low", "_a"), ("_high", "_z")))
    ranges = spans.join(a, "_low").join(z, "_high").filter("_a < _z").groupBy("_a", "_z").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    each = ranges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    each = each.withColumns({"_from": F.expr("shiftright(_a + shiftleft(1L, k) - 1, k)"), "_to": F.expr("shiftright(_z, k)")}).filter("_from < _to")
    node = F.array_compact(F.array(F.when(F.col("_from") % 2 == 1, F.col("_from")), F.when(F.col("_to") % 2 == 1, F.col("_to") - 1)))
    nodes = settled(each.select("k", F.explode(node).alias("node"), "_n", "_least").groupBy("k", "node").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least")))
    cut = levels - top
    asked = held.select("_at").distinct().join(ranks.withColumnRenamed("at", "_at"), "_at")
    met = []
    for some, above in ((F.broadcast(nodes.filter(F.col("k") >= cut)), range(max(cut, 0), levels + 1)), (nodes.filter(F.col("k") < cut), range(max(cut, 0)))):
        if above:
            lines = asked.withColumn("k", F.explode(F.array(*map(F.lit, above)))).withColumn("node", F.expr("shiftright(r, k)"))
            met.append(lines.join(some, ["k", "node"]).groupBy("_at").agg(F.sum("_n").alias("n"), F.min("_least").alias("least")))
    found = reduce(DataFrame.unionAll, met).groupBy("_at").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return held.join(found, "_at").drop("_at")


def filled_buckets(rows: DataFrame, by: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """k rows of each bucket; raises when it runs if a bucket has fewer."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("place") <= k).withColumn("place", F.when(F.col("size") < k, F.raise_error(F.concat(F.lit("too few rows in bucket "), F.col(by).cast("string")))).otherwise(F.col("place"))).drop("size")


def numbered(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """rows with their places, from 0, in a total order: ranges sorted one by one, and the sizes of the ranges before; no task has all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")  # a row a range
    return laid.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).drop("_at", "_part", "_before")


def split_by_group(rows: DataFrame, group: Column, share: int = 10, least: int = 2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """rows with `split`: max(least, groups / share) groups, the first by `order` of `_group` (a hash if there is none), are 'val' with all their rows, so no group is in both."""
    named = rows.withColumn("_group", group)
    groups = named.select("_group").distinct().withColumn("_order", F.xxhash64(F.lit(seed), "_group") if order is None else order)
    held = groups.orderBy("_order", "_group").limit(max(least, groups.count() // share)).select("_group", F.lit("val").alias("split"))
    return named.join(held, "_group", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_group")


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is planned and not done yet."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def grid(*tables: DataFrame) -> DataFrame:
    """The product of small tables of choices (strata, methods): their sizes are given by hand, not by data."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def round_robin(cells: DataFrame, sources: DataFrame, cell_order: Sequence[str], source_order: Sequence[str], n_sources: int) -> DataFrame:
    """Deals the sources to the cells in turn."""
    a = numbered(cells, "_n", cell_order).withColumn("_k", F.col("_n") % n_sources).drop("_n")
    return a.join(numbered(sources, "_k", source_order), "_k").drop("_k")
