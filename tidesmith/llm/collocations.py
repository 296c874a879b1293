"""Phrase collocations by suffix-sigma.

Every position of a piece gives the suffix that begins there, cut to `max_n`
words. Equal suffixes of a batch are added up and shuffled by language and first
word. A bucket's suffixes are sorted in reverse lexicographic order, so that
one stack counts all prefixes in one pass: the words that a suffix does not share
with the one before are popped, and each popped prefix hands its count to the
one below. Counts of a phrase's parts are joined afterwards.

A first word with a share of 1 / `SPLIT` of all words or more is hot: its
suffixes are dealt by the second word too, and so on while words are hot. What
is counted in several buckets then, prefixes of hot words alone, is added up.
There are at most SPLIT hot words, so they go to the tasks with the code. The
number of buckets follows from the number of words, and a task holds one bucket at
a time.

Words are compared as text, so no hash decides a count. Null and empty texts
have no words; a null language is `und`. Long texts give all their suffixes.
Repeated rows count each. Ties rank by score, count and phrase. An empty table
gives an empty one; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, rows_by_batch, slim, table, written
from .wordscan import LOWER, Scan, mix

#: Bytes of text whose suffixes are added up at once; words of a bucket; a hot word has 1 / SPLIT of all words.
BATCH_BYTES, BUCKET_WORDS, SPLIT = 8 << 20, 1_000_000, 1024
ENDS = np.array([b in b".,;:!?\n\v\f\r" for b in range(256)])
GAP = ENDS.copy()
GAP[[9, 32]] = True


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Text, number of the piece, and word of every word occurrence."""
    scan = Scan(texts)
    gap = GAP[scan.data]
    starts, ends = scan._runs(gap)
    at = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[scan.data[~gap]])])
    return scan._text_of(starts), np.cumsum(ENDS[scan.data], dtype=np.int64)[starts], words.dictionary_encode()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_by_batch(batches, BATCH_BYTES):
        of, _, words = word_runs(b.column("text"))
        lang = b.column("lang").dictionary_encode()
        pair, n = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of] << 32 | words.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(pair >> 32)).cast(pa.string()), words.dictionary.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.string()), pa.array(n)], names=["lang", "word", "f"])


def _text_hashes(words: pa.Array) -> np.ndarray:
    scan = Scan(words)
    return scan._hashes(scan.data, scan.off[:-1], scan.off[1:])


def _packed(ids: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the suffixes, two words in each, the first words last."""
    return [ids[k].astype(np.int64) << 32 | (ids[k + 1] if k + 1 < len(ids) else 0) for k in range(0, len(ids), 2)][::-1]


def suffixes(b: pa.RecordBatch, max_n: int, buckets: int, hot: pa.Array) -> Iterator[tuple[int, str, pa.Array, np.ndarray, np.ndarray]]:
    """(bucket, language, words, ids, counts): ids[i] are the places of suffix i's words, counted from 1, 0 behind its end."""
    of, piece, words = word_runs(b.column("text"))
    if not len(of):
        return
    at = words.indices.to_numpy()
    lang = b.column("lang").dictionary_encode()
    of_lang = lang.indices.to_numpy(zero_copy_only=False)[of]
    # a place in the row of words, 0 behind the end of the piece
    ids = np.zeros((max_n, len(at)), np.int32)
    ids[0] = at + 1
    inside = np.ones(len(at), bool)
    for k in range(1, max_n):
        inside = inside[: len(at) - k] & (piece[k:] == piece[:-k]) & (of[k:] == of[:-k]) if len(at) > k else inside[:0]
        ids[k, : len(inside)][inside] = at[k:][inside] + 1
    longer = ids[1] > 0
    ids, of_lang = ids[:, longer], of_lang[longer]
    if not ids.shape[1]:
        return
    # equal suffixes are added up
    order = np.lexsort((*_packed(ids), of_lang))
    ids, of_lang = ids[:, order], of_lang[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0) | (of_lang[1:] != of_lang[:-1]))))
    counts = np.diff(np.append(first, len(of_lang)))
    ids, of_lang = ids[:, first], of_lang[first]
    # the bucket: language, first word, and on through hot words
    hashes, is_hot = np.append(_text_hashes(words.dictionary), np.uint64(0)), np.append(pc.is_in(words.dictionary, value_set=hot).to_numpy(zero_copy_only=False), False)
    key, go = mix(_text_hashes(lang.dictionary)[of_lang]), np.ones(len(of_lang), bool)
    for k in range(max_n):
        go &= ids[k] > 0
        key = np.where(go, mix(key ^ hashes[ids[k] - 1]), key)
        go &= is_hot[ids[k] - 1]
    bucket = (key % np.uint64(buckets)).astype(np.int64) * len(lang.dictionary) + of_lang
    order = np.argsort(bucket, kind="stable")
    bucket, ids, counts = bucket[order], ids[:, order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    names = lang.dictionary.to_pylist()
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, local = np.unique(ids[:, a:z], return_inverse=True)
        held = own[own > 0]
        if len(held) == len(own):  # no suffix ends early: places count from 1 all the same
            local = local + 1
        yield int(bucket[a]) // len(names), names[int(bucket[a]) % len(names)], words.dictionary.take(pa.array(held - 1)), local.reshape(max_n, z - a).astype("<u2" if len(held) < 1 << 16 else "<u4"), counts[a:z]


def prefix_counts(ids: np.ndarray, counts: np.ndarray, least: int, split: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(suffix, length, count) of every prefix of two words or more with `least` occurrences, and of those whose words all are `split`.

    ids: suffixes in reverse lexicographic order, words counted from 1, 0 behind the end.
    """
    max_n, n = ids.shape
    length = (ids > 0).sum(axis=0)
    same = np.zeros(n, np.int64)
    if n > 1:
        same[1:] = np.cumprod(ids[:, 1:] == ids[:, :-1], axis=0).sum(axis=0)
        same[1:] = np.minimum(same[1:], np.minimum(length[1:], length[:-1]))
    all_hot = np.cumprod(split[ids], axis=0).sum(axis=0)  # how many words from the first on are hot
    rows, depths, found = [], [], []
    stack = [0] * (max_n + 1)
    depth, before, hot_before = 0, 0, 0
    for i, (shared, size, count, hot_now) in enumerate(zip(same.tolist(), length.tolist(), counts.tolist(), all_hot.tolist(), strict=True)):
        while depth > shared:
            total = stack[depth]
            if depth > 1 and (total >= least or depth < max_n and depth <= hot_before):
                rows.append(before)
                depths.append(depth)
                found.append(total)
            stack[depth] = 0
            depth -= 1
            stack[depth] += total
        depth = size
        stack[depth] += count
        before, hot_before = i, hot_now
    while depth > 1:
        total = stack[depth]
        if total >= least or depth < max_n and depth <= hot_before:
            rows.append(before)
            depths.append(depth)
            found.append(total)
        depth -= 1
        stack[depth] += total
    return rows, depths, found


def _count_bucket(lang: str, blobs: list[tuple[pa.Array, np.ndarray, np.ndarray]], least: int, hot: pa.Array) -> pa.RecordBatch:
    every = pa.chunked_array([w for w, _, _ in blobs]).combine_chunks().dictionary_encode()
    words = every.dictionary
    order = pc.sort_indices(words.cast(pa.binary())).to_numpy()
    place = np.empty(len(order) + 1, np.int32)
    place[order + 1] = np.arange(1, len(order) + 1)
    place[0] = 0
    words = words.take(pa.array(order))
    start, parts, at = 0, [], every.indices.to_numpy()
    for w, local, _ in blobs:
        parts.append(place[np.concatenate(([0], at[start : start + len(w)] + 1))[local]])
        start += len(w)
    ids, counts = np.concatenate(parts, axis=1), np.concatenate([c for _, _, c in blobs])
    max_n = len(ids)
    split = np.append(False, pc.is_in(words, value_set=hot).to_numpy(zero_copy_only=False))
    # a pair of too few occurrences has no prefix to count
    pair = ids[0].astype(np.int64) << 32 | ids[1]
    _, which = np.unique(pair, return_inverse=True)
    keep = (np.bincount(which, weights=counts) >= least)[which] | split[ids[0]] & split[ids[1]]
    ids, counts = ids[:, keep], counts[keep]
    order = np.lexsort(_packed(ids))[::-1]
    ids, counts = ids[:, order], counts[order]
    rows, depths, found = prefix_counts(ids, counts, least, split)
    depths = np.array(depths, np.int64)
    cuts = np.concatenate(([0], np.cumsum(depths)))
    flat = ids[np.arange(cuts[-1]) - np.repeat(cuts[:-1], depths), np.repeat(np.array(rows, np.int64), depths)] - 1
    phrases = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words.take(pa.array(flat)).cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), phrases, pa.array(found, pa.int64())], names=["lang", "words", "f"])


def phrase_counts(docs: DataFrame, counts: DataFrame, max_n: int = 4, least: int = 30) -> DataFrame:
    """(lang, words, f): the phrases of 2 to max_n words with at least `least` occurrences. docs has lang and text, counts the words' (lang, word, f)."""
    total = counts.agg(F.sum("f")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    hot = pa.array([r["word"] for r in counts.groupBy("word").agg(F.sum("f").alias("f")).filter(F.col("f") * SPLIT >= total).collect()], pa.large_string())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_by_batch(batches, BATCH_BYTES):
            found = list(suffixes(b, max_n, buckets, hot))
            for k in range(0, len(found), 64):
                bucket, lang, words, ids, n = zip(*found[k : k + 64], strict=True)
                cuts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), pa.array(lang, pa.string()), pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays(words).cast(pa.string())), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in n], pa.binary())],
                    names=["bucket", "lang", "words", "ids", "counts"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            key = list(zip(b.column("bucket").to_pylist(), b.column("lang").to_pylist(), strict=True))
            for i, k in enumerate(key):
                if k != now:
                    if blobs:
                        yield _count_bucket(now[1], blobs, least, hot)
                    now, blobs = k, []
                words = b.column("words")[i].values.cast(pa.large_string())
                n = np.frombuffer(b.column("counts")[i].as_py(), "<u4").astype(np.int64)
                ids = np.frombuffer(b.column("ids")[i].as_py(), "<u2" if len(words) < 1 << 16 else "<u4").astype(np.int32).reshape(max_n, len(n))
                blobs.append((words, ids, n))
        if blobs:
            yield _count_bucket(now[1], blobs, least, hot)

    schema = "bucket bigint, lang string, words array<string>, ids binary, counts binary"
    blobs = docs.select("lang", "text").mapInArrow(slim(emit), schema).repartition("bucket").sortWithinPartitions("bucket", "lang")
    partial = blobs.mapInArrow(slim(count), "lang string, words array<string>, f bigint")
    return partial.groupBy("lang", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = 30, max_n: int = 4, top: int = 2000, contained: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language."""
    rows = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), named(text).alias("text")).filter("text IS NOT NULL")
    counts = written(rows.mapInArrow(slim(_word_counts), "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    grams = written(phrase_counts(rows, counts, max_n, least), "phrases")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = grams.unionByName(counts.filter(F.col("f") >= least).select("lang", F.array("word").alias("words"), "f"))
    size = F.size("words")
    # the score of each cut: the parts' counts are there, as they are no smaller than the phrase's
    cut = grams.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("words", 1, F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(parts.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast((cast(2000000 AS decimal(20,0)) * a) div (cast(l AS decimal(20,0)) + r) AS bigint)")
    scored = cut.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # the largest count of a longer phrase around it
    spans = [(i, n) for n in range(2, max_n) for i in range(1, max_n - n + 2)]
    within = F.filter(F.array(*(F.when(F.lit(i + n - 1) <= size, F.slice("words", i, n)) for i, n in spans)), lambda x: x.isNotNull() & (F.size(x) < size))
    around = grams.select("lang", F.explode(within).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("around"))
    kept = scored.join(around, ["lang", "words"], "left").filter(F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < contained * F.col("a").cast("decimal(20,0)")))
    phrase = F.array_join("words", " ")
    ranked = kept.select("lang", phrase.alias("phrase"), "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
z AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - m.m + 2), lambda i: ws[i : i + m.m - 1])) AS ws FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) m),
f AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len(ws) > 1),
k AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM c),
s AS (
  SELECT k.lang, k.ws, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.ws = k.ws[1 : k] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[k + 1 :]
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.ws ORDER BY score, k) = 1
),
i AS (
  SELECT lang, sub AS ws, max(f) AS around
  FROM (SELECT lang, f, ws, unnest(list_concat(CASE WHEN len(ws) > 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i : i + 1]) ELSE [] END, CASE WHEN len(ws) > 3 THEN [ws[1:3], ws[2:4]] ELSE [] END)) AS sub FROM c)
  GROUP BY ALL
),
o AS (SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN i ON i.lang = s.lang AND i.ws = s.ws WHERE around IS NULL OR 100 * around < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN z USING (lang) WHERE rank <= 2000
"""
