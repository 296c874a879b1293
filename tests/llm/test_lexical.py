"""Block-Max WAND against a search that scores every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidesmith.llm.lexical import Postings, Shard, block_max_search, lengths, part, term_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    held = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    asks: dict = {}
    for i, t in items:
        if i is not None:
            asks.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asks.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in terms if (df := sum(t in w for _, w in held))}
        scores = []
        for i, w in held:
            if i is not None and w:
                m = 10 + 90 * len(w) * n_docs // n_terms
                s = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in weight if t in w)
                if s > 0:
                    scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def texts(n, seed=3):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É", "straße", "don't", "x1"]
    return [" ".join(r.choices(pool, weights=[1 / (1 + i) for i in range(len(pool))], k=r.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("shard_docs", "block"), [(1 << 15, 64), (50, 4), (7, 1)])
def test_search_equals_brute_force(spark, shard_docs, block):
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w59"), (400, None), (401, ""), (402, " .. "), (403, "W59 w59, w58." + " w7" * 3000), (404, "w0 " * 20_000)]
    items = [(1, "w1 w2 w3"), (2, "w59 W58 w57 w0 w1"), (2, "w40"), (3, None), (4, ""), (5, "nothing here"), (None, "w1"), (6, "É don't STRASSE straße w0"), (7, " ".join(f"w{i}" for i in range(60)))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(block_max_search(d, q, shard_docs=shard_docs, block=block)) == brute(docs, items)


def test_ties_repeated_rows_and_extra_columns(spark):
    docs = [(i, "same words here") for i in range(40)] + [(3, "same words here")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in ("id", "term", "segment", "score", "a.b")))
    q = spark.createDataFrame([(1, "words"), (2, "absent")], "item_id bigint, text string").withColumn("item", F.lit(7))
    assert rows(block_max_search(d, q, k=5, block=2)) == brute(docs, [(1, "words"), (2, "absent")], 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert block_max_search(none, item).count() == 0
    assert block_max_search(spark.createDataFrame([(1, "w1")], "doc_id bigint, text string"), item.limit(0)).count() == 0


def test_blocks_hold_what_was_packed():
    r = np.random.default_rng(1)
    docs = np.unique(np.concatenate([r.integers(0, 10**8, 500), np.arange(50)]))
    tf, m = np.where(r.random(len(docs)) < 0.05, 70_000, r.integers(1, 9, len(docs))), np.full(10**8, 100, np.int64)
    p = Postings(docs, tf, m)
    unpacked = [p.block(b) for b in range(len(p.last))]
    assert sum((d for d, _ in unpacked), []) == docs.tolist() and sum((c for _, c in unpacked), []) == tf.tolist()
    assert [max(part(c, 100) for c in cs) for _, cs in unpacked] == p.high and [d[-1] for d, _ in unpacked] == p.last


def test_blocks_are_skipped_unpacked():
    """Rare terms lift the floor; most blocks of the common one cannot pass it."""
    n = 20_000
    common, rare = np.arange(n), np.arange(0, n, 997)
    m = np.full(n, 100, np.int64)
    shard = Shard(np.arange(n), m, {"common": (common, np.ones(n, np.int64)), "rare": (rare, np.full(len(rare), 3))}, block=64)
    unpacked = []
    Postings.block, kept = (lambda f: (lambda self, b: unpacked.append(b) or f(self, b)))(Postings.block), Postings.block
    try:
        found = shard.best([("common", 100), ("rare", 9000)], 10)
    finally:
        Postings.block = kept
    assert [i for _, i in found] == rare[:10].tolist()
    assert shard.scored < 100 and len(unpacked) < 40


def test_terms_and_lengths():
    of, terms = term_runs(pa.array(["Ab-cD é1 x", None, "", "__"]))
    assert terms.to_pylist() == ["ab", "cd", "é1 x"] and of.tolist() == [0, 0, 0]
    assert lengths(np.array([10**9, 3]), 10**12, 10**13).tolist() == [10 + 90 * 10**8, 10 + 27]
