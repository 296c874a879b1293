"""Suffix-sigma against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.llm import collocations as c

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, max_n=4, top=2000, contained=80):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + m]) for m in range(1, max_n + 1) for i in range(len(ws) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in cand.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                inside[p[0], *p[i : i + m]] = max(inside[p[0], *p[i : i + m]], a)
    out = []
    for p, a in cand.items():
        if 100 * inside[p] >= contained * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[p[: k + 1]] + f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    rows = []
    for lang in n:
        own = sorted(x for x in out if x[0] == lang)[:top]
        rows += [(lang, i + 1, x[3].decode(), -x[2], x[4], x[5], n[lang], -x[1]) for i, x in enumerate(own)]
    return sorted(rows)


def corpus(n=400, seed=5):
    r = random.Random(seed)
    words = ["the", "of", "a", "b", "New", "york", "Straße", "É", "x-y", "中文", "c", "d"]
    out = []
    for i in range(n):
        text = "".join(r.choices(words, weights=range(12, 0, -1))[0] + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randrange(60)))
        out.append((i, text, r.choice(["en", "de", None, "und"])))
    return out + [(1, "the the " * 4000, "en"), (1, "New York City, " * 50, "en"), (1, "New York City, " * 50, "en"), (None, "a b c d " * 40, "fr"), (7, None, "en"), (8, "", "de"), (9, " .,; ", "xx"), (10, "one two", "yy")]


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("words", "split", "max_n"), [(10**6, 1024, 4), (500, 12, 4), (300, 10**9, 4), (500, 4, 3), (700, 20, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, words, split, max_n):
    monkeypatch.setattr(c, "BUCKET_WORDS", words)
    monkeypatch.setattr(c, "SPLIT", split)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    assert rows(c.collocations(df, max_n=max_n)) == brute(docs, 30, max_n)


def test_ranks_are_cut_and_ties_go_to_the_phrase(spark):
    docs = [(i, f"{a} {b}. " * 30, "en") for i, (a, b) in enumerate((x, y) for x in "éaZb" for y in "mno")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").select("*", *(F.lit(1).alias(x) for x in ("f", "words", "rank", "a.b")))
    assert rows(c.collocations(df, top=5)) == brute(docs, 30, top=5)


def test_long_text_and_wide_batch(spark, monkeypatch):
    monkeypatch.setattr(c, "BATCH_BYTES", 1 << 14)
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(4000)), "en") for i in range(12)]
    assert rows(c.collocations(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))) == brute(docs, 30)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_one_stack_counts_prefixes():
    """Suffixes in reverse order: each prefix is counted when it leaves the stack."""
    suffixes = sorted([(2, 1, 3, 3), (2, 1, 3, 0), (2, 1, 3, 0), (2, 1, 0, 0), (1, 2, 0, 0), (1, 1, 1, 1)], reverse=True)
    ids, n = np.array(suffixes).T, np.array([5, 1, 1, 7, 2, 9])
    found = {(tuple(ids[:d, i]), k) for i, d, k in zip(*c.prefix_counts(ids, n, 1, np.zeros(4, bool)), strict=True)}
    assert found == {((2, 1), 14), ((2, 1, 3), 7), ((2, 1, 3, 3), 5), ((1, 2), 2), ((1, 1), 9), ((1, 1, 1), 9), ((1, 1, 1, 1), 9)}


def test_counts_beyond_64_bits(spark):
    """A product of a count and 2,000,000 that passes 64 bits."""
    a = spark.createDataFrame([(10**13, 10**13, 3 * 10**13)], "a bigint, l bigint, r bigint")
    assert a.select(F.expr("cast((cast(2000000 AS decimal(20,0)) * a) div (cast(l AS decimal(20,0)) + r) AS bigint)")).first()[0] == 500_000
