"""Phrase conversion against trying every length at every place."""

import random

import pytest

from tidesmith.functions import text as T
from tidesmith.operators import phrases


def brute(text, table):
    out, at, most = [], 0, max(map(len, table), default=0)
    while at < len(text):
        for n in range(min(most, len(text) - at), 0, -1):
            if text[at : at + n] in table:
                out.append(table[text[at : at + n]])
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_longest_phrases_win():
    r = random.Random(3)
    for _ in range(400):
        table = {"".join(r.choices("abcd", k=r.randrange(1, 6))): f"<{k}>" for k in range(r.randrange(0, 12))}
        own = phrases.Automaton(table)
        for _ in range(20):
            text = "".join(r.choices("abcde", k=r.randrange(0, 30)))
            assert own.convert(text) == brute(text, table), (table, text)


def test_a_phrase_goes_before_its_characters(spark):
    table = dict(zip(T.TRADITIONAL, T.SIMPLIFIED)) | {"乾": "干", "乾坤": "乾坤", "電話": "电话", "電話亭": "公话亭"}
    df = spark.createDataFrame([(1, "乾坤電話亭"), (2, "乾電話東"), (3, None), (4, "")], "k int, t string")
    known = spark.createDataFrame([*table.items(), ("", "x")], "source string, target string")
    assert [r["t"] for r in phrases.convert(df, "t", known).orderBy("k").collect()] == ["乾坤公话亭", "干电话东", None, ""]
    assert phrases.convert(df.limit(0), "t", known).count() == 0 and phrases.convert(df, "t", known.limit(0)).count() == 4
    with pytest.raises(ValueError):
        phrases.convert(df, "t", known.union(spark.createDataFrame([("乾", "乾")], "source string, target string")))


def test_long_texts_take_linear_time():
    import time

    own = phrases.Automaton({"a" * 50 + "b": "x", "aa": "y"})
    began = time.perf_counter()
    assert len(own.convert("a" * 200_000)) == 100_000
    assert time.perf_counter() - began < 10
