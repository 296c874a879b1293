import random
import re

import pytest
from pyspark.sql import functions as F

from tidesmith.functions import text as T


@pytest.mark.parametrize(
    "given, want",
    [("二零二六", "2026"), ("一九九零", "1990"), ("零", "0"), ("二零二六年四月", "2026年4月"), ("十二", "12"), ("一百零一", "101"), ("三千零五", "3005"), ("两万零一", "20001"),
     ("一亿两千万", "120000000"), ("三个五", "3个5"), ("两个人", "2个人"), ("一百二", "102"), ("一万亿", "100000000"), ("万一", "10001"), ("", "")],
)
def test_numerals(spark, given, want):
    assert spark.range(1).select(T.arabic_numerals(F.lit(given))).first()[0] == want


def section(text):
    text = re.sub("[万亿]", "", text)
    total = sum((T.DIGITS.get(d) or 1) * T.UNITS[u] for d, u in re.findall(f"([{''.join(T.DIGITS)}]?)([十百千])", text))
    return total + T.DIGITS.get(text[-1:], 0)


def numerals(text):
    def value(run):
        if not set(run) & set("十百千万亿"):
            return "".join(str(T.DIGITS[c]) for c in run)
        parts = re.fullmatch("(?:(.*?)亿)?(?:(.*?)万)?(.*)", run).groups()
        return str(sum(scale * (section(p) if p else 1) for p, scale in zip(parts, (10**8, 10**4)) if p is not None) + section(parts[2]))

    return re.sub(T.RUN + "+", lambda m: value(m[0]), text)


def test_ten_thousand_runs_equal_a_reading_by_patterns(spark):
    r = random.Random(5)
    kinds = ["".join(T.DIGITS), "".join(T.DIGITS) + "十百千", "".join(T.DIGITS) + "十百千万亿", "十百千万亿", "一二三四五六七八九十百千万亿零x \n年é9"]
    texts = ["".join(r.choices(r.choice(kinds), k=r.randrange(1, 14))) for _ in range(10_000)] + ["", None, "万" * 300, "零" * 400, "九千" * 200 + "亿"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for k, text in df.select("k", T.arabic_numerals(F.col("t"))).collect():
        assert text == (None if texts[k] is None else numerals(texts[k])), texts[k]


def test_normalisation(spark):
    rows = [("ＡＢＣ１２３",), ("「引用」·间隔号",), ("戰鬥英雄和轉業戰士",), ("a　b  c",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(T.for_cer(F.col("t"))).collect()]
    assert got[0] == "abc123" and got[1] == "引用间隔号" and got[2].startswith("战斗英雄") and got[3] == "abc" and got[4] is None


def test_error_rates(spark):
    rows = [("我爱北京天安门", "我爱北京天按门"), ("", ""), ("", "x"), ("the quick brown fox", "the quick brown dog"), ("a", "a b c")]
    df = spark.createDataFrame(rows, "r string, h string").coalesce(1)
    out = df.select(T.cer(F.col("r"), F.col("h")), T.wer(F.col("r"), F.col("h"))).collect()
    assert abs(out[0][0] - 1 / 7) < 1e-12 and [out[1][0], out[2][0], out[1][1], out[2][1]] == [0, 1, 0, 1]
    assert out[3][1] == 0.25 and out[4][1] == 2.0


def test_whole_table_error_rates_equal_brute_force(spark, sf_dir):
    from tidesmith.plans import texts

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    found = texts.cer_pairs(spark, sf_dir).collect()
    held = sorted(turns)
    before = {b: turns[a] for a, b in zip(held, held[1:]) if a[0] == b[0] and turns[a] is not None}
    assert len(found) == len(before)
    for r in found[:60]:
        ref, hyp = before[r["conv_id"], r["turn"]], turns[r["conv_id"], r["turn"]]
        if hyp is not None:
            assert r["cer"] == round(distance(ref, hyp) / len(ref) if ref else float(bool(hyp)), 6)
