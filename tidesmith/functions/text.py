"""Normalisation of transcripts and error rates."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Chinese digits, units and section units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SECTIONS = {"万": 10**4, "亿": 10**8}
RUN = f"[{''.join([*DIGITS, *UNITS, *SECTIONS])}]"
#: ASCII symbols that count as punctuation though Unicode has them as symbols.
SYMBOLS = "$+<=>^`|~"
#: A small table from traditional to simplified characters, by pairs; a whole one is a parameter.
TRADITIONAL = "戰鬥轉業雄個兩萬億電話國學說語時間們這還沒對會來點開門馬鳥魚車東長見風飛"
SIMPLIFIED = "战斗转业雄个两万亿电话国学说语时间们这还没对会来点开门马鸟鱼车东长见风飞"


def section(part: Column) -> Column:
    """Value of a run below 万: each unit times the digit right before it (1 if there is none or it is zero), and a digit at the end; section units are passed over. A fold over its characters that holds the sum and the last digit."""
    digit = F.translate(part, "".join(DIGITS), "".join(map(str, DIGITS.values())))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("last"))

    def step(s: Column, c: Column) -> Column:
        unit = F.lit(None).cast("bigint")
        for name, worth in UNITS.items():
            unit = F.when(c == name, F.lit(worth).cast("bigint")).otherwise(unit)
        number = F.when(unit.isNull(), F.try_to_number(c, F.lit("9")).cast("bigint"))
        return F.struct((s["sum"] + F.coalesce(F.greatest(s["last"], F.lit(1)) * unit, F.lit(0))).alias("sum"), F.when(unit.isNotNull(), F.lit(0).cast("bigint")).otherwise(number).alias("last"))

    characters = F.filter(F.split(F.translate(digit, "".join(SECTIONS), ""), ""), lambda c: c != "")
    return F.aggregate(characters, start, step, lambda s: s["sum"] + s["last"])


def run_value(run: Column) -> Column:
    """A run with a unit is a number: the parts before the first 亿, then before the first 万, and the rest, where a part that is left out counts once. Without a unit it is read digit by digit."""
    total, rest = F.lit(0).cast("bigint"), run
    for name, scale in sorted(SECTIONS.items(), key=lambda x: -x[1]):
        there = F.contains(rest, F.lit(name))
        part = F.substring_index(rest, name, 1)
        total = total + F.when(there, scale * F.when(part == "", F.lit(1).cast("bigint")).otherwise(section(part))).otherwise(F.lit(0).cast("bigint"))
        rest = F.when(there, F.substring(rest, F.length(part) + 2, F.length(rest))).otherwise(rest)
    counted = F.rlike(run, F.lit(f"[{''.join([*UNITS, *SECTIONS])}]"))
    return F.when(counted, (total + section(rest)).cast("string")).otherwise(F.translate(run, "".join(DIGITS), "".join(map(str, DIGITS.values()))))


def arabic_numerals(x: Column) -> Column:
    """Runs of Chinese numerals as Arabic ones, with built-in functions alone: the text is cut into runs and what lies between."""
    parts = F.regexp_extract_all(x, F.lit(f"(?s){RUN}+|{RUN.replace('[', '[^')}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(f"^{RUN}")), run_value(p)).otherwise(p)), "")


@pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(x: Column) -> Column:
    """Compatibility forms folded. There is no built-in function for it; texts of ASCII alone, which have none, are not sent to Python's."""
    return F.when(F.rlike(x, F.lit(r"^\p{ASCII}*$")), x).otherwise(_folded(F.when(~F.rlike(x, F.lit(r"^\p{ASCII}*$")), x)))


def simplify(x: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    """Character by character; phrases are not looked at."""
    return F.translate(x, traditional, simplified)


def strip_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{P}$+<=>^`|~]", "")


def _common(x: Column) -> Column:
    return F.lower(strip_punctuation(arabic_numerals(nfkc(simplify(x)))))


def for_cer(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(_common(x), r"(?U)\s+", "")


def for_wer(x: Column) -> Column:
    """With single spaces between words."""
    return F.trim(F.regexp_replace(_common(x), r"(?U)\s+", " "))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; for an empty reference 1 if there is a hypothesis, else 0."""
    return F.when(F.length(reference) == 0, (F.length(hypothesis) > 0).cast("double")).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of word arrays: each distinct word of the two becomes a character of its own, and the built-in distance counts characters."""
    # code points beyond the first plane, so that none is half of a pair
    as_text = lambda words, known: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0")), "")), "UTF-32")
    once = F.array(F.array_distinct(F.concat(reference, hypothesis)))  # a variable of one value: not worked out for each word
    return F.element_at(F.transform(once, lambda known: F.levenshtein(as_text(reference, known), as_text(hypothesis, known))), 1)


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word errors over the reference's words; texts are split at single spaces."""
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    r, h = words(reference), words(hypothesis)
    return F.when(F.size(r) == 0, (F.size(h) > 0).cast("double")).otherwise(word_distance(r, h) / F.size(r))
