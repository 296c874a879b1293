"""Personal data by fixed patterns and by bootstrapped context.

Fixed patterns find emails, IP addresses, card numbers and phone numbers. These
are the seeds. Each occurrence, and each other token that looks like an
identifier (an @, or five digits at least; or groups of digits, seven in all at
least, with single spaces, hyphens or brackets between), has lexical patterns:
the two words before it, the word before it, the word after it. In the graph of patterns and
instances (distinct strings) confidence goes to and fro: a pattern is worth to a
kind the share of that kind in the confidence of its instances, where those of
no known kind count in part, and few instances count for less; an instance's
confidence is the noisy-or over its patterns. After some rounds the
tokens that confident patterns vouch for are spans too. Fixed spans always
stay, and found ones never overlap a fixed one.

Null and empty texts have no spans. Offsets are code points, ends exclusive.
Texts are read whole, in linear time. Repeated rows are judged alike; an
instance with equal confidence for two kinds, a tie, is of the first one listed.
An empty table gives an empty one. Extra columns of any name are untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, slim, table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: The same matches as [0-9]+(\.[0-9]+){3} from the left, without trying the rest of a run of digits again.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IDENTIFIER = re.compile(r"@|[0-9](?:[^\s0-9]{0,3}[0-9]){4}")
GROUPS = re.compile(r"(?<![0-9])[(]?[0-9]++(?:[)]?[\x20-][(]?[0-9]++|[)][(]?[0-9]++)++")
WORD = re.compile(r"\S+")
#: Rounds, distinct seeds that a pattern needs, worth that a pattern needs, confidence that a found span needs.
ROUNDS, SUPPORT, WORTH, CONFIDENT = 3, 8, 0.8, 0.85
#: What an instance of no known kind takes from a pattern's worth.
UNKNOWN = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards, so in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        elif start < at:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of KINDS, then by start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []
    return found


def _short(word: str) -> str:
    """The word itself, or a hash of a long one."""
    return word if len(word) <= 64 else f"#{xxhash.xxh64_hexdigest(word.encode())}"


def _cue(word: str) -> str:
    return _short(word.strip(".,;:!?\"'()[]<>").lower())


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind or -1, start, end, instance, patterns) of the seeds and of other tokens like identifiers."""
    if not (DIGIT.search(text) or "@" in text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    near = [m.span() for m in GROUPS.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 19]
    found = list(spans)
    taken = sorted((a, b) for _, a, b in spans)
    for other in (near, words):  # a token is none if it meets a group of digits that is one
        k, more = 0, []
        for a, b in other:
            if other is words and not IDENTIFIER.search(text, a, b):
                continue
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a < b and not (k < len(taken) and taken[k][0] < b):
                more.append((a, b))
        found += [(-1, a, b) for a, b in more]
        taken = sorted(taken + more)
    begins = [a for a, _ in words]
    out = []
    for kind, a, b in found:
        at = bisect_right(begins, a) - 1  # the word in which it begins
        before = [text[x:y] for x, y in words[max(0, at - 2) : max(at, 0)]]
        left = [_cue(w) for w in before if not DIGIT.search(w)]
        cues = [f"<{left[-1]}"] if left and left[-1] else []
        if len(left) == 2 and all(left):
            cues.append(f"<{left[0]} {left[1]}")
        at = bisect_right(begins, b)  # the first word after its last one
        if b < len(text) and text[b].isspace() and at < len(words):
            after = text[slice(*words[at])]
            if not DIGIT.search(after) and _cue(after):
                cues.append(f">{_cue(after)}")
        surface = text[a:b].lower()
        out.append((kind, a, b, _short(surface if "@" in surface else re.sub(r"[^0-9a-z]", "", surface)), cues))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")]))
MENTIONS = T.ArrayType(T.StructType([*SPANS.elementType.fields, T.StructField("instance", T.StringType()), T.StructField("cues", T.ArrayType(T.StringType()))]))


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, base, mentions)"""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("cues", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, found = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                found.append([{"kind": k, "start": s, "end": e, "instance": i, "cues": c} for k, s, e, i, c in mentions(t, base)])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text_hash"), pa.array(spans, span), pa.array(found, mention)], names=["key", "text_hash", "base", "mentions"])

    rows = docs.select(named(key).alias("key"), F.xxhash64(named(text)).alias("text_hash"), named(text).alias("text"))
    return rows.mapInArrow(slim(run), T.StructType([*rows.schema.fields[:2], T.StructField("base", SPANS), T.StructField("mentions", MENTIONS)]))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, worth: float = WORTH) -> DataFrame:
    """(instance, kind, confidence) of unseen instances, from edges (cue, instance, kind or -1; distinct)."""
    seeds = edges.filter("kind >= 0").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("confidence", F.lit(1.0))
    # only patterns with enough seeds of one kind can ever be worth anything
    able = edges.filter("kind >= 0").groupBy("cue", "kind").agg(F.countDistinct("instance").alias("seeds")).filter(F.col("seeds") >= support).select("cue").distinct()
    graph = written(edges.join(able, "cue", "left_semi").select("cue", "instance").distinct(), "pii-graph")
    sizes = graph.groupBy("cue").agg(F.count(F.lit(1)).alias("size"))
    known = written(seeds, "pii-known")
    for _ in range(rounds):
        scored = graph.join(known, "instance").groupBy("cue", "kind").agg(F.sum("confidence").alias("mass"), F.count(F.lit(1)).alias("known"))
        every = scored.groupBy("cue").agg(F.sum("mass").alias("masses"), F.sum("known").alias("knowns"))
        patterns = scored.join(every, "cue").join(sizes, "cue").withColumn("worth", F.col("mass") / (F.col("masses") + UNKNOWN * (F.col("size") - F.col("knowns")) + 1)).filter((F.col("worth") >= worth) & (F.col("mass") >= support))
        votes = graph.join(patterns.select("cue", "kind", "worth"), "cue").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("confidence"))
        best = votes.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence"))
        known = written(seeds.unionByName(best.join(seeds, "instance", "left_anti")), "pii-known")
    return known.join(seeds.select("instance"), "instance", "left_anti")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """(key, text_hash, base, found): the fixed spans and those that the bootstrapped patterns add; text_hash is Spark's xxhash64 of the text."""
    seen = written(_scan(docs, key, text), "pii-mentions")
    each = seen.select("key", "text_hash", F.explode("mentions").alias("m")).select("key", "text_hash", "m.*")
    edges = each.select(F.explode("cues").alias("cue"), "instance", "kind").distinct()
    new = bootstrap(edges).filter(F.col("confidence") >= confident).select("instance", F.col("kind").alias("as"))
    added = each.filter("kind < 0").join(new, "instance").groupBy(F.col("key").alias("k2"), F.col("text_hash").alias("h2")).agg(F.sort_array(F.collect_set(F.struct(F.col("as").cast("int").alias("kind"), "start", "end"))).alias("found"))
    none = F.array().cast(SPANS)
    return seen.join(added, F.col("key").eqNullSafe(F.col("k2")) & (F.col("text_hash") == F.col("h2")), "left").select(F.col("key").alias(key), "text_hash", "base", F.coalesce("found", none).alias("found"))


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; the columns stay as they are, but n_chars, which follows the text.

    Fixed spans are found again where the text is; only found ones are joined,
    from a written table, so that Spark knows its size and leaves the texts in
    place if it is small.
    """
    added = find_pii(docs, key, text).filter(F.size("found") > 0).select(named(key).alias("k2"), F.col("text_hash").alias("h2"), "found").dropDuplicates(["k2", "h2"])
    rows = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), named(key).alias("k1"), F.xxhash64(named(text)).alias("h1"))
    joined = rows.join(written(added, "pii-found"), F.col("k1").eqNullSafe(F.col("k2")) & (F.col("h1") == F.col("h2")), "left").select("row", "found")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, out = b.column("row").flatten(), []
            for t, more in zip(columns[at], b.column("found"), strict=True):
                t = t.as_py()
                if t:
                    spans = {(s, e, k) for k, s, e in base_spans(t)} | {(s["start"], s["end"], s["kind"]) for s in more.as_py() or ()}
                    if spans:
                        parts, end = [], 0
                        for a, e, k in sorted(spans):
                            if a >= end:
                                parts += [t[end:a], f"<{KINDS[k].upper()}>"]
                            end = max(end, e)
                        t = "".join([*parts, t[end:]])
                out.append(t)
            columns[at] = pa.array(out, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(slim(run), T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema]))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # not lambda s, k=k: a second parameter is the place in the array
    counts = (F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{name}") for kind, name in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "found")).alias("spans"))
