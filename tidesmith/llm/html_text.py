"""Main text of web pages with suffix arrays over the pages of a host.

A page is parsed into blocks, each within a marked article or outside, and
dropped by its markup or not (menus, headers, footers, sidebars, forms, scripts,
comments, adverts, notices). The token streams of a host's pages are
concatenated and a suffix array finds the runs of RUN tokens that distinct
pages repeat; rows with equal token streams are one page. Outside an article a
run that PAGES pages of the host have is boilerplate, inside one only a run that
more than half of the host's pages have, since articles may share passages and
must keep them. A block goes if its markup says so; of the others, those go that
such runs cover mostly; the unique runs stay. What markup drops anyway takes no
part in the arrays. A page whose own text (its
article, or all that markup leaves of it if none is marked) is covered by COPY
at least is a copy of others and keeps that text. On a host of fewer than PAGES
pages nothing can repeat and the mark alone decides.

A host of more than CHARS characters is dealt over many arrays. Each reports its
runs with the numbers of its pages; the sums over the host decide, and go back
to the arrays that hold the run. So a page's text is the same for any batch
size, partitioning and order of rows. Inside articles, where a run must be on
most pages, an array reports only runs on more than a quarter of its pages: one
that is on most pages of the host is reported by arrays enough to be a
candidate, and candidates are then counted everywhere.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by a line break. Null and empty
pages give the empty text. A null url is the host without a name. Long pages
are read whole. Repeated rows give repeated results. An empty table gives an
empty one. Extra columns are untouched, but for result names, which are
replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, slim, table, written
from .wordscan import Scan, mix

#: A repeated run has so many tokens, and lies on so many pages at least.
RUN, PAGES = 6, 3
#: A page of whose own text runs cover this share is a copy.
COPY = 0.85
#: Characters of HTML for one suffix array.
CHARS = 2_400_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
TAG_MARKS = re.compile("[>\"']")
ATTRIBUTES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option button xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form menu fieldset audio video map".split())
#: What holds running text: within an article its class and id decide nothing.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption summary span em strong b i a code q mark small sub sup".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|share|sharing|social|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|comments?|comment-list|disqus|related|recommend\w*|widget|toolbar|skip-link|login|signup)(?:$|[\s_-])", re.I)
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where a tag ends whose name ends at `at`: at the first > outside quotes, or with the page. A quote that is the last of its kind opens nothing (`last` has where those are), so no scan is in vain."""
    while m := TAG_MARKS.search(page, at):
        at, mark = m.end(), m[0]
        if mark == ">":
            return at
        if m.start() < last[mark]:
            at = page.index(mark, at) + 1
    return len(page)


def _away(attributes: str, whole: bool) -> bool:
    """Whether attributes say that an element is none of the page's text. `whole`: a class or an id must be such a word, not only have one as a part."""
    for name, value in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and (any(AWAY.fullmatch(x) for x in value.split()) if whole else AWAY.search(value)) or name == "role" and value.lower() in AWAY_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "itemprop" and value.lower() == "comment":
            return True
    return False


def blocks(page: str, markup: bool = True) -> list[tuple[str, bool, bool]]:
    """(text, within an article, dropped by its markup) of the blocks of a page; without `markup` no block is either."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, begins an article, begins what is dropped
    open_tags: Counter[str] = Counter()
    inside = dropped = at = 0

    def close() -> None:
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, markup and inside > 0, markup and dropped > 0))

    def pop() -> str:
        nonlocal inside, dropped
        name, a, d = stack.pop()
        open_tags[name] -= 1
        inside, dropped = inside - a, dropped - d
        return name

    n = len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        at = tag_end(page, at, last)
        attributes = page[m.end() : at].removesuffix(">")
        if m[1]:  # an end tag
            if name in BLOCKS or name in DROPPED:
                close()
            if open_tags[name] > 0:  # a stray one ends nothing
                while pop() != name:
                    pass
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = page.find(">", end.end()) + 1 or n if end else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        elif name in BLOCKS or name in DROPPED:
            close()
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:  # an end tag left out
            pop()
        d = name in DROPPED and not (name == "header" and inside > 0) or bool(attributes) and not (inside > 0 and name in TEXTUAL) and _away(attributes, inside > 0)
        a = name in MAIN and not d
        if name not in MAIN and 'role="main"' in attributes.lower():
            a = True
        stack.append((name, a, d))
        open_tags[name] += 1
        inside, dropped = inside + a, dropped + d
    close()
    return out


def packed_blocks(page: str | None, markup: bool = True) -> bytes:
    """The blocks of a page, compressed: a digit for each (1: within an article, 2: dropped), then a line for each."""
    import zstandard as zs

    found = blocks(page, markup) if page else []
    if not found:
        return b""
    flags = "".join(str(inside + 2 * dropped) for _, inside, dropped in found)
    return zs.ZstdCompressor(level=3).compress("\n".join([flags, *(t for t, _, _ in found)]).encode())


def suffix_array(tokens: np.ndarray, upto: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in the order of their first `upto` tokens at least, and the ranks by 1, 2, 4, ... tokens (prefix doubling)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, k, n = [rank], 1, len(tokens)
    order = np.argsort(rank, kind="stable")
    while k < upto:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        ranks.append(rank)
        k *= 2
    return order, ranks


class Pages:
    """The token streams of some pages, without what markup drops, one after another, each with a border of its own so that no run crosses it."""

    def __init__(self, hosts: np.ndarray, pages: list[bytes], run: int = RUN):
        self.run, self.hosts = run, hosts
        self.flags, self.texts, sizes, tokens = [], [], [], []
        waiting: list[str] = []
        weight = 0
        for k, page in enumerate(pages):
            flags, *texts = page.decode().split("\n")
            self.flags.append(np.frombuffer(flags.encode(), np.uint8).astype(np.int8) - 48)
            self.texts.append(texts)
            sizes.append(np.array([0 if f in "23" else t.count(" ") + 1 for f, t in zip(flags, texts, strict=True)], np.int64))
            waiting.append("\n".join(t for f, t in zip(flags, texts, strict=True) if f in "01"))
            weight += len(waiting[-1])
            if weight > 1 << 19 or k + 1 == len(pages):  # words are hashed some pages at a time
                tokens.append(Scan(pa.array(waiting, pa.string())).word_hash)
                waiting, weight = [], 0
        self.of_page = np.array([s.sum() for s in sizes], np.int64)
        self.block_sizes = np.concatenate([*sizes, np.empty(0, np.int64)])
        self.block_flags = np.concatenate([*self.flags, np.empty(0, np.int8)])
        self.block_page = np.repeat(np.arange(len(pages)), [len(s) for s in sizes])
        n = int(self.of_page.sum())
        #: where each page's stream begins in the flat array, and where its tokens are
        self.starts = np.concatenate(([0], np.cumsum(self.of_page + 1)))
        page = np.repeat(np.arange(len(pages)), self.of_page)
        spot = np.arange(n) + page
        self.flat = np.empty(n + len(pages), np.uint64)
        self.flat[spot] = mix(np.concatenate([*tokens, np.empty(0, np.uint64)]) ^ hosts.view(np.uint64)[page])  # no run is of two hosts
        self.flat[self.starts[1:] - 1] = mix(np.arange(len(pages)).astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        self.border = np.ones(len(self.flat), bool)
        self.border[spot] = False
        self.page = np.repeat(np.arange(len(pages)), self.of_page + 1)
        outside = np.zeros(len(self.flat), bool)
        outside[spot] = np.repeat(self.block_flags & 1 == 0, self.block_sizes)
        # runs that lie within a page, and those that touch what is outside an article
        self.at = np.flatnonzero(self._within(self.border) == 0)
        self.outer = self._within(outside)[self.at] > 0

    def _within(self, marks: np.ndarray) -> np.ndarray:
        """For each place, how many of the `run` places from it on are marked."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.run :] - total[: -self.run] if len(marks) >= self.run else np.ones(0, np.int64)

    def run_hashes(self) -> np.ndarray:
        """A hash of the run that begins at each place of `at`."""
        h = np.full(len(self.at), self.run, np.uint64)
        for k in range(self.run):
            h = mix(h ^ self.flat[self.at + k])
        return h.view(np.int64)

    def groups(self, streams: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the suffix array: for each place of `at` its group (equal runs, all outside or all inside), for each group a place of `at` and the number of distinct counted pages."""
        if not len(self.at):
            none = np.empty(0, np.int64)
            return none, none, none
        order, ranks = suffix_array(self.flat, self.run)
        # equal first `run` tokens: neighbours in the array with equal ranks by two overlapping stretches
        level = max(k for k in range(len(ranks)) if 1 << k <= self.run)
        head, lap = ranks[level], self.run - (1 << level)
        a, b = order[:-1], order[1:]
        far = len(self.flat) - 1
        same = (head[a] == head[b]) & (head[np.minimum(a + lap, far)] == head[np.minimum(b + lap, far)])
        number = np.empty(len(self.flat), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same)))
        _, first, group = np.unique(2 * number[self.at] + self.outer, return_index=True, return_inverse=True)
        stream = np.unique(streams, return_inverse=True)[1]
        page = self.page[self.at]
        mine = counted[page]
        pairs = np.unique(group[mine] * (len(streams) + 1) + stream[page[mine]])
        return group, first, np.bincount(pairs // (len(streams) + 1), minlength=len(first))

    def judged(self, repeated: np.ndarray, told: np.ndarray) -> tuple[list[str], list[int], list[int]]:
        """Texts, and the numbers of blocks that runs remove and that markup does, given which runs of `at` are boilerplate and which pages' hosts can tell."""
        edge = np.zeros((2, len(self.flat) + 1), np.int64)
        for kind in (0, 1):
            begin = self.at[repeated & (self.outer == kind)]
            np.add.at(edge[kind], begin, 1)
            np.add.at(edge[kind], begin + self.run, -1)
        covered = np.cumsum(edge[:, :-1], axis=1)[:, ~self.border] > 0
        inside, dropped = self.block_flags & 1 > 0, self.block_flags & 2 > 0
        total = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(covered, axis=1)), axis=1)
        ends = np.cumsum(self.block_sizes)
        met = total[:, ends] - total[:, ends - self.block_sizes]
        most = ~dropped & (np.where(inside, met[0], met[1]) * 2 > self.block_sizes)
        # the text that is a page's own, by its mark or without one, and how much of it goes
        n = len(self.of_page)
        marked = np.bincount(self.block_page[inside & ~dropped], minlength=n) > 0
        own = ~dropped & (inside | ~marked[self.block_page])
        whole = np.bincount(self.block_page[own], self.block_sizes[own], n)
        lost = np.bincount(self.block_page[own & most], self.block_sizes[own & most], n)
        copy = (lost >= COPY * whole) & (whole > 0)
        kept = ~dropped & (own & (~most | copy[self.block_page]) | ~own & ~most & told[self.block_page])
        texts, by_runs, by_markup, at = [], [], [], 0
        for t in self.texts:
            k, m = kept[at : at + len(t)], most[at : at + len(t)]
            texts.append("\n".join([x for x, stays in zip(t, k.tolist(), strict=True) if stays]))
            by_runs.append(int((~k & m).sum()))
            by_markup.append(int((~k & ~m).sum()))
            at += len(t)
        return texts, by_runs, by_markup


def boilerplate(pages: Pages, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of pages that hold their hosts whole are boilerplate, and on which pages' hosts anything can be."""
    host = np.unique(pages.hosts, return_inverse=True)[1]
    different = np.unique(np.stack([host, np.unique(streams, return_inverse=True)[1]]), axis=1)
    total = np.bincount(different[0], minlength=len(pages.hosts) + 1)[host]  # of each page's host
    group, first, met = pages.groups(streams, np.ones(len(streams), bool))
    bound = np.where(pages.outer[first], 0, total[pages.page[pages.at[first]]])
    return ((met >= PAGES) & (2 * met > bound))[group], total >= PAGES


def main_text(pages: list[str | None], markup: bool = True) -> tuple[list[str], list[int], list[int]]:
    """Texts of all pages of one host, with the numbers of blocks that runs remove, and that markup does."""
    opened = [opened_page(packed_blocks(p, markup)) for p in pages]
    held = Pages(np.zeros(len(opened), np.int64), opened)
    return held.judged(*boilerplate(held, np.array([hash(b) for b in opened], np.int64)))


def opened_page(blob: bytes) -> bytes:
    import zstandard as zs

    return zs.ZstdDecompressor().decompress(blob) if blob else b""


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(named(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _shards(pages: DataFrame, stay: list[str], url: str, page: str, markup: bool) -> DataFrame:
    """Parsed pages, as many as one suffix array takes to a row: (shard, host if it is one of many of that host, rows of (row, host, stream), their sizes, the pages one after another, compressed)."""
    laid = pages.select(F.struct(*(named(c) for c in stay)).alias("row"), F.xxhash64(_host(url)).alias("host"), named(page).alias("page"))
    sizes = laid.groupBy("host").agg(F.sum(F.coalesce(F.length("page"), F.lit(0))).alias("size")).filter(F.col("size") > CHARS)
    many = written(sizes.select("host", F.ceil(F.col("size") / CHARS).alias("parts")), "html-hosts")
    # any other dealing would give the same texts
    dealt = laid.withColumn("nth", F.monotonically_increasing_id()).join(many, "host", "left")
    dealt = dealt.select("row", "host", F.coalesce(F.pmod(F.xxhash64("nth"), F.col("parts")), F.lit(-1)).alias("part"), "page")
    row = dealt.schema["row"].dataType
    one = T.StructType([T.StructField("row", row), T.StructField("host", T.LongType()), T.StructField("part", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("stream", T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            blobs = [packed_blocks(p.as_py(), markup) for p in b.column("page")]
            streams = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in blobs]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("host"), b.column("part"), pa.array(blobs, pa.binary()), pa.array(streams, pa.int64())], names=["row", "host", "part", "blob", "stream"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def shard() -> pa.RecordBatch:
            import zstandard as zs

            nonlocal made, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            rows = pa.StructArray.from_arrays([t.column(c).chunk(0) for c in ("row", "host", "stream")], names=["row", "host", "stream"])
            opened = [opened_page(x.as_py()) for x in t.column("blob")]
            data = zs.ZstdCompressor(level=3).compress(b"".join(opened))
            out = pa.RecordBatch.from_arrays([pa.array([task + made]), pa.array([last[0] if last[1] >= 0 else None], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([[len(x) for x in opened]], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["shard", "split", "rows", "sizes", "data"])
            made, held, size = made + 1, [], 0
            return out

        for b in batches:
            keys = list(zip(b.column("host").to_pylist(), b.column("part").to_pylist(), strict=True))
            sizes = [len(x) for x in b.column("blob").to_pylist()]
            start = 0
            for i, key in enumerate(keys):
                # a host that is not split stays in one shard; blobs are about a fifth of the page
                if last is not None and (held or i > start) and (key != last and (size > CHARS // 5 or key[1] >= 0 or last[1] >= 0) or key[1] >= 0 and size > CHARS // 5):
                    held.append(b.slice(start, i - start))
                    yield shard()
                    start = i
                last = key
                size += sizes[i]
            held.append(b.slice(start))
        if last is not None and any(x.num_rows for x in held):
            yield shard()

    parsed = dealt.mapInArrow(slim(parse), one).repartition("host", "part").sortWithinPartitions("host", "part")
    inner = T.StructType([f for f in one.fields if f.name in ("row", "host", "stream")])
    kinds = (("shard", T.LongType()), ("split", T.LongType()), ("rows", T.ArrayType(inner)), ("sizes", T.ArrayType(T.LongType())), ("data", T.BinaryType()))
    return written(parsed.mapInArrow(slim(gather), T.StructType([T.StructField(*k) for k in kinds])), "html-shards")


def _opened(b: pa.RecordBatch, i: int) -> tuple[pa.StructArray, Pages, np.ndarray]:
    rows = b.column("rows")[i].values
    _, host, stream = rows.flatten()
    data = opened_page(b.column("data")[i].as_py())
    cuts = np.concatenate(([0], np.cumsum(b.column("sizes")[i].values.to_numpy()))).tolist()
    return rows, Pages(host.to_numpy(zero_copy_only=False), [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]), stream.to_numpy(zero_copy_only=False)


def _split_runs(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For hosts of many shards: (shard, outer, inner), the boilerplate runs that each shard holds outside and inside of articles, and (split, pages), the hosts' pages."""
    split = shards.filter("split is not null")
    pairs = split.select("split", "shard", F.explode(F.array_distinct(F.transform("rows", lambda r: r["stream"]))).alias("stream"))
    owners = written(pairs.groupBy("split", "stream").agg(F.min("shard").alias("owner"), F.count(F.lit(1)).alias("n")), "html-streams")
    totals = written(owners.groupBy("split").agg(F.count(F.lit(1)).alias("pages")), "html-totals")
    # a page of several rows is counted in one of its shards
    again = pairs.join(owners.filter("n > 1"), ["split", "stream"]).filter("shard <> owner").groupBy("shard").agg(F.collect_list("stream").alias("again"))
    held = split.join(written(again, "html-again"), "shard", "left")

    def report(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, pages, streams = _opened(b, i)
                counted = ~np.isin(streams, np.array(b.column("again")[i].as_py() or [], np.int64))
                own = len(np.unique(streams[counted]))
                _, first, met = pages.groups(streams, counted)
                h, outer = pages.run_hashes()[first], pages.outer[first]
                keep = ~outer & np.isin(h, np.array(b.column("runs")[i].as_py(), np.int64)) if wanted else outer | (4 * met > own)
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, b.column("split")[i].as_py())), pa.array(h[keep]), pa.array(np.full(k, b.column("shard")[i].as_py())), pa.array(outer[keep]), pa.array(met[keep].astype(np.int64)), pa.array(np.full(k, own, np.int64))], names=["split", "run", "shard", "outside", "met", "own"])

    kind = "split bigint, run bigint, shard bigint, outside boolean, met bigint, own bigint"
    counts = written(held.select("split", "shard", "rows", "sizes", "data", "again").mapInArrow(slim(lambda x: report(x, False)), kind), "html-runs")
    outer = counts.filter("outside").groupBy("split", "run").agg(F.sum("met").alias("met")).filter(F.col("met") >= PAGES).select("split", "run")
    # on most pages: where no report came from at most a quarter of the pages have it
    able = counts.filter("not outside").groupBy("split", "run").agg(F.sum("met").alias("met"), F.sum("own").alias("own")).join(totals, "split").filter(F.expr("4 * met > pages + own"))
    candidates = able.groupBy("split").agg(F.collect_list("run").alias("runs"))
    inside = written(held.join(written(candidates, "html-candidates"), "split").select("split", "shard", "rows", "sizes", "data", "again", "runs").mapInArrow(slim(lambda x: report(x, True)), kind), "html-inside")
    inner = inside.groupBy("split", "run").agg(F.sum("met").alias("met")).join(totals, "split").filter((F.col("met") >= PAGES) & (2 * F.col("met") > F.col("pages"))).select("split", "run")
    found = counts.filter("outside").join(outer, ["split", "run"]).select("shard", F.lit(True).alias("outside"), "run").unionByName(inside.join(inner, ["split", "run"]).select("shard", F.lit(False).alias("outside"), "run"))
    told = found.groupBy("shard").agg(*(F.collect_list(F.when(F.col("outside") == x, F.col("run"))).alias(name) for name, x in (("outer", True), ("inner", False))))
    return written(told, "html-found"), totals


def html_text(pages: DataFrame, url: str = "url", page: str = "html", markup: bool = True) -> DataFrame:
    """pages without `page`, with text, n_chars, and the numbers of blocks that runs remove and that markup does.

    Without `markup` neither marks of articles nor of what is to be dropped count, and runs alone decide.

    Pages are shuffled once, parsed and compressed. Of hosts with many shards
    run hashes and counts are shuffled, pre-aggregated; no group is larger than
    a shard's runs.
    """
    made = ("text", "n_chars", "removed_repeated", "removed_markup")
    stay = [c for c in pages.columns if c not in (*made, page)]
    shards = _shards(pages, stay, url, page, markup)
    told, totals = _split_runs(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, held, streams = _opened(b, i)
                if b.column("split")[i].is_valid:
                    h = held.run_hashes()
                    outer, inner = (np.array(b.column(c)[i].as_py() or [], np.int64) for c in ("outer", "inner"))
                    repeated = np.where(held.outer, np.isin(h, outer), np.isin(h, inner))
                    texts, runs, markup = held.judged(repeated, np.full(len(streams), b.column("pages")[i].as_py() >= PAGES))
                else:
                    texts, runs, markup = held.judged(*boilerplate(held, streams))
                yield pa.RecordBatch.from_arrays([*rows.flatten()[0].flatten(), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], runs, markup))], names=[*stay, *made])

    schema = T.StructType([*(pages.schema[c] for c in stay), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in made[1:])])
    return shards.join(told, "shard", "left").join(totals, "split", "left").select("split", "rows", "sizes", "data", "outer", "inner", "pages").mapInArrow(slim(run), schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "removed_repeated", "removed_markup")
