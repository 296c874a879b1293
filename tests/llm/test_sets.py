"""Operators that look at many rows together."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import tidesmith.llm.ngram_join as nj
import tidesmith.llm.topk as topk
from tidesmith.llm import components, html_text, packing, warc
from tidesmith.llm.wordscan import Scan

SF = "/root/testdata/sf0.001"


# ---- 7: similarity join


def brute_components(rows, width=4, percent=85):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t in rows if d is not None}
    sets = {d: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for d, w in words.items()}
    parent = {d: d for d in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        if rows and rnd.random() < 0.7:
            w = rnd.choice(rows).split()
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                i = rnd.randrange(len(w) + 1)
                w[i : i + rnd.choice((0, 1))] = [f"new{rnd.randrange(50)}"] * rnd.choice((0, 1))
            rows.append(" ".join(w) or "x")
        else:
            rows.append(" ".join(f"W{rnd.randrange(300)}" for _ in range(rnd.choice((1, 3, 4, 5, 9, 30, 60, 120)))))
    return [(i * 3 + 7, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, limit, side", [(1, 128, 1024), (2, 3, 1024), (3, 3, 5), (4, 2, 2)])
def test_join_equals_brute_force(spark, monkeypatch, seed, limit, side):
    """Short lists, long lists, and long lists cut into many sides."""
    monkeypatch.setattr(nj, "LIST", limit)
    monkeypatch.setattr(nj, "SIDE", side)
    rows = near_copies(seed)
    out = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows) and len(out) == len(rows)


def test_join_takes_odd_rows(clashing, texts):
    out = nj.ngram_jaccard_join(clashing).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    want = brute_components(texts)
    assert len(out) == 12 and {d: v for d, v in by.items() if d is not None} == want and by[None][1] is None and want[1] == (0, 1) and want[6] == (77, 5)
    assert nj.ngram_jaccard_join(clashing.limit(0)).count() == 0


def test_join_of_ids_with_several_texts(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b = words("a"), words("b")
    rows = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, words("c")), (9, words("d")), (5, words("d")), (9, words("e")), (7, words("e") + " z")]
    out = nj.ngram_jaccard_join(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 5), (5, 5), (7, 5)} and len(out) == 18


def test_join_of_a_hot_token(spark, monkeypatch):
    """Thousands of texts that share their rarest shingles in groups, and one shingle all; stars in pieces."""
    monkeypatch.setattr(nj, "STAR", 3)
    rnd = random.Random(11)
    rows = []
    for g in range(300):
        base = [f"g{g}w{i}" for i in range(40)]
        for _ in range(8):
            rows.append((len(rows), " ".join(["all", "texts", "begin", "so", *base, f"n{rnd.randrange(10**9)}"])))
    out = {r["doc_id"]: r["component_id"] for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: i // 8 * 8 for i in range(len(rows))}


def test_all_frequent_shingles_come_last(spark):
    """More than 50,000 of them, so that lists do not get longer and longer as tables grow."""
    common = [f"c{i}" for i in range(60_000)]
    ids = [r["id"] for r in spark.range(1000).filter("pmod(xxhash64(id, 17), 32) = 0").limit(3).collect()]
    own = lambda d: " ".join(f"own{d}x{i}" for i in range(40))
    docs = spark.createDataFrame([(d, " ".join(common) + "\n" + own(d)) for d in ids], "doc_id bigint, text string")
    first = {r["doc_id"]: r["first"] for r in nj.signatures(docs, "doc_id", "text", 4, 85).collect()}
    for d in ids:
        rare = set(Scan(pa.array([own(d)]), lower=True).shingle_sets(4)[0].view(np.int64).tolist())
        assert len(rare) == 37 and len(rare & set(first[d][:40])) >= 34  # a few share a place with a frequent one


def test_linked_sets_share_as_many_first_shingles_as_asked(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        n = rnd.choice((1, 2, 5, 9, 12, 40, 300))
        both, order = list(range(n)), rnd.sample(range(2 * n + 40), 2 * n + 40)
        a, b = (set(both) | set(range(n + k, n + k + rnd.randrange(n // 6 + 1))) for k in (0, n // 6 + 1))
        if 100 * n >= 85 * len(a | b):
            first = [sorted(s, key=lambda x: order[x])[: len(s) - need + min(nj.SHARED, need)] for s in (a, b) for need in [-(-85 * len(s) // 100)]]
            rows.append((len(a), len(b), len(set(first[0]) & set(first[1]))))
    asked = [(r["need"], r["shared"]) for r in spark.createDataFrame(rows, "na bigint, nb bigint, shared bigint").select(nj.least_shared(85).alias("need"), "shared").collect()]
    assert all(1 <= need <= shared for need, shared in asked) and max(need for need, _ in asked) > nj.SHARED


def test_tree_prunes_and_finds_every_component():
    rnd = random.Random(5)
    base = [np.unique(np.array([rnd.getrandbits(60) for _ in range(rnd.choice((20, 60)))], np.uint64)) for _ in range(12)]
    sets = [np.unique(np.append(b[rnd.randrange(3) :], np.uint64(rnd.getrandbits(60)))) for b in base for _ in range(9)]
    tree = nj.SignatureTree(sets, 85)
    links = tree.links()
    assert len(tree.levels) > 1 and any(not tree.may_link(0, i, j) for i in range(len(tree.levels[0])) for j in range(i))
    find = {i: i for i in range(len(sets))}
    for a, b in links:
        find[b] = a
    want = {i: i for i in range(len(sets))}
    for i, j in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[i], sets[j]))
        if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
            a, b = want[i], want[j]
            want = {x: min(a, b) if c in (a, b) else c for x, c in want.items()}
    group = lambda f: sorted(Counter(f.values()).values())
    assert group(find) == group(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "u bigint, v bigint")
    out = {r["u"]: r["root"] for r in components.components(edges).collect()}
    assert out == {i: 1 for i in range(2, 61)} | {101: 100}
    assert components.components(edges.limit(0)).count() == 0


# ---- 8: packing


def check_packing(out, size):
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= size


def test_packing_of_the_table(spark):
    from tokenizers import Tokenizer

    from tidesmith.llm.bpe import default_tokenizer

    out = packing.op8_packing(spark, SF).toPandas()
    check_packing(out, 4096)
    assert out["sequence_id"].nunique() <= 1.02 * -(-out["length"].sum() // 4096) + 1
    library = Tokenizer.from_file(default_tokenizer())
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out["doc_id"] == r["doc_id"]].sort_values("piece")
        cuts = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert mine["start"].tolist() == list(range(0, len(ids), 4096)) and mine["length"].tolist() == [len(c) for c in cuts] and mine["ids_crc32"].tolist() == [zlib.crc32(c.tobytes()) for c in cuts]


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_and_little_else(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.choice((1, 100, rnd.randrange(1, 101), rnd.randrange(1, 40))) for _ in range(rnd.choice((1, 30, 2000))))
    uses = packing.plan(dict(histogram), 100, rounds=40)
    held = Counter()
    for times, filling in uses:
        assert times > 0 and sum(n * c for n, c in filling) <= 100
        for n, c in filling:
            held[n] += times * c
    assert held == histogram
    assert sum(t for t, _ in uses) <= 1.03 * sum(n * c for n, c in histogram.items()) / 100 + 2


@pytest.mark.parametrize("kind", ["lognormal", "hundredfold", "wide", "thirds", "few"])
def test_no_plan_is_worse_than_best_fit(kind):
    r = np.random.default_rng(7)
    lengths = {"wide": r.integers(1000, 3501, 50_000), "thirds": np.clip(r.normal(1365, 60, 60_000).astype(int), 1, 4096), "few": r.integers(1, 4000, 300)}.get(kind, np.clip(r.lognormal(6, 1.2, 200_000).astype(int), 1, 4096))
    histogram = Counter((lengths).tolist())
    if kind == "hundredfold":
        histogram = Counter({n: 100 * c for n, c in histogram.items()})
    uses = packing.plan(dict(histogram), 4096)
    held = Counter()
    for times, filling in uses:
        assert sum(n * c for n, c in filling) <= 4096
        for n, c in filling:
            held[n] += times * c
    number = lambda found: sum(t for t, _ in found)
    assert held == histogram and number(uses) <= number(packing._last(packing._Stock(dict(histogram)), 4096))


def test_plan_of_nothing():
    assert packing.plan({}, 100) == []


def test_packing_takes_odd_rows(clashing):
    out = packing.pack(clashing, size=64).toPandas()
    check_packing(out, 64)
    assert len(out[out["doc_id"] == 1]) == 1 and out[out["doc_id"] == 1]["length"].tolist() == [1] and out[out["doc_id"] == 8]["length"].max() == 64
    assert packing.pack(clashing.limit(0)).count() == 0


# ---- 4: WARC


def test_magic_in_payloads_is_rejected(spark, tmp_path):
    evil = warc.record_of(99, "http://x", b"inner", None).decode()
    rows = [(1, "u", f"a {evil} b {evil}"), (2, None, None), (3, "", "abc"), (4, "z\r\nContent-Length: 9", "abc"), (5, "q", "é\r\n"), (6, "", ""), (7, "w", evil), (7, "w", evil), (8, "http://x/WARC/1.0", "x"), (None, "n", "x"), (None, "n", "alone"), (9, "big", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS last", "4 AS n")
    warc.write_warc(pages, str(tmp_path / "w"), rows_per_file=3)
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    out = {r["id"]: r for r in read if r["id"] is not None}
    assert len(read) == len(rows) and {(r["record_type"], r["refers_to"]) for r in read if r["id"] is None} == {("revisit", 8), ("response", None)}
    assert out[8]["url"] == "http://x/WARC/1.0" and len(out[9]["payload"]) == 300_000 and sorted(out) == [1, 2, 3, 4, 5, 6, 7, 8, 9] and all(r["intact"] in (True, None) for r in out.values())
    assert out[1]["payload"] == rows[0][2] and out[2]["refers_to"] == 6 and out[3]["refers_to"] == 4 and out[3]["record_type"] == "revisit" and out[3]["payload_bytes"] == 3 and out[7]["record_type"] == "response"


def brute_records(data):
    """(offset, block) of the records of an archive, one after another."""
    out, at = [], 0
    while data.startswith(warc.MAGIC, at) and (h := warc.header(data[at + len(warc.MAGIC) :])):
        start = at + len(warc.MAGIC)
        out.append((at, data[start + h[0] : start + h[1]]))
        at = start + h[1] + 4
    return out


@pytest.mark.parametrize("ranges", [200_000, 0])
def test_records_over_many_byte_ranges(spark, tmp_path, ranges):
    """Ranges of 3,000 bytes, records and magic words over their ends, chains of many ranges, a file cut short and one that loses its chain."""
    rnd = random.Random(4)
    evil = [warc.record_of(k, "http://x", b"y" * k, None).decode() for k in (5, 300)]
    rows = [(i, f"u{i}", "".join(rnd.choice(["z" * 200, *evil, warc.MAGIC.decode(), "\n\n"]) for _ in range(rnd.choice([0, 1, 3, 12])))) for i in range(16)]
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*") if f.stat().st_size}
    (tmp_path / "w" / "short.warc").write_bytes((whole := b"".join(files.values()))[: len(whole) * 2 // 3])
    (tmp_path / "w" / "lost.warc").write_bytes(whole[:3000] + b"?" + whole[3000:])
    (tmp_path / "w" / "none.warc").write_bytes(b"?" + whole)
    files |= {n: (tmp_path / "w" / n).read_bytes() for n in ("short.warc", "lost.warc", "none.warc")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        read = warc.read_warc(spark, str(tmp_path / "w"), ranges).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["payload"]) for r in read if r["record_type"] == "response")
    wanted = sorted((n, at, block.partition(b"\r\n\r\n")[2].decode("utf-8", "replace")) for n, data in files.items() for at, block in brute_records(data) if b"WARC-Type: response" in data[at : at + 40])
    assert found == wanted and len(found) > 20 and not any(n == "none.warc" for n, *_ in found)
    assert len(read) == sum(len(brute_records(data)) for data in files.values())


@pytest.mark.parametrize("size", [None, 200])
def test_payloads_that_end_in_the_magic(spark, tmp_path, size):
    """Any part of the magic at a payload's end, with the blank lines behind it, stays in the payload, whatever the ranges."""
    magic = warc.MAGIC.decode()
    rows = [(k, "u", f"hello {k} " + magic[:k]) for k in range(len(magic) + 1)] + [(20 + k, "u", f"{k}" + magic * k + "WARC/1.0") for k in range(4)] + [(30, "u", "x" * 700 + "WARC/1.0"), (31, "u", "WARC/1.0")]
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2), str(tmp_path / "w"), rows_per_file=5)
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["id"], r["payload"], r["payload_bytes"], r["intact"]) for r in read) == [(i, t, len(t), True) for i, _, t in rows]


def test_a_payload_other_than_its_header_says_is_not_intact(spark, tmp_path):
    record = warc.record_of(1, "u", b"payload", None)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(record + record.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))
    a, b = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: r["offset"])
    assert a["intact"] and not b["intact"] and b["payload"] == "payl0ad" and b["digest"] != a["digest"] and b["payload_bytes"] == 7


def test_pointer_jumping_follows_the_chain_only():
    at, successors = np.array([0, 5, 10, 12, 30]), np.array([10, 12, 30, 31, 44])
    assert warc.exits(at, successors, 40).tolist() == [44, -1, 44, -1, 44]
    assert warc.exits(np.array([3]), np.array([9]), 20).tolist() == [-1] and warc.exits(np.empty(0, int), np.empty(0, int), 9).tolist() == []


def test_magic_without_end_takes_linear_time():
    import time

    import pyarrow as pa

    began = time.perf_counter()
    values = [b""] * 100_000 + [b"Content-Length: 5\r\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(values)), pa.array([0] * len(values), pa.int64()), pa.array(values, pa.binary())], names=["file", "block", "value"])
    (told,) = warc.candidates(iter([batch]))
    assert told.column("at").to_pylist() == [-1]
    assert time.perf_counter() - began < 5


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# ---- 9: HTML


def brute_texts(rows, run=6):
    """(page, html) of one host each -> texts, by counting every run of tokens in dictionaries."""
    parsed = [(h, html_text.blocks(p) if p else []) for h, p in rows]
    streams, met_out, met_in, pages = [], {}, {}, {}
    for h, found in parsed:
        words, outside, block = [], [], []
        for k, (text, inside, dropped) in enumerate(found):
            if not dropped:
                own = text.split(" ")
                words += own
                outside += [not inside] * len(own)
                block += [k] * len(own)
        key = (h, tuple(found))
        streams.append((h, key, words, outside, block))
        pages.setdefault(h, set()).add(key)
        for i in range(len(words) - run + 1):
            met = met_out if any(outside[i : i + run]) else met_in
            met.setdefault((h, tuple(words[i : i + run])), set()).add(key)
    out = []
    for (h, key, words, outside, block), (_, found) in zip(streams, parsed):
        covered = {True: set(), False: set()}
        for i in range(len(words) - run + 1):
            o = any(outside[i : i + run])
            n = len((met_out if o else met_in)[h, tuple(words[i : i + run])])
            if n >= 3 and (o or 2 * n > len(pages[h])):
                covered[o] |= set(range(i, i + run))
        size = Counter(block)
        hit = Counter(block[i] for i in range(len(words)) if i in covered[outside[i]])
        most = {k for k in size if 2 * hit[k] > size[k]}
        live = [k for k, b in enumerate(found) if not b[2]]
        marked = any(found[k][1] for k in live)
        own = [k for k in live if found[k][1] or not marked]
        copy = own and sum(size[k] for k in own if k in most) >= 0.85 * sum(size[k] for k in own)
        out.append("\n".join(found[k][0] for k in live if (k in own and (k not in most or copy)) or (k not in own and k not in most and len(pages[h]) >= 3)))
    return out


def odd_pages(seed, n=120):
    rnd = random.Random(seed)
    shared = [" ".join(f"s{rnd.randrange(40)}" for _ in range(rnd.choice((4, 6, 9, 15)))) for _ in range(12)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.2:
            rows.append(rnd.choice(rows)[:2])
            continue
        parts = [f"<p>{rnd.choice(shared) if rnd.random() < 0.5 else ' '.join(f'w{rnd.randrange(400)}' for _ in range(rnd.randrange(1, 14)))}</p>" for _ in range(rnd.randrange(6))]
        cut = rnd.randrange(len(parts) + 1)
        page = "".join(parts) if rnd.random() < 0.5 else "".join(parts[:cut]) + "<article>" + "".join(parts[cut:]) + f"<p>{shared[0]} {shared[1]}</p></article><nav>{shared[2]}</nav>"
        rows.append((f"http://h{rnd.choice((0, 0, 0, 1, 2))}.x/{i}", page))
    return rows


@pytest.mark.parametrize("chars, parts, most", [(2_400_000, 4, 10_000), (700, 4, 10_000), (300, 3, 2)])
def test_pages_equal_brute_force_in_any_layout(spark, monkeypatch, chars, parts, most):
    """Hosts in one array, hosts over many, small batches; runs outside and inside of articles, copies."""
    monkeypatch.setattr(html_text, "CHARS", chars)
    rows = odd_pages(4)
    pages = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(rows)], "page_id bigint, url string, html string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        out = {r["page_id"]: r["text"] for r in html_text.html_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute_texts([(u.split("/")[2], p) for u, p in rows])
    assert [out[i] for i in range(len(rows))] == want
    by_markup = ["\n".join(t for t, _, d in html_text.blocks(p) if not d) for _, p in rows]
    assert sum(a != b for a, b in zip(want, by_markup)) > 20  # runs decide on many of these


def test_html_of_the_table_equals_brute_force(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    host = lambda u: re.match(r"[a-z]+://([^/:?#]+)", u or "")
    want = dict(zip([r[0] for r in rows], brute_texts([(m[1].lower() if (m := host(u)) else "", p) for _, u, p in rows])))
    assert {r["page_id"]: r["text"] for r in html_text.op9_html_text(spark, SF).collect()} == want


@pytest.mark.parametrize("page", ["<a " * 100_000 + '"', "<a " * 100_000 + "'x", "<script></script" + "</script" * 50_000, '<a b="' * 50_001, "<a '\"" * 30_000, "<!--" * 50_000, "<p " * 100_000])
def test_unclosed_tags_and_quotes_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.blocks(page)
    assert time.perf_counter() - began < 2


def test_a_quote_without_a_partner_opens_nothing():
    assert [t for t, _, _ in html_text.blocks('<p>a <b class="x>y</p><p>z</p>')] == ["a y", "z"]
    assert [t for t, _, _ in html_text.blocks("a<x y='>'>b<i")] == ["ab"]


def test_words_in_class_names_drop_no_paragraph_of_an_article():
    page = "<article><p class='share-price'>Share price rose</p><p class='related-work'>r</p><p id='notice'>n</p><section class='comments-policy'>c</section><div class='x comments'>gone</div><p><math>m</math><label>l</label></p></article><div class='cookie-notice'>gone</div>"
    assert [t for t, _, dropped in html_text.blocks(page) if not dropped] == ["Share price rose", "r", "n", "c", "ml"]


def test_odd_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 50_000 + "</p>" * 50_000, "<p><b>" * 50_000 + "</i>" * 50_000, '<a "' * 100_001, "<a '\"" * 100_000, "<" * 300_000, "<!--" * 100_000, "<script>" * 50_000, "x" * 1_000_000):
        html_text.main_text([page])
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two\n  three<p>four</article>", "A & B\none two three\nfour"),
        ("<body><nav>menu</nav><main><p>x</p><aside>side</aside><form>f</form><div class='ad'>ad</div><ul class=comments><li>c</ul></main><footer>f</footer>", "x"),
        ("<p>only &lt;text&gt; &copy; &am here", "only <text> © &am here"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<article><header><h1>t</h1></header><p>b</p><div hidden>h</div></article>", "t\nb"),
        ("<p title='a>b'>q</p><p", "q"), (None, ""), ("", ""), ("plain", "plain"), ("<div role=\"main\"><p>m</p></div><p>out</p>", "m"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text([page])[0] == [want]


def test_pages_without_an_article_lose_what_they_share():
    pages = [f"<div>the same seven words on every page</div><p>page {i} says its own thing</p>" for i in range(5)]
    texts, runs, _ = html_text.main_text(pages)
    assert texts == [f"page {i} says its own thing" for i in range(5)] and runs == [1] * 5


def test_unique_blocks_outside_an_article_stay():
    pages = [f"<article><p>text {i}</p></article><p>only here{i} stands note{i}</p><p>the same seven words on every page</p><nav>a menu</nav>" for i in range(4)]
    assert html_text.main_text(pages) == ([f"text {i}\nonly here{i} stands note{i}" for i in range(4)], [1] * 4, [1] * 4)
    assert html_text.main_text(pages[:2])[0] == ["text 0", "text 1"]


def test_copies_of_a_page_keep_their_text():
    words = [f"w{i}" for i in range(120)]
    page = lambda w: f"<p>{' '.join(w[:60])}</p><p>{' '.join(w[60:])}</p>"
    text = lambda w: f"{' '.join(w[:60])}\n{' '.join(w[60:])}"
    near = [[*words[:119], f"last{i}"] for i in range(40)]
    for copies in ([words] * 4, near):
        assert html_text.main_text([page(w) for w in copies])[0] == [text(w) for w in copies]
    others = [f"<div>the same seven words on every page</div><p>page {i} says its own thing here</p>" for i in range(3)]
    assert html_text.main_text([*(page(w) for w in near), *others])[0] == [*map(text, near), *(f"page {i} says its own thing here" for i in range(3))]


def test_html_takes_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/c", "<p>x</p>"), (3, "http://a.b/c", "<p>x</p>"), (4, "not a url", "<p>y" * 3000), (None, "http://a.b/d", "<p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS _at", "2 AS _host", "3 AS host", "4 AS `a``b`", "5 AS split", "6 AS row")
    made = html_text.html_text(pages)
    assert made.columns == ["page_id", "url", "_at", "_host", "host", "a`b", "split", "row", "text", "n_chars", "removed_repeated", "removed_markup"]
    out = made.collect()
    assert len(out) == 6 and {r["n_chars"] for r in out if r["page_id"] in (1, 2)} == {0}
    assert html_text.html_text(pages.limit(0)).count() == 0


# ---- 10: search


@pytest.mark.parametrize("shard, chunk", [(16_384, 4096), (7, 3)])
def test_search_equals_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=5), 1)]) for i in range(0, 60)] + [(200, None), (300, [1.0, None, 1.0, 1.0, 1.0]), (400, [1.0, float("nan"), 1.0, 1.0, 1.0]), (500, [1.0, 2.0]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS d", "4 AS shard")
    out = topk.max_score_search(df, df.filter("vec_id % 20 = 0"), 4).collect()
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows[:60]}
    want = [(q, k + 1, i, -s) for q in (0, 20, 40) for k, (s, i) in enumerate(sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:4])]
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in out) == want
    assert topk.max_score_search(df.limit(0), df.limit(0)).count() == 0


def test_equal_vectors_go_by_id(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(30)], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in topk.max_score_search(df, df.filter("vec_id = 3"), 5).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


def test_terms_are_skipped():
    """Fewer products than brute force on a table of 2,000 rows, the same rows."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(size=(2000, 64)) * rng.exponential(size=64)).astype(np.int64)
    shard = topk.Shard(np.arange(2000), x)
    for i in range(0, 2000, 100):
        scores, ids = shard.best(i, x[i], 10)
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:10]
        assert [(-int(s), int(j)) for s, j in zip(scores, ids)] == want
    assert shard.products < 0.9 * 20 * x.size


def test_large_components_are_exact():
    x = np.array([[1 << 50, 3], [1 << 50, 5], [-(1 << 62), 1 << 62]], np.int64)
    scores, ids = topk.Shard(np.arange(3), x).best(9, np.array([1 << 5, 1], np.int64), 3)
    assert ids.tolist() == [1, 0, 2] and scores.tolist() == [(1 << 55) + 5, (1 << 55) + 3, -(1 << 63)]


def test_the_program_places_most_tokens(monkeypatch):
    rnd = random.Random(3)
    histogram = Counter(min(4096, int(rnd.lognormvariate(6.3, 1.0)) + 1) for _ in range(20_000))
    told: dict[str, int] = {}
    uses = packing.plan(dict(histogram), 4096, told=told)
    whole = sum(n * c for n, c in histogram.items()) - 4096 * histogram[4096]
    assert told["columns"] > 0.6 * whole and sum(t for t, _ in uses) <= 1.005 * sum(n * c for n, c in histogram.items()) / 4096 + 1
    # lengths that best fit decreasing alone packs badly
    hard = {51: 60, 27: 60, 26: 60, 23: 120}
    assert sum(t for t, _ in packing.plan(dict(hard), 100)) == 90
    monkeypatch.setattr(packing, "_solved", lambda *a: [])
    packing.plan(dict(histogram), 4096, told=told)
    assert told["columns"] == 0
