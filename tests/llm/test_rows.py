"""Operators that judge or encode rows one by one."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidesmith.llm import bpe, compression, language_id, pii, quality_rules

SF = "/root/testdata/sf0.001"


# ---- 1: quality rules


def reference_features(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]


def test_features_equal_brute_force():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b ", "é", " ", "\n", "#", "ab ", "a b a\n", "\x0b", "!", "A", " "]) for _ in range(rnd.randrange(60))) for _ in range(400)] + [None, "", "\n\n"]
    known, _, _ = quality_rules.cascade(pa.array(texts), quality_rules.RULES, quality_rules.BASE_FEATURES)
    got = np.stack([known[f] for f in quality_rules.BASE_FEATURES], axis=1).tolist()
    assert got == [reference_features(t) for t in texts]


def test_order_changes_work_and_no_verdict():
    rnd = random.Random(2)
    texts = pa.array([" ".join(rnd.choice(["good", "words", "here", "###", "A" * 9, "x!"]) for _ in range(rnd.randrange(20, 200))) for _ in range(100)])
    _, kept, met = quality_rules.cascade(texts, quality_rules.RULES)
    _, kept2, met2 = quality_rules.cascade(texts, quality_rules.RULES[::-1])
    assert kept.tolist() == kept2.tolist() and met.sum() != met2.sum()


def test_cascade_orders_by_rejection_per_cost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ordered = quality_rules.order_rules(docs, sample_rows=200)
    rates = [out / max(s, 1e-9) for _, out, s in ordered]
    assert rates == sorted(rates, reverse=True) and {r.name for r, _, _ in ordered} == {r.name for r in quality_rules.RULES}


def test_quality_rules_take_odd_rows(clashing):
    out = quality_rules.quality_rules(clashing, report=("n_words",)).collect()
    assert len(out) == 12 and all(not r["kept"] for r in out if r["doc_id"] in (1, 2, 3, 4)) and all(r["kept"] for r in out if r["doc_id"] == 5)
    assert quality_rules.quality_rules(clashing.limit(0)).count() == 0


# ---- 2: byte-pair encoding


def test_codec_equals_the_library():
    from tokenizers import Tokenizer

    own, library = bpe.BpeCodec(remembered=(50, 50)), Tokenizer.from_file(bpe.default_tokenizer())
    fast = bpe.BpeCodec(library_merges=True)
    rnd = random.Random(3)
    pool = [chr(i) for i in range(0x20, 0x250)] + [chr(rnd.randrange(0x250, 0x3000)) for _ in range(200)] + [" ", "\n", "'s", "<|endoftext|>", "the", "ing", "\x1c", "́"] * 12
    texts = ["", "<|startoftext|>Hi<|endoftext|>", "a" * 3000, "İ ΣΑΣ ﬁ ½ 👍🏽", "don't WE'LL 'S"] + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(50))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(own.encode_bytes(t), "<u4")
        assert ids.tolist() == want == np.frombuffer(fast.encode_bytes(t), "<u4").tolist(), t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    for rows in (texts, [*texts[5:], None], [None, ""], [], ["plain words only, here."] * 3):
        ids, begin = fast.encode_batch(pa.array(rows, pa.string()))
        assert len(begin) == len(rows) + 1 and [ids[a:z].tobytes() for a, z in zip(begin[:-1], begin[1:])] == [own.encode_bytes(t) for t in rows]


def test_ids_of_all_documents_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    out = {r["doc_id"]: r for r in bpe.op2_bpe(spark, SF).collect()}
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert out[doc]["n_tokens"] == len(ids) and out[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[doc]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digests_merge_a_batch_s_distinct_words_once(monkeypatch):
    from tokenizers import Tokenizer

    own, library, merged = bpe.BpeCodec(remembered=(10, 10)), Tokenizer.from_file(bpe.default_tokenizer()), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda piece: merged.append(piece) or merge(piece))
    monkeypatch.setitem(bpe._CODECS, (None, False), own)
    monkeypatch.setattr(bpe, "by_arrow", lambda df, run, results: run)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "éoux" for c in "klmnopqr"]
    texts = [*[" ".join(words)] * 20, None, "", " \n", "a b<|endoftext|>c", "Don\u2019t\xa0stop.", "x" * 3000, "end. "]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    empty = type("Table", (), {"schema": {"doc_id": None}, "select": lambda self, *columns: self})()
    monkeypatch.setattr(bpe, "named", lambda name: name)
    (out,) = bpe.bpe_digests(empty, "doc_id")([b])
    assert len(merged) < 2 * len(words)
    for t, n, ids, decoded in zip(texts, *(out.column(c).to_pylist() for c in ("n_tokens", "ids_sha256", "decoded_sha256"))):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest(), t


def test_long_words_are_not_remembered():
    own = bpe.BpeCodec()
    for k in range(50):
        own.encode_bytes(("x1" * 5000 + str(k) + " ") * 2 + "é" * 9000)
    assert sum(map(len, own.words)) + sum(len(v) for v in own.words.values()) < 100_000 and sum(map(len, own.pieces)) < 100_000


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two", 5)], "doc_id bigint, text string, `a.b` int").withColumn("we`ird", F.lit(6))
    names, prototypes = language_id.fit_profiles(df.withColumn("lang", F.lit("en")))
    for out in (bpe.bpe_decode(bpe.bpe_encode(df)), quality_rules.quality_rules(df), language_id.language_id(df, names, prototypes)):
        row = out.first()
        assert (row["a.b"], row["we`ird"], row["text"]) == (5, 6, "one two")
    assert bpe.bpe_digests(df.withColumnRenamed("doc_id", "d.x"), "d.x").first()["d.x"] == 1


def test_encode_and_decode_columns(clashing):
    out = bpe.bpe_decode(bpe.bpe_encode(clashing)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 12 and by[1]["ids"] == [] and by[1]["decoded"] == "" and by[4]["decoded"] == "one</w>"
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(clashing, "doc_id").collect()}
    assert digests[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and digests[5]["n_tokens"] == len(by[5]["ids"])
    assert bpe.bpe_digests(clashing.limit(0), "doc_id").count() == 0


# ---- 3: compression classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = compression.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in out])
    bad, good = [r["score"] for r in out if r["quality"] == 0], [r["score"] for r in out if r["quality"] == 1]
    assert right > 0.93 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_classifier_takes_odd_rows(spark, clashing):
    model = compression.fit(spark.createDataFrame([(f"good text number {i} about many things", 1) for i in range(60)] + [(f"### $$$ {i} %%% &&&", 0) for i in range(60)], "text string, quality int"))
    out = compression.compression_score(clashing, model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (1, 2)} == {0.0}
    one = compression.fit(spark.createDataFrame([("a", 1)], "text string, quality int"))
    assert {r["score"] for r in compression.compression_score(clashing, one).collect()} == {0.0, 1.0}
    none = compression.fit(spark.createDataFrame([], "text string, quality int"))
    assert {r["score"] for r in compression.compression_score(clashing, none).collect()} == {0.0, 0.5}
    assert compression.compression_score(clashing.limit(0), model).count() == 0


def test_one_long_labelled_text_leaves_the_dictionaries_whole(spark):
    """Wherever a text longer than a dictionary comes in the draw, the others still fill it."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    base = docs.join(labels, "doc_id").select("text", "quality")
    plain = compression.fit(base)
    for k in range(3):  # another text, another place in the draw
        long = f"### {k} $$$ " * 300_000
        model = compression.fit(base.unionByName(spark.createDataFrame([(long, 0)], "text string, quality int")))
        added = len(model.bad) - len(plain.bad)
        assert model.good == plain.good and model.spread and added in (0, 2_000_000 // 16 + 1, 2_000_000 // 16 // 4096 * 4096 + 1, 30 * (125_000 // 30) + 1)
        assert model.slope > plain.slope / 2
    small = compression.fit(base, dictionary=20_000)
    assert 15_000 < len(small.good) <= 20_000 + base.count() and small.slope > 0


def test_strips_are_spread_over_a_text():
    data = bytes(range(256)) * 400
    assert compression.strips(data, len(data)) == data
    cut = compression.strips(data, 20_000)
    assert len(cut) == 20_000 and cut[:5000] == data[:5000] and cut[15_000:20_000] == data[int(3 * len(data) / 4) : int(3 * len(data) / 4) + 5000]
    assert len(compression.strips(b"x" * 100, 7)) == 7


def test_measure_equals_brute_force():
    import zstandard as zs

    model = compression.Model(b"good words here " * 40, b"### $$$ bad " * 40, 0.5)
    params = zs.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda d, x: len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x))
    texts = ["good words here and there", "### $$$ bad ### $$$ bad", "é" * 1500, "x", "", None]
    got, empty = compression.measure(texts, model.compressors())
    for t, g, e in zip(texts, got, empty):
        data = (t or "").encode()
        blocks = [data[i : i + 512] for i in range(0, len(data), 512)]
        assert e == (not data) and g == (sum(size(model.bad, b) - size(model.good, b) for b in blocks) / len(data) if data else 0)
    assert got[0] > 0 > got[1]


@pytest.mark.parametrize("rows", [4000, 100])
def test_a_sample_keeps_the_labels_shares(spark, rows):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rnd.randrange(90)) for _ in range(30)) for _ in range(1400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.select("doc_id", F.when(F.xxhash64("doc_id") % 7 == 0, 0).otherwise(1).alias("quality"))
    share = labels.filter(~compression.held_out()).agg(F.avg("quality")).first()[0]
    model = compression.learn(docs, labels, rows=rows)
    assert model.share == pytest.approx(share) and share > 0.8
    scores = [r["score"] for r in compression.compression_score(docs.filter(compression.held_out()), model).collect()]
    assert abs(np.mean(scores) - share) < 0.07


# ---- 5: language identification


def test_bundles_equal_brute_force():
    letters = language_id.Letters(64)
    texts = ["Abc déf", "", "12 !!", "a", "x\0y"]
    got = language_id.bundle(texts, letters)
    for t, v in zip(texts, got):
        s = re.sub(r"[^a-zA-Zéà-ÿ]+", " ", f" {t.lower()} ")
        want = np.zeros(64)
        for i in range(len(s) - 2):
            if s[i + 1] != " ":
                a, b, c = (letters._one(ord(x)).astype(int) for x in s[i : i + 3])
                want += np.roll(a, 2) * np.roll(b, 1) * c
        assert np.array_equal(v, want), t


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_takes_odd_rows(spark, clashing):
    names, prototypes = language_id.fit_profiles(spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "de"), ("x", None)], "text string, lang string"))
    assert names == ["de", "en"]
    out = {r["doc_id"]: r for r in language_id.language_id(clashing, names, prototypes).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and out[1]["score"] == 0 and out[5]["lang_pred"] in names
    names, prototypes = language_id.fit_profiles(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.language_id(clashing, names, prototypes).collect()} == {"und"}
    assert language_id.language_id(clashing.limit(0), names, prototypes).count() == 0


# ---- 6: personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def reference_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]
            if good:
                out.append((k, *m.span()))
    return out


def test_fixed_spans_equal_the_patterns():
    rnd = random.Random(4)
    for _ in range(20_000):
        t = "".join(rnd.choice(["a", "@", ".", "b.c", "-", "1", "23", "4539578763621486", " ", "+", "(", ")", "é", "\n", "%", "5", "0", "007"]) for _ in range(rnd.randrange(24)))
        assert pii.base_spans(t) == reference_spans(t), t


def test_long_runs_are_read_in_linear_time():
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1" * 300_000) == [] and len(pii.base_spans("1.1.1.1 " * 20_000)) == 20_000


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"note {i} phone {'+1 (555) 555-%04d' % i if i % 3 else '55512-%05d' % i} thanks") for i in range(60)] + [(100, "order 12345-67890 done"), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert all(len(out[i]["found"]) == 1 and out[i]["found"][0]["kind"] == 3 for i in range(0, 60, 3)) and not out[100]["found"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "note 0 phone <PHONE> thanks" and clean[1] == "note 1 phone <PHONE> thanks" and clean[100] == rows[60][1] and clean[101] is None


def test_counts_by_kind(spark):
    """The query's counts and digests against its base spans, and these against one text by hand."""
    from hashlib import sha256

    text = "a@b.cd 10.0.0.1 10.0.0.256, 4111 1111 1111 1111 +1 (555) 555-0100 x@y.zz"
    assert [k for k, _, _ in pii.base_spans(text)] == [0, 0, 1, 2, 3]
    for r in pii.op6_pii(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        spans = pii.base_spans(r["text"] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in range(4)]
        assert r["base_sha256"] == sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for t in ("x" * 1_000_000 + " 1", "中" * 1_000_000 + "12345", "0" * 5000 + ".1.1.1", "1 " * 300_000, "a@" * 300_000, "(1)" * 300_000):
        pii.mentions(t, pii.base_spans(t))
    assert time.perf_counter() - began < 15
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]


def test_spaced_groups_are_candidates():
    found = [x[3] for x in pii.mentions("call (743) 555-3824 or 555 123 4567 now", [])]
    assert found == ["7435553824", "5551234567"]


def test_redaction_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd")], "doc_id bigint, text string").selectExpr("*", "1 AS added", "2 AS k3", "3 AS `a``b`", "4 AS row", "5 AS found", "6 AS k1")
    assert pii.redact(docs).collect()[0]["text"] == "mail <EMAIL>" and pii.redact(docs).columns == docs.columns


def test_pii_takes_odd_rows(clashing):
    assert pii.find_pii(clashing).count() == 12 and pii.find_pii(clashing.limit(0)).count() == 0
    assert pii.redact(clashing).columns == clashing.columns and pii.redact(clashing).count() == 12
