"""The registered queries on the smallest tables, and the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.test_oracles import TABLES, same_rows
from tidesmith.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op3": "doc_id held_out score predicted",
    "op4": "page_id payload_bytes payload_digest record_type refers_to", "op5": "doc_id held_out lang_pred score", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id n_shingles component_id", "op8": "doc_id piece start length ids_crc32 sequence_id offset", "op9": "page_id url text n_chars", "op10": "query_id rank vec_id score",
    "op11": "lang rank phrase a l r n score", "op12": "page_id host path rule verdict", "op13": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"pipeline"}))
def test_query(spark, name):
    out = registry.queries()[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    if name in registry.oracle_sql():
        c = duckdb.connect()
        for t in TABLES:
            p = f"{SF}/{t}.parquet"
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        same_rows(out, c.execute(registry.oracle_sql()[name]))
    else:
        key, table = ("page_id", "pages") if name.startswith("op9") else ("doc_id", "documents")
        assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < n
    assert docs.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "other words here now"), (5, None), (None, base)], "doc_id bigint, text string")
    out = corpus_pipeline.near_copies(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "4", "5", "None"]


def test_pipeline_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark):
    """Extra columns that bear the names of results, or odd ones; repeated ids, a text of 1 MB, nulls."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.filter("doc_id = 1").withColumn("text", F.expr("repeat(text || ' ', cast(1000000 / length(text) AS int))")).withColumn("doc_id", F.lit(10**6).cast("bigint"))
    docs = docs.unionByName(docs.filter("doc_id < 20")).unionByName(long).unionByName(docs.filter("doc_id < 3").withColumn("text", F.lit(None).cast("string")))
    extra = {"score": 777, "predicted": 778, "lang_pred": 779, "component_id": 780, "n_shingles": 781, "a.b": 782, "we`ird": 783, "others": 784}
    for c, v in extra.items():
        docs = docs.withColumn(c, F.lit(v))
    docs = docs.withColumn("m", F.array(F.struct(F.lit(1).alias("k"))))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r[c] == v for r in rows for c, v in extra.items()) and all(r["m"][0]["k"] == 1 for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len({r["doc_id"] for r in rows})


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
