"""The corpus pipeline: documents of good quality in a known language, one of each group of near copies, without personal data, packed.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents; the last one returns the
packed pieces. run() writes each stage's rows and reads them back for the next.

A null or empty text is of no quality and goes in the first stage. Rows that
repeat an id, or a text, are judged alike; near copies keeps of equal ids all
or none. Ties and very long texts are the operators' own. Extra columns, of any
name, stay as they are. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm import compression, language_id, ngram_join, packing, pii
from tidesmith.llm.common import named, table, written
from tidesmith.ship import shipped

#: A text whose best cosine is below this resembles no language that was learnt.
LEAST_COSINE = 0.1


def _apart(docs: DataFrame) -> DataFrame:
    """docs as `text` and one column with all the others, so that no result takes the name of one."""
    return docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("others"), "text")


def _together(judged: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of docs again."""
    return judged.select(*(replaced.get(c, named(c) if c == "text" else F.col("others").getField(c)).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier takes for label 0."""
    model = compression.learn(docs, table(spark, sf_dir, "labels"))
    return _together(compression.compression_score(_apart(docs), model).filter("predicted = 1"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or like no learnt language; a null lang becomes the predicted one."""
    names, prototypes = language_id.fit_profiles(docs.filter(~language_id.held_out()))
    known = language_id.language_id(_apart(docs), names, prototypes).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE))
    return _together(known, docs, lang=F.coalesce(F.col("others").getField("lang"), "lang_pred"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones, that with the smallest id; rows without an id stay."""
    joined = ngram_join.ngram_jaccard_join(docs)
    # written, so that Spark knows the size of what it joins and leaves the texts in place if that is small
    away = written(joined.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(away, "doc_id", "left_anti").select(*map(named, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", shipped(quality_classifier)),
    ("language ID", shipped(language)),
    ("n-gram Jaccard join", shipped(near_copies)),
    ("PII", shipped(personal_data)),
    ("best-fit packing", shipped(packed)),
]

#: No SQL engine can express the classifier, the profiles or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.lower().replace(" ", "-"))
    return docs
