"""Index files, result tables and catalogs."""

from __future__ import annotations

import importlib.util
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.enhance import METHODS
from ..operators.evaluation import pending

# The metrics with their direction, unit, range, and whether they need a reference.
METRICS = [
    ("si_sdr", "SI-SDR", "higher", "dB", None, None, True), ("sdr", "SDR", "higher", "dB", None, None, True), ("seg_snr", "SegSNR", "higher", "dB", -10.0, 35.0, True),
    ("stoi", "STOI", "higher", "", 0.0, 1.0, True), ("estoi", "ESTOI", "higher", "", 0.0, 1.0, True), ("pesq", "PESQ", "higher", "MOS", -0.5, 4.5, True),
    ("dnsmos_sig", "DNSMOS SIG", "higher", "MOS", 1.0, 5.0, False), ("dnsmos_bak", "DNSMOS BAK", "higher", "MOS", 1.0, 5.0, False), ("dnsmos_ovrl", "DNSMOS OVRL", "higher", "MOS", 1.0, 5.0, False),
    ("cer", "CER", "lower", "", 0.0, None, True), ("wer", "WER", "lower", "", 0.0, None, True),
]
ABSENT = {"pesq": "its package is not installed", "dnsmos_sig": "there is no scorer", "dnsmos_bak": "there is no scorer", "dnsmos_ovrl": "there is no scorer"}


def read_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(envelope, records) of an index: one JSON document, or a folder that write_index made. The envelope's capability flags decide which operators a plan has."""
    try:
        head = spark.read.option("multiLine", "true").json(f"{path}/head").first().asDict(recursive=True)
        records = spark.read.json(f"{path}/records")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        whole = spark.read.option("multiLine", "true").json(path)
        head = whole.drop("records").first().asDict(recursive=True)
        records = whole.select(F.explode("records").alias("r")).select("r.*")
    missing = [s for s in head.get("strata") or [] if s not in records.columns]
    if missing:
        raise ValueError(f"the index declares strata that its records lack: {missing}")
    return head, records


def write_index(records: DataFrame, head: dict, path: str) -> None:
    """A folder with the envelope in head and a line for each record in records, parts and lines in id order: every task writes its own range, so an index may have any size."""
    spark = records.sparkSession
    lines = records.orderBy("id").select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "true"}).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/records")
    spark.createDataFrame([(json.dumps(head, ensure_ascii=False),)], "value string").write.mode("overwrite").text(f"{path}/head")


def write_results(rows: DataFrame, path: str) -> None:
    """Rows by method; only the methods present are replaced, so a run that broke off goes on where it stopped."""
    rows.write.partitionBy("method").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def still_to_do(spark: SparkSession, planned: DataFrame, path: str) -> DataFrame:
    """The planned (method, ..) that the results lack."""
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no results yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return planned
    return pending(planned, done.select(F.col("method").cast("string").alias("method")), ["method"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Every result file of a folder; what is no JSON is a row with its text in `_corrupt_record`."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema("testset string, dataset_id string, purpose string, objective string, cer string, summary string, _corrupt_record string").json(path).withColumn("file", F.col("_metadata.file_name"))


def metric_catalog(spark: SparkSession) -> DataFrame:
    rows = [(*m, m[0] not in ABSENT, ABSENT.get(m[0])) for m in METRICS]
    return spark.createDataFrame(rows, "key string, label string, direction string, unit string, low double, high double, needs_reference boolean, available boolean, reason string")


def method_catalog(spark: SparkSession, model_dir: str | None = None) -> DataFrame:
    """(method, kind, path): built-in methods and the exported models of a folder, top level only."""
    own = spark.createDataFrame([(m, "dsp", None) for m in METHODS], "method string, kind string, path string")
    if model_dir is None:
        return own
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").load(model_dir)
    return own.unionByName(files.select(F.regexp_extract("path", r"([^/]+)\.onnx$", 1).alias("method"), F.lit("onnx").alias("kind"), "path"))


def clips(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a folder by extension (wav, flac, mp3), then name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,flac,mp3}").load(path)
    name, kind = F.regexp_extract("path", r"([^/]+)$", 1), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select(name.alias("name"), kind.alias("kind"), "length").orderBy(F.array_position(F.array(F.lit("wav"), F.lit("flac"), F.lit("mp3")), F.col("kind")), "name")


def self_check(spark: SparkSession) -> DataFrame:
    """(check, ok, detail): each check by itself; an exception is a failed check."""
    import numpy as np

    from ..kernels import enhance, spectral
    from .audio import decode_wav, encode_wav

    x = np.random.default_rng(1).uniform(-0.5, 0.5, 5000)

    def round_trip() -> float:
        return float(np.abs(spectral.istft(spectral.stft(x), len(x)) - x).max())

    def streaming() -> float:
        return float(np.abs(enhance.Pipeline("none").signal(x)[0] - x).max())

    checks = {
        "spectrum round trip": lambda: (round_trip() < 1e-10, f"{round_trip():.1e}"),
        "streaming equals batch": lambda: (streaming() < 1e-9, f"{streaming():.1e}"),
        "wave file round trip": lambda: (float(np.abs(decode_wav(encode_wav(x)[0]) - x).max()) < 1e-4, ""),
        "resampling": lambda: (len(spectral.resample(x, 8000, 16000)) == 10_000, ""),
        "methods": lambda: (all(enhance.build(m) for m in METHODS), ", ".join(METHODS)),
        "onnxruntime": lambda: (importlib.util.find_spec("onnxruntime") is not None, "models are optional"),
        "spark": lambda: (spark.range(10).count() == 10, spark.version),
    }
    rows = []
    for name, f in checks.items():
        try:
            ok, detail = f()
        except Exception as e:  # a check that breaks is a failed check, not the end of the others
            ok, detail = False, f"{type(e).__name__}: {e}"
        rows.append((name, bool(ok), detail))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
