"""WAV files read in parts, filters that skip samples, paced playback."""

import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.sources import pcm
from tidesmith.sources.audio import decode_wav


def write(path, x, rate=16_000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.tobytes())


@pytest.fixture
def source(spark):
    spark.dataSource.register(pcm.Pcm)
    spark.dataSource.register(pcm.PacedPcm)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append(np.array(r["samples"]))
    return {k: np.concatenate(v) for k, v in out.items()}


def folder(tmp_path):
    r = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    write(tmp_path / "a.wav", r.integers(-9000, 9000, 5000).astype("<i2"))
    write(tmp_path / "deep" / "b.WAV", r.integers(-9000, 9000, (3000, 2)).astype("<i2"), 8000, 2)
    write(tmp_path / "c.wav", r.integers(0, 256, 700).astype(np.uint8), 16_000, 1, 1)
    write(tmp_path / "empty.wav", np.empty(0, "<i2"))
    (tmp_path / "bad.wav").write_bytes(b"RIFF....nothing")
    (tmp_path / "none.txt").write_bytes(b"x")


@pytest.mark.parametrize("part, row", [(64 << 20, 1 << 16), (999, 100), (47, 7)])
def test_any_parts_give_the_samples(source, tmp_path, part, row):
    folder(tmp_path)
    rows = source.read.format("pcm").option("part_bytes", part).option("frames_per_row", row).load(str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["samples"]) for r in rows if r["error"]] == [("bad.wav", None)]
    got = whole([r for r in rows if not r["error"]])
    assert sorted(got) == ["a.wav", "b.WAV", "c.wav"]
    for p in (tmp_path / "a.wav", tmp_path / "deep" / "b.WAV", tmp_path / "c.wav"):
        rate = 8000 if p.name == "b.WAV" else 16_000
        assert np.allclose(got[p.name], decode_wav(p.read_bytes(), rate), atol=1e-6)
    assert max(len(r["samples"]) for r in rows if r["samples"]) <= row


def test_formats(tmp_path):
    x = np.array([0.5, -0.25, 0.125, -1.0])
    cases = [(3, 32, x.astype("<f4").tobytes()), (3, 64, x.astype("<f8").tobytes()), (1, 32, (x * 2**31).astype("<i4").tobytes()), (1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x))]
    for kind, bits, data in cases:
        fmt = struct.pack("<HHIIHH", kind, 1, 16_000, 16_000 * bits // 8, bits // 8, bits)
        ext = struct.pack("<HHIIHH", 0xFFFE, 1, 16_000, 16_000 * bits // 8, bits // 8, bits) + struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + b"\0" * 14
        plain = b"RIFF\0\0\0\0WAVE" + b"LIST\3\0\0\0abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
        wide = b"RF64\xff\xff\xff\xffWAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 4, 0) + b"fmt " + struct.pack("<I", 40) + ext + b"data\xff\xff\xff\xff" + data + b"junk"
        for k, file in enumerate((plain, wide)):
            p = tmp_path / f"{kind}-{bits}-{k}.wav"
            p.write_bytes(file)
            with pcm.opened(str(p)) as f:
                form = pcm.layout(f, len(file))
                assert form.frames == 4 and np.allclose(pcm.samples_of(f.read_at(len(data), form.begin), form), x, atol=1e-6)


def test_filters_skip_what_a_header_rules_out(source, tmp_path):
    folder(tmp_path)
    df = source.read.format("pcm").load(str(tmp_path))
    names = lambda d: sorted({r["path"].rsplit("/", 1)[1] for r in d.select("path").collect()})
    assert names(df.filter("sample_rate = 8000")) == ["b.WAV"]
    assert names(df.filter((F.col("duration_s") > 0.2) & (F.col("sample_rate") == 16_000))) == ["a.wav"]
    assert names(df.filter(F.col("path").endswith("c.wav"))) == ["c.wav"] and names(df.filter("frames IN (700, 3000) AND channels < 2")) == ["c.wav"]
    reader = pcm.PcmReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([pcm.ds.EqualTo(("sample_rate",), 8000), pcm.ds.GreaterThan(("start",), 5)]))
    assert [f.attribute for f in left] == [("start",)]
    read = []
    real = pcm.samples_of
    pcm.samples_of = lambda raw, form: read.append(len(raw)) or real(raw, form)
    try:
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        pcm.samples_of = real
    assert rows == 1 and read == [3000 * 4]


def test_a_file_of_3_gb_is_read_in_parts(source, tmp_path):
    """A sparse file: its samples are zero but for two places; only parts around them are asked for."""
    n = 1_500_000_000
    path = tmp_path / "big.wav"
    with open(path, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + 2 * n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", 2 * n))
        f.truncate(44 + 2 * n)
        for at in (10, n - 5):
            f.seek(44 + 2 * at)
            f.write(struct.pack("<h", 16_384))
    reader = pcm.PcmReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) == 45 and max(z - a for p in parts for *_, a, z in p.parts) == 64 << 20
    for p, at in ((parts[0], 10), (parts[-1], n - 5)):
        found = [b.column("start")[0].as_py() + int(k) for b in reader.read(p) for k in np.flatnonzero(b.column("samples").flatten().to_numpy())]
        assert found == [at]
    count = source.read.format("pcm").option("part_bytes", 256 << 20).option("frames_per_row", 1 << 22).load(str(path)).select(F.sum(F.size("samples")), F.max("frames")).first()
    assert tuple(count) == (n, n)


def test_playback_goes_on_after_a_restart(source, tmp_path):
    x = np.random.default_rng(3).integers(-9000, 9000, 1000).astype("<i2")
    write(tmp_path / "mic.wav", x)
    chunks = np.pad(x, (0, 24)).reshape(-1, 256) / 32768
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for round_ in (1, 2):
        stream = source.readStream.format("paced_pcm").option("chunk", 256).option("speed", 4).option("burst", 9).load(str(tmp_path / "mic.wav"))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        until = time.time() + 60
        try:
            while time.time() < until:
                time.sleep(0.3)
                try:
                    if source.read.parquet(out).count() >= 12 * round_:
                        break
                except Exception:  # nothing is written yet
                    pass
        finally:
            q.stop()
    rows = sorted((r["seq"], r["pcm"]) for r in source.read.parquet(out).collect())
    assert [s for s, _ in rows] == list(range(len(rows))) and len(rows) >= 24
    assert all(np.allclose(p, chunks[s % 4], atol=1e-6) for s, p in rows)


def test_playback_without_a_loop_ends(tmp_path):
    write(tmp_path / "a.wav", np.ones(600, "<i2"))
    write(tmp_path / "b.wav", np.ones(100, "<i2"))
    reader = pcm.PacedReader({"path": str(tmp_path), "chunk": 256, "speed": 0, "loop": "false", "burst": 2})
    first, at = reader.read(reader.initialOffset())
    second, end = reader.read(at)
    assert [(s.rsplit("/", 1)[1], k) for s, k, *_ in [*first, *second]] == [("a.wav", 0), ("a.wav", 1), ("b.wav", 0), ("a.wav", 2)] and end == {"chunk": 3}
    assert reader.read(end)[1] == end and list(reader.readBetweenOffsets({"chunk": 0}, {"chunk": 1}))[0][2][:2] == [1 / 32768] * 2
