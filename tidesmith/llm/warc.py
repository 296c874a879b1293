"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Writing: of pages with equal payloads the one with the largest id becomes a
response record, the others revisit records that refer to it. A partition's
records, one after another, are a file; Spark's text sink writes them, so any
store that Spark knows will do.

Reading: Spark splits archives into byte ranges at the record magic. A task
emits, for every piece that begins with a whole header, a candidate: its offset
and its successor's, which the declared length gives, drawn together to the
first offset that the chain from it reaches beyond the range. Pointer jumping
from the starts of files over the candidates of all ranges, doubling the step
each round, finds where the chain of records enters each range. From there a
second pass keeps the candidates that the chain reaches; the others are magic
words inside payloads and are rejected, and their pieces belong to the record
around them, over the ends of ranges too. A chain that meets no candidate ends.

A null payload counts as empty; equal empty payloads are deduplicated like any
other. Payloads are written whole, `rows_per_file` records to a file at most;
files are read in parts, so their size needs no bound. A magic, or the
beginning of one, at the end of a payload stays there. Size and digest of a
response are those of the bytes read, and `intact` says whether its header has
the same. Rows that repeat an id, ties among them, are written each. A row with a null id is a record that reads back with a null
id; it revisits an equal payload with an id, and is a response without one. An
empty table gives no records. Extra columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, shared_dir, table, written

MAGIC = b"WARC/1.0\r\n"
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*\r\n", re.I)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(column) -> object:
    """The SHA-1 of a binary column in base32, with built-in functions: the digest's 160 bits, five at a time."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(column), 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)))
    letter = lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*(letter(i) for i in range(32)))


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_of(page: int | None, url: str, payload: bytes, refers: int | None) -> bytes:
    """One record with its closing blank lines. A revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers is None else http
    line = re.sub(r"[\r\n]+", " ", url)
    line += " " if line.endswith("WARC/1.0") else ""  # no header holds the magic
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {line}", f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, rows_per_file: int = 2000) -> None:
    """Writes a record for each page. Payloads of fewer than `least_bytes` bytes are never revisits."""
    body = F.coalesce(named(payload), F.lit(""))
    one = pages.select(named(key).alias("id"), F.coalesce(named(url), F.lit("")).alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    # the one row of a digest that is a response: only digests of at least two rows matter, and those travel without payloads
    last = one.groupBy("digest", "n").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) & (F.col("n") >= least_bytes)).select("digest", "last")
    # written first: Spark then knows its size, and leaves the payloads in place if it is small
    planned = one.join(written(last, "warc-last"), "digest", "left").withColumn("refers", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [record_of(i, u, p.encode(), r)[:-1] for i, u, p, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], names=["value"])

    # the sink ends each value with the line break that closes its record
    planned.select("id", "url", "payload", "refers").mapInArrow(run, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", rows_per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) of the archives, cut behind each magic: `block` is where the byte range begins that holds the piece. A task reads the pieces of a range in order."""
    cut = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def header(piece: bytes) -> tuple[int, int] | None:
    """Of a piece that begins with a whole header: where its block begins and where it ends."""
    end = piece.find(b"\r\n\r\n")
    m = LENGTH.search(b"\r\n" + piece[: end + 2]) if end >= 0 else None
    return (end + 4, end + 4 + int(m[1])) if m and len(m[1]) < 16 else None


def exits(at: np.ndarray, successors: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate of a range of `total` bytes leaves it, by pointer jumping; -1 where it ends within."""
    n = len(at)
    if not n:
        return successors
    k = np.minimum(np.searchsorted(at, successors), n - 1)
    hop = np.where(at[k] == successors, k, np.arange(n))
    while not np.array_equal(further := hop[hop], hop):
        hop = further
    return np.where(successors[hop] >= total, successors[hop], -1)


def by_range(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[bool, tuple]]:
    """(whether a range begins, row) of each piece."""
    held = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            yield row[:2] != held, row
            held = row[:2]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, to) of each candidate, offsets counted from the first piece of the range and behind the magic; at = -1: the bytes of the range."""

    def told(key: tuple, found: list, total: int) -> pa.RecordBatch:
        x = np.array(found, np.int64).reshape(-1, 2)
        at, to = np.append(x[:, 0], -1), np.append(exits(x[:, 0], x[:, 1], total), total)
        return pa.RecordBatch.from_arrays([pa.array([key[k]] * len(at), t) for k, t in enumerate((pa.string(), pa.int64()))] + [pa.array(at), pa.array(to)], names=["file", "block", "at", "to"])

    key, found, total = None, [], 0
    for begins, (file, block, value) in by_range(batches, ("file", "block", "value")):
        if begins:
            if key:
                yield told(key, found, total)
            key, found, total = (file, block), [], 0
        # nothing precedes a file's first piece
        if (total or block) and (h := header(value)):
            found.append((total, total + h[1] + 4 + len(MAGIC)))
        total += len(value) + len(MAGIC)
    if key:
        yield told(key, found, total)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, base, entry, crossed): where each range's first piece is in its file, where, from there, the chain of records enters it (null where it does not), and whether a record of the file may go on from one range to another."""
    links = written(pieces(spark, path).mapInArrow(candidates, "file string, block bigint, at bigint, to bigint"), "warc-links")
    before = F.sum("to").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranges = written(links.filter("at < 0").select("file", "block", F.coalesce(before, F.lit(0)).alias("base"), F.sum("to").over(Window.partitionBy("file")).alias("bytes")), "warc-ranges")
    nodes = links.filter("at >= 0").join(ranges, ["file", "block"]).select("file", "block", "at", (F.col("base") + F.col("at")).alias("p"), F.when((F.col("to") >= 0) & (F.col("base") + F.col("to") < F.col("bytes")), F.col("base") + F.col("to")).alias("q"))
    reached = nodes.filter(F.col("p") == len(MAGIC)).select("file", "p")
    # of files of one range no pointer leaves it, and no round is needed
    step = nodes.filter("q IS NOT NULL").select("file", "p", "q")
    count = 0
    while not step.isEmpty():
        step, reached = written(step, "warc-step"), written(reached, "warc-reached")
        if (now := reached.count()) == count:
            break
        count = now
        reached = reached.union(reached.join(step, ["file", "p"]).select("file", F.col("q").alias("p"))).distinct()
        step = step.join(step.select("file", F.col("p").alias("q"), F.col("q").alias("r")), ["file", "q"]).select("file", "p", F.col("r").alias("q"))
    entered = nodes.join(reached, ["file", "p"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    crossed = F.max((F.col("base") > 0) & (F.coalesce("entry", F.lit(1)) > 0)).over(Window.partitionBy("file"))
    return written(ranges.select("file", "block", "base").join(entered, ["file", "block"], "left").withColumn("crossed", crossed), "warc-entries")


RECORD = "file string, offset bigint, record_type string, id bigint, url string, digest string, payload_bytes bigint, refers_to bigint, payload string, intact boolean"


def parsed(data: bytes) -> tuple:
    """The fields of a record from its bytes behind the magic."""
    start, end = header(data)
    head = {name: value.rstrip() for name, _, value in (x.partition(": ") for x in data[: start - 4].decode("utf-8", "replace").split("\r\n"))}
    block = data[start:end]
    split = block.find(b"\r\n\r\n")
    body, kind = block[split + 4 :], head.get("WARC-Type", "")
    n = LENGTH.search(block, 0, split + 2)
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get(name, ""))) else None
    digest, size = head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), int(n[1]) if n else len(body)
    names = page("WARC-Record-ID"), head.get("WARC-Target-URI")
    if kind == "revisit":  # its payload is elsewhere
        return kind, *names, digest, size, page("WARC-Refers-To"), None, None
    read = _sha1(body)
    return kind, *names, read, len(body), page("WARC-Refers-To"), body.decode("utf-8", "replace"), (read, len(body)) == (digest, size)


def read_warc(spark: SparkSession, path: str, broadcast_ranges: int = 200_000) -> DataFrame:
    """The records of all files under `path`: file, offset, record_type, id, url, digest, payload_bytes, refers_to, payload (null for revisits), intact (the payload has the digest).

    What is known of up to `broadcast_ranges` byte ranges is broadcast; of more it is joined, and the pieces are put in order again.
    """
    known, cut = entries(spark, path), pieces(spark, path)
    if known.count() <= broadcast_ranges:
        joined = cut.join(F.broadcast(known), ["file", "block"])
    else:
        joined = cut.withColumn("nr", F.monotonically_increasing_id()).join(known.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "nr")
    cut = joined.select("file", "block", "value", "base", "entry", "crossed")
    found = cut.mapInArrow(assembled, f"{RECORD}, part bigint, bytes binary")
    whole = found.filter("part IS NULL").drop("part", "bytes")
    if known.filter("crossed").isEmpty():
        return whole
    # the parts of records that go over the end of a range; those without an offset belong to the last record before them
    parts = cut.filter("crossed").mapInArrow(assembled, f"{RECORD}, part bigint, bytes binary").filter("part IS NOT NULL")
    owner = F.last("offset", ignorenulls=True).over(Window.partitionBy("file").orderBy("part"))
    over = parts.withColumn("offset", owner).filter("offset IS NOT NULL").groupBy("file", "offset").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "bytes"))), lambda x: x["bytes"]).alias("parts"))
    return whole.unionByName(over.mapInArrow(rejoined, RECORD))


NAMES = [f.split()[0] for f in RECORD.split(", ")]
TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the pieces of ranges. What a range may not hold whole comes as rows with `part`, its place in the file, and `bytes`; without an offset if its record began in an earlier range."""
    rows: list[tuple] = []
    file = base = chain = None
    crossed, opened, wanted, at, held = False, -1, 0, 0, []

    def close() -> None:
        """Ends the record at hand (opened: its place in the range), or what precedes the first (-1)."""
        data = MAGIC.join(held)
        if opened >= 0 and (len(data) >= wanted or not crossed):
            rows.append((file, base + opened - len(MAGIC), *parsed(data), None, None))
        elif held and crossed:
            rows.append((file, base + opened - len(MAGIC) if opened >= 0 else None, *[None] * 8, base + max(opened, 0), data))
        held.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*TYPES, pa.int64(), pa.binary()), strict=True)], names=[*NAMES, "part", "bytes"])

    size = 0
    for begins, (name, _, value, where, entry, over) in by_range(batches, ("file", "block", "value", "base", "entry", "crossed")):
        if begins:
            close()
            file, base, chain, crossed, opened, at = name, where, entry, over, -1, 0
        if at == chain and (h := header(value)):
            close()
            opened, wanted, chain = at, h[1], at + h[1] + 4 + len(MAGIC)
        # a piece whose magic begins within the record belongs to it, be it for the magic alone
        if at - len(MAGIC) < opened + wanted if opened >= 0 else crossed:
            held.append(value)
        at += len(value) + len(MAGIC)
        size += len(value)
        if size > 4 << 20 and rows:
            yield batch()
            rows, size = [], 0
    close()
    if rows:
        yield batch()


def rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their parts."""
    for b in batches:
        done = [(f, o, *parsed(MAGIC.join(x))) for f, o, x in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "parts")), strict=True)]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], names=NAMES)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.coalesce("intact", F.lit(True)).alias("intact"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (
  SELECT x, array_to_string(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[instr('0123456789abcdef', x[i])]), '') AS bits
  FROM (SELECT DISTINCT x FROM d)
),
e AS (
  SELECT x, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * (substr(bits, 5 * k + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * k + 2, 1) = '1')::INT + 4 * (substr(bits, 5 * k + 3, 1) = '1')::INT
      + 2 * (substr(bits, 5 * k + 4, 1) = '1')::INT + (substr(bits, 5 * k + 5, 1) = '1')::INT), 1)), '') AS payload_digest
  FROM b
),
m AS (SELECT x, max(page_id) AS last FROM d GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact
FROM d JOIN e USING (x) JOIN m USING (x)
"""
