"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing is JVM work only: a record per row, laid out by column functions and written by the
text sink, whose line separator is the blank lines that end a record. Of pages with equal
payloads the smallest page_id is the response and the others are revisits of it.

Reading cuts files at every place where the version line occurs, also inside payloads, so
each split of a file can be scanned by its own task. A task emits for each candidate the
offset at which the record would end by its headers. Offsets of a split are shifted by the
bytes of the splits before it. Pointer jumping over record -> successor gives each candidate
the offset at which its chain leaves its split; jumping over these offsets from the file's start
finds where the file's chain enters each split, and jumping from there marks what is reachable.
Candidates that the chain does not reach lie inside payloads and are dropped. No task holds
more offsets than a split's candidates, or a file's entries into splits.

Defined cases: a null payload is empty; rows with the same payload and the same smallest page_id
are all responses; a null page_id ranks last, and a group of null ids only is all responses; a
null url is written as ``about:blank``; an empty table gives an archive without records; other
columns are ignored; payloads may hold any text, also whole WARC records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, pick, shared_path, staged

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Bytes of duplicate digests that may be sent to every task; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of a file in which pieces look for their record together.
STRETCH = 1 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 5 digits are 20 bits are 4 letters."""
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _one_line(text: Column) -> Column:
    """Header values stay on one line: white space and controls as %XX of their code."""
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))).otherwise(text)


def first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """payload_key, first: the smallest page_id of each payload that several pages hold."""
    keyed = pages.select("page_id", F.sha2("payload", 256).alias("payload_key"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    return keyed.groupBy("payload_key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("payload_key", "first")


def write(df: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write an archive of uncompressed files; payloads of under ``least_bytes`` are never revisited."""
    pages = pick(df, page_id=id_col, url=url_col, payload=html_col).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    copies = staged(first_pages(pages, least_bytes), "copies")
    if copies.count() * 96 <= BROADCAST_BYTES:
        copies = F.broadcast(copies)
    rows = pages.withColumn("n", F.octet_length("payload")).withColumn("payload_key", F.when(F.col("n") >= least_bytes, F.sha2("payload", 256)))
    rows = rows.join(copies, "payload_key", "left")
    original = F.col("first").isNull() | F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = base32_of_hex(F.sha1(F.col("payload").cast("binary")))
    block = F.when(original, F.concat(http, F.col("payload"))).otherwise(http)
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(original, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), _one_line(F.coalesce("url", F.lit("about:blank"))),
        F.when(original, "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(original, F.col("n")).otherwise(0)).cast("string"), F.lit(END),
    )
    rows.select(F.concat(header, block).alias("record")).write.option("lineSep", END).text(path)


_HEADERS = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
#: What a task says of each piece between two version lines. A piece belongs to the candidate
#: whose version line is before it; ``next`` is relative to that candidate's start.
CANDIDATE = "file string, block long, k long, at long, n_bytes long, next long, record_type string, record_id string, refers_to string, declared_digest string, payload_bytes long, payload_digest string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", "value")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split start, number and byte offset in the split, bytes) of each piece."""
    where, k, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, block) != where:
                where, k, at = (file, block), 0, 0
            raw = value.as_buffer()
            data = raw.to_pybytes() if raw is not None else b""
            yield file, block, k, at, data
            k, at = k + 1, at + len(data) + len(MAGIC)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _payload(kind: str | None, block: bytes) -> tuple[int, str] | None:
    """(bytes, digest) of a record's payload, from its block."""
    end = block.find(END.encode())
    if kind != "response" or end < 0:
        return None
    body = block[end + len(END) :]
    return len(body), _digest(body)


def _candidate(data: bytes) -> tuple:
    """(next, type, id, refers to, declared digest, payload bytes, payload digest) of a piece."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return (None,) * 7
    fields = {k.lower(): v.decode("utf-8", "replace") for k, v in _HEADERS.findall(data[:end].replace(b"\r\n", b"\n"))}
    size = fields.get(b"content-length", "")
    if not size.isdecimal():
        return (None,) * 7
    start, stop = end + 4, end + 4 + int(size)
    kind = fields.get(b"warc-type")
    measured: tuple = (None, None)
    if stop <= len(data):
        measured = _payload(kind, data[start:stop]) or (None, None)
    if kind == "revisit":  # the length of the payload revisited stands in the HTTP header
        told = re.search(rb"Content-Length: (\d+)", data[start : min(stop, len(data))])
        measured = (int(told[1]) if told else None, fields.get(b"warc-payload-digest", "").removeprefix("sha1:"))
    return (len(MAGIC) + stop + len(END), kind, fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest"), *measured)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece of each file, by CANDIDATE; pieces are read split by split."""
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in CANDIDATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for file, block, k, at, data in _numbered(batches):
            rows.append((file, block, k, at, len(data), *_candidate(data)))
            if len(rows) == 4096:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return _pieces(spark, path).mapInArrow(run, CANDIDATE)


def _jumps(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The place of each candidate's successor among sorted starts; their number if there is none."""
    at = np.searchsorted(starts, following)
    return np.where((at < starts.size) & (starts[np.minimum(at, starts.size - 1)] == following), at, starts.size)


def leaving(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The first offset on each candidate's chain at which no candidate starts, by pointer jumping."""
    jump = _jumps(starts, following)
    last = np.where(jump < starts.size, jump, np.arange(starts.size))
    while (last[last] != last).any():
        last = last[last]
    return following[last]


def reachable(starts: np.ndarray, following: np.ndarray, origin: int = 0) -> np.ndarray:
    """Which candidates the chain from the one at ``origin`` reaches, by pointer jumping.

    starts: sorted offsets; following: the offset at which each would end. Marks double their
    reach in each round, so a chain of n records takes log2(n) rounds."""
    n = starts.size
    jump = np.append(_jumps(starts, following), n) if n else np.zeros(1, np.int64)
    good = np.append(starts == origin, False)
    while True:
        more = good.copy()
        more[jump[good]] = True
        doubled = jump[jump]
        if (more == good).all() and (doubled == jump).all():
            return good[:n]
        good, jump = more, doubled


def _offsets(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns in the order of their starts; -1 for null."""
    found = [rows[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
    order = np.argsort(found[0])
    return [c[order] for c in found]


def _of(rows: pa.Table, starts: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Offsets of one file."""
    return pa.table({"file": pa.array([rows["file"][0].as_py()] * starts.size, pa.string()), "start": pa.array(starts, pa.int64())} | columns)


def chained(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches, with their offset."""
    splits = found.groupBy("file", "block").agg(F.sum(F.col("n_bytes") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # the first piece of a file stands before its first version line
    placed = found.join(splits, ["file", "block"]).withColumn("start", F.col("base") + F.col("at") - len(MAGIC)).where("start >= 0")

    def out_of(split: pa.Table) -> pa.Table:  # one split's candidates
        starts, following = _offsets(split, "start", "following")
        return _of(split, starts, block=pa.array(np.full(starts.size, split["block"][0].as_py())), following=following, leaves=leaving(starts, following))

    links = placed.select("file", "block", "start", (F.col("start") + F.col("next")).alias("following"))
    links = staged(links.groupBy("file", "block").applyInArrow(out_of, "file string, start long, block long, following long, leaves long"), "links")

    def entered(of_file: pa.Table) -> pa.Table:  # about one entry for each of a file's splits
        starts, leaves, block = _offsets(of_file, "start", "leaves", "block")
        good = reachable(starts, leaves)
        return _of(of_file, starts[good], block=block[good])

    aims = links.select("file", F.col("leaves").alias("start")).union(links.select("file", F.lit(0).cast("long")).distinct()).distinct()
    entries = links.join(aims, ["file", "start"]).select("file", "block", "start", "leaves").groupBy("file").applyInArrow(entered, "file string, start long, block long")

    def within(split: pa.Table) -> pa.Table:
        starts, following = _offsets(split, "start", "following")
        return _of(split, starts[reachable(starts, following, split["entry"][0].as_py())])

    entered_at = entries.select("file", "block", F.col("start").alias("entry"))
    on_chain = links.join(entered_at, ["file", "block"]).groupBy("file", "block").applyInArrow(within, "file string, start long")
    return placed.join(on_chain, ["file", "start"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, start, record_type, record_id, refers_to, declared_digest, payload_bytes and
    payload_digest of every record. The payload of a record that holds version lines spans
    several pieces; those pieces alone are read again and joined."""
    found = staged(candidates(spark, path), "candidates")
    records = staged(chained(found).where("record_type is not null"), "records")
    spanning = records.where((F.col("record_type") == "response") & F.col("payload_digest").isNull() & F.col("next").isNotNull())
    columns = ["file", "start", "record_type", "record_id", "refers_to", "declared_digest", "payload_bytes", "payload_digest"]
    if spanning.isEmpty():
        return records.select(*columns)
    whole = records.join(spanned(spark, path, found, spanning), ["file", "start"], "left")
    pick_ = lambda c: F.coalesce(f"whole_{c}", c).alias(c)
    return whole.select("file", "start", "record_type", "record_id", "refers_to", "declared_digest", pick_("payload_bytes"), pick_("payload_digest"))


def spanned(spark: SparkSession, path: str, found: DataFrame, spanning: DataFrame) -> DataFrame:
    """(file, start, whole_payload_bytes, whole_payload_digest) of records that span pieces."""
    splits = found.groupBy("file", "block").agg(F.sum(F.col("n_bytes") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    placed = found.join(splits, ["file", "block"]).select("file", "block", "k", (F.col("base") + F.col("at") - len(MAGIC)).alias("piece"))
    # records of a file don't overlap: the record of a piece is the last that starts at or before
    # it. Pieces and records meet in stretches of a file, a record in each stretch that it touches.
    stretch = lambda offset: F.floor(offset / STRETCH)
    marks = spanning.select("file", F.col("start").alias("piece"), F.struct("start", (F.col("start") + F.col("next")).alias("stop")).alias("record"))
    marks = marks.withColumn("stretch", F.explode(F.sequence(stretch(F.col("piece")), stretch(F.col("record.stop") - 1))))
    rows = placed.withColumn("stretch", stretch(F.col("piece"))).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("file", "stretch").orderBy("piece", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.withColumn("record", F.last("record", ignorenulls=True).over(upto)).where("k is not null and record is not null and piece < record.stop")
    parts = staged(owned.select("file", "block", "k", "piece", F.col("record.start").alias("start"), F.col("record.stop").alias("stop")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, k, _, data in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "k", "data"])

    texts = _pieces(spark, path).mapInArrow(run, "file string, block long, k long, data binary").join(parts, ["file", "block", "k"])

    def joined(of_record: pa.Table) -> pa.Table:  # one record
        of_record = of_record.sort_by("piece")
        data = MAGIC.encode().join(of_record["data"].to_pylist())
        head = data.find(b"\r\n\r\n") + 4
        stop = of_record["stop"][0].as_py() - of_record["start"][0].as_py() - len(MAGIC) - len(END)
        n, digest = _payload("response", data[head:stop]) or (None, None)
        return pa.table({"file": [of_record["file"][0].as_py()], "start": pa.array([of_record["start"][0].as_py()], pa.int64()), "whole_payload_bytes": pa.array([n], pa.int64()), "whole_payload_digest": pa.array([digest], pa.string())})

    return texts.groupBy("file", "start").applyInArrow(joined, "file string, start long, whole_payload_bytes long, whole_payload_digest string")


def round_trip(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write an archive, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    path = shared_path(spark, "warc")
    write(df, path, least_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    out = staged(read(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")), "pages")
    discard(spark, path)
    return out


#: 5 hex digits are 20 bits are 4 letters
_LETTERS = " || ".join(
    f"substr('{_ALPHABET}', ((CAST('0x' || substr(hex, {5 * (i // 4) + 1}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31) + 1, 1)" for i in range(32)
)
SQL = f"""
WITH rows_ AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
keyed AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
    min(page_id) OVER (PARTITION BY payload) AS first, count(*) OVER (PARTITION BY payload) AS copies FROM rows_)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN copies = 1 OR first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN copies = 1 OR first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM keyed
"""
