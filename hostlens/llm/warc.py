"""WARC archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own.  Of pages with equal
payloads (of at least ``min_bytes``) the one with the largest page_id is written
whole, the others as revisits that refer to it.  Every task writes its records to
a file through Spark's text sink, whose commit protocol survives lost executors;
the sink's line separator is the zero byte in which every member ends.

The index is made from the archives as they are: members are walked, and their
keys (URLs with reversed host) sorted with file, offset and length into blocks of
lines, each compressed.  A sparse directory keeps the first and last key of each
block; the number of lines of a block grows with the archive so that the directory
keeps below ``max_blocks`` rows, small enough for every task.  A lookup searches the
directory by bisection, then the block, and reads just the bytes of the records.

Null URLs and payloads are empty; line breaks and other control characters of a
URL are percent-coded in the record.  A page without id refers to the largest id
of its payload, or is written whole if there is none.  Rows that repeat the
largest id are all written whole.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.llm.common import attach, col, materialize, query, small_batches, table
from hostlens.sources.store import work_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = zlib.compress(b"", 1, 31)


@dataclass(frozen=True)
class Archive:
    """Where things are, and their sizes."""

    path: str
    date: str = "2024-01-01T00:00:00Z"
    min_bytes: int = 0
    records_per_file: int = 2000
    lines_per_block: int = 1000
    max_blocks: int = 50_000
    #: so many byte ranges at most are broadcast to the archive files; more are joined by a shuffle
    broadcast_ranges: int = 500_000

    @property
    def files(self) -> str:
        return f"{self.path}/archive"

    @property
    def blocks(self) -> str:
        return f"{self.path}/blocks"


def base32(digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them make four letters."""
    number = lambda i: F.conv(F.substring(digits, F.lit(5) * i + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(ALPHABET), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(
        *[letter(number(i), shift) for shift in (15, 10, 5, 0)])), "")


def clean_url(url: Column) -> Column:
    """Without characters that end a header line."""
    out = F.coalesce(url, F.lit(""))
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), ("\0", "%00")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def capture_key(url: Column) -> Column:
    """``http://b.a.org:80/x`` becomes ``org,a,b:80)/x``; what is no such URL stays."""
    clean = clean_url(url)
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)([^/?#]*)(.*)$"
    host = F.lower(F.regexp_extract(clean, pattern, 1))
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(clean.rlike(pattern), F.concat(
        turned, F.regexp_extract(clean, pattern, 2), F.lit(")"), F.regexp_extract(clean, pattern, 3)
    )).otherwise(clean)


def _lines(*lines) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in lines])


def records(pages: DataFrame, a: Archive) -> DataFrame:
    """(record) texts, ending in the blank line that ends a record."""
    rows = pages.select(
        col("page_id").alias("page_id"), clean_url(col("url")).alias("url"), F.coalesce(col("html"), F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    leaders = materialize(
        rows.where(F.col("size") >= a.min_bytes).groupBy("sha1").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select("sha1", "leader"),
        "warc-leaders",
    )
    rows = attach(rows, leaders, "sha1", "leader").withColumn("digest", base32(F.col("sha1")))
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("size").cast("string"), "\r\n\r\n")
    name = lambda c: _lines("<urn:page:", F.coalesce(c.cast("string"), F.lit("")), ">")
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return rows.select(_lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: ", name(F.col("page_id")), f"\r\nWARC-Date: {a.date}\r\nWARC-Target-URI: ", F.col("url"),
        "\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        F.when(revisit, _lines(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", name(F.col("leader")))).otherwise(""),
        "\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: ", F.octet_length(body).cast("string"),
        "\r\n\r\n", body, "\r\n\r\n",
    ).alias("record"))


def write(pages: DataFrame, a: Archive) -> None:
    """Writes archive files and the index of what is in them."""
    small_batches(pages)

    @F.pandas_udf("binary")
    def member(texts: pd.Series) -> pd.Series:
        packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 3, 31) for t in texts]
        # the last byte, zero below 16 MB of text, is written by the sink as its separator
        return pd.Series([(m if m[-1] == 0 else m + _EMPTY_MEMBER)[:-1] for m in packed], dtype=object)

    packed = records(pages, a).select(member("record").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", a.records_per_file).text(a.files)
    index(pages.sparkSession, a)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, text) of the gzip members of a file; empty ones belong to the
    member before them."""
    at, view, step = 0, memoryview(content), 1 << 16
    held: tuple[int, int, bytes] | None = None
    while at < len(view):
        start, parts, unpack = at, [], zlib.decompressobj(31)
        while not unpack.eof and at < len(view):
            parts.append(unpack.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(unpack.unused_data)
        text = b"".join(parts)
        if text or held is None:
            if held is not None:
                yield held
            held = start, at - start, text
        else:
            held = held[0], at - held[0], held[2]
    if held is not None:
        yield held


def headers(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:]), block


def archive_files(spark: SparkSession, a: Archive) -> DataFrame:
    """(file, content), one row per archive file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(a.files)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index(spark: SparkSession, a: Archive) -> None:
    """Reads all archive files and writes the blocks of the index."""

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part["file"], part["content"]):
                rows = [(headers(text)[0]["WARC-Target-URI"], at, n) for at, n, text in members(content.as_py())]
                urls, offsets, lengths = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch(
                    [pa.array(urls, pa.string()), pa.array([name.as_py()] * len(rows), pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["url", "file", "offset", "length"],
                )

    files = archive_files(spark, a)
    small_batches(files)
    lines = materialize(
        files.mapInArrow(walk, "url string, file string, offset long, length long")
        .select(capture_key(F.col("url")).alias("key"), "file", "offset", "length"),
        "warc-lines",
    )
    n = lines.count()
    per_block = max(a.lines_per_block, -(-n // (a.max_blocks * 9 // 10)))
    order = ["key", "file", "offset"]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "".join("\t".join(map(str, r)) + "\n" for r in rows)
            return pa.record_batch(
                [pa.array([number], pa.int64()), *[pa.array([rows[i][0].encode()], pa.binary()) for i in (0, -1)],
                 pa.array([zlib.compress(text.encode(), 6)], pa.binary())],
                ["block", "first", "last", "lines"],
            )

        for part in parts:
            held += zip(*[part[c].to_pylist() for c in ("key", "file", "offset", "length")])
            while len(held) >= per_block:
                yield block(held[:per_block])
                held, number = held[per_block:], number + 1
        if held:
            yield block(held)

    (
        lines.repartitionByRange(max(1, -(-n // (10 * per_block))), *order).sortWithinPartitions(*order)
        .mapInArrow(cut, "block long, first binary, last binary, lines binary")
        .write.parquet(a.blocks)
    )


class Directory:
    """First and last keys of all blocks in order; long keys are cut so that a block
    may seem to hold more, never less."""

    def __init__(self, rows: list, longest: int = 200):
        self.numbers = [r["block"] for r in rows]
        self.first = [bytes(r["first"])[:longest] for r in rows]
        self.last = [bytes(r["last"]) if len(r["last"]) <= longest else bytes(r["last"])[:longest] + b"\xff" for r in rows]

    def candidates(self, key: bytes) -> list[int]:
        low = bisect.bisect_left(self.last, key)
        return self.numbers[low : bisect.bisect_right(self.first, key, low)]


def directory(spark: SparkSession, a: Archive) -> Directory:
    """At most ``max_blocks`` rows come to the driver."""
    keys = spark.read.schema("block long, first binary, last binary").parquet(a.blocks)
    short = lambda c: F.substring(c, 1, 201)
    return Directory(keys.select("block", short("first").alias("first"), short("last").alias("last")).orderBy("block").collect())


def lookup(keys: DataFrame, a: Archive) -> DataFrame:
    """(key, file, offset, length) of all captures of the distinct keys in column ``key``."""
    spark = keys.sparkSession
    small_batches(keys)
    sparse = directory(spark, a)

    @F.pandas_udf("array<long>")
    def candidates(texts: pd.Series) -> pd.Series:
        return pd.Series([sparse.candidates(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    @F.pandas_udf("array<struct<key:string,file:string,offset:long,length:long>>")
    def search(blocks: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for packed, some in zip(blocks, wanted):
            rows = [x.split("\t") for x in zlib.decompress(packed).decode().split("\n")[:-1]]
            names, hits = [r[0].encode() for r in rows], []
            for key in some:
                raw = key.encode("utf-8", "surrogatepass")
                for r in rows[bisect.bisect_left(names, raw) : bisect.bisect_right(names, raw)]:
                    hits.append({"key": r[0], "file": r[1], "offset": int(r[2]), "length": int(r[3])})
            out.append(hits)
        return pd.Series(out, dtype=object)

    wanted = (
        keys.select("key").where(F.col("key").isNotNull()).distinct()
        .select("key", F.explode(candidates("key")).alias("block")).groupBy("block").agg(F.collect_list("key").alias("keys"))
    )
    blocks = spark.read.schema("block long, lines binary").parquet(a.blocks)
    return blocks.join(wanted, "block").select(F.explode(search("lines", "keys")).alias("hit")).select("hit.*")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(ranges: DataFrame, a: Archive, payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, html) of records
    at (file, offset, length); html only with ``payload``.  The payload of a whole
    record is held against its digest."""
    spark = ranges.sparkSession
    ranges = materialize(ranges.select("file", "offset", "length"), "warc-ranges")
    small_batches(ranges)
    per_file = ranges.groupBy(F.col("file").alias("f")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    if ranges.limit(a.broadcast_ranges + 1).count() <= a.broadcast_ranges:
        per_file = F.broadcast(per_file)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * payload]
    names = [c.split()[0] for c in READ.split(", ")] + ["html"] * payload

    def parse(packed: bytes) -> tuple:
        head, block = headers(next(members(packed))[2])
        http, _, rest = block[: int(head["Content-Length"])].partition(b"\r\n\r\n")
        size, digest = int(http.rpartition(b"Content-Length: ")[2]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        page, other = (head.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        whole = head["WARC-Type"] == "response"
        if whole and (len(rest) != size or base64.b32encode(hashlib.sha1(rest).digest()).decode() != digest):
            raise RuntimeError(f"record {head['WARC-Record-ID']} does not hold its payload")
        html = (rest.decode("utf-8", "surrogatepass") if whole else None,) * payload
        return int(page) if page else None, size, digest, head["WARC-Type"], int(other) if other else None, *html

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content, wanted in zip(part["content"], part["ranges"].to_pylist()):
                view = memoryview(content.as_buffer())
                for at in range(0, len(wanted), 200):
                    rows = [parse(bytes(view[r["offset"] : r["offset"] + r["length"]])) for r in wanted[at : at + 200]]
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    files = archive_files(spark, a).join(per_file, F.col("file") == F.col("f")).select("content", "ranges")
    return files.mapInArrow(cut, READ + ", html string" * payload)


_LETTER = " || ".join(f"substr('{ALPHABET}', 1 + ((n >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, list_aggregate(list_transform(
        list_transform(range(8), lambda i: CAST('0x' || substr(sha1(coalesce(html, '')), 5 * i + 1, 5) AS BIGINT)),
        lambda n: {_LETTER}), 'string_agg', '') AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to FROM g
"""


@query("op9_warc", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = Archive(work_path(spark, "warc"))
    write(pages, archive)
    found = lookup(pages.select(capture_key(F.col("url")).alias("key")), archive)
    return read(found, archive, payload=False)
