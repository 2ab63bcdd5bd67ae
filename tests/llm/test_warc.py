"""Archives, their index, and reading them back."""

import base64
import gzip
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from hostlens.llm import warc as W
from hostlens.sources.store import work_path

SCHEMA = "page_id long, url string, html string, digest string, size int"


def pages():
    rnd = random.Random(3)
    rows = [(i, f"http://h{i % 9}.example.org/p{i % 40}", f"<p>é {i % 60}</p>\r\n\r\n" * (i % 5 + 1)) for i in range(150)]
    rows += [(200, None, None), (201, "", ""), (202, "http://x.org/\r\nInjected: 1\t\0", ""), (203, "no url", "WARC/1.1\r\n\r\n"),
             (None, "http://n.org", "alone"), (None, "http://n.org", rows[0][2]), (5, rows[5][1], rows[5][2]),
             (204, "HTTPS://User.B.org:8080/x?y#z", "".join(rnd.choice("abcé") for _ in range(300_000)))]
    return rows


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            top[h or ""] = max(top.get(h or "", i), i)
    count, out = Counter(h or "" for _, _, h in rows), Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        leader = top.get(h or "") if count[h or ""] > 1 else None
        revisit = leader is not None and i != leader
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[i, len(raw), digest, "revisit" if revisit else "response", leader if revisit else None] += 1
    return out


def written(spark, rows, **settings):
    archive = W.Archive(work_path(spark, "warc"), **settings)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    W.write(df, archive)
    return archive, df


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    for settings in ({}, {"records_per_file": 7, "lines_per_block": 4, "broadcast_ranges": 1}, {"min_bytes": 40}):
        archive, df = written(spark, pages(), **settings)
        found = W.lookup(df.select(W.capture_key(F.col("url")).alias("key")), archive)
        got = W.read(found, archive)
        assert Counter(map(tuple, got.select(*COLUMNS).collect())) == expected(pages(), settings.get("min_bytes", 0))
        whole = {r.page_id: r.html for r in got.where("record_type = 'response'").collect()}
        texts = {i: h or "" for i, _, h in pages()}
        assert all(whole[i] == texts[i] for i in whole if i is not None)


def test_files_are_plain_gzip_members(spark):
    archive, _ = written(spark, pages(), records_per_file=20)
    records = 0
    for r in W.archive_files(spark, archive).collect():
        text = gzip.decompress(bytes(r.content))
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        for at, n, one in W.members(bytes(r.content)):
            assert gzip.decompress(bytes(r.content)[at : at + n]) == one
            head, block = W.headers(one)
            assert len(block) == int(head["Content-Length"]) + 4
            records += 1
    assert records == len(pages())


def test_members_that_end_in_another_byte():
    import zlib

    first = zlib.compress(b"a" * 10, 3, 31)
    big = first[:-1] + b"\x01"  # as for a text of 16 MB and more
    assert [m[:2] for m in W.members(first + W._EMPTY_MEMBER + first)] == [(0, len(first + W._EMPTY_MEMBER)), (len(first + W._EMPTY_MEMBER), len(first))]
    assert W._EMPTY_MEMBER[-1] == 0 and big[-1] == 1


def test_lookup_of_some_keys(spark):
    archive, _ = written(spark, pages(), lines_per_block=3)
    keys = spark.createDataFrame([("org,example,h3)/p3",), ("org,example,h3)/p3",), ("missing",), (None,), ("~",), ("",)], "key string")
    found = [(r.key, r.file) for r in W.lookup(keys, archive).collect()]
    want = Counter(k for k in [
        "org,example,h3)/p3" if (u or "") == "http://h3.example.org/p3" else "" if not u else None for _, u, _ in pages()] if k is not None)
    assert Counter(k for k, _ in found) == want


def test_directory_with_long_keys():
    keys = sorted(b"k" * 300 + bytes([65 + i]) for i in range(20))
    rows = [{"block": n, "first": keys[2 * n], "last": keys[2 * n + 1]} for n in range(10)]
    d = W.Directory(rows)
    assert all(n in d.candidates(keys[2 * n]) and n in d.candidates(keys[2 * n + 1]) for n in range(10))
    short = W.Directory([{"block": n, "first": bytes([65 + 2 * n]), "last": bytes([66 + 2 * n])} for n in range(5)])
    assert [short.candidates(bytes([c])) for c in (64, 65, 66, 67, 75)] == [[], [0], [0], [1], []]


def test_empty_table(spark):
    archive, df = written(spark, [])
    found = W.lookup(df.select(W.capture_key(F.col("url")).alias("key")), archive)
    assert W.read(found, archive).count() == 0


def test_keys(spark):
    urls = [("http://b.A.org/x", "org,a,b)/x"), ("HTTPS://a.org:80?q#f", "org,a:80)?q#f"), ("plain", "plain"), (None, ""), ("a\nb", "a%0Ab")]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(W.capture_key(df.u)).collect()] == [k for _, k in urls]
