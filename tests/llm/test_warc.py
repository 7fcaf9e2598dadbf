import gzip
import random

import pytest

from helpers import rows_of, same
from packmill.llm import warc as W
from packmill.llm.common import new_dir
from packmill.llm.files import Attempt

PAGES = "page_id bigint, url string, html string"
FAKE = W.record("resource", {"WARC-Record-ID": "<urn:page:666>"}, b"inner").decode()


def whole(pages):
    return rows_of(pages.select("page_id", "url", "html"))


def file_of(spark, data):
    out = Attempt(new_dir(spark, "raw"), ".warc")
    out.write(data)
    out.close()
    return spark.createDataFrame([(out.uri, len(data))], "file string, bytes bigint")


def brute(data):
    """The chain of one file, read from its start."""
    at, out = 0, []
    while data.startswith(W._MAGIC, at):
        head = W._header(data, at)
        if head is None or sum(head) + 4 > len(data):
            break
        out.append((at, data[head[0] : sum(head)]))
        at = sum(head) + 4
    return out


@pytest.mark.parametrize("size", [64, 100, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_chain(spark, size):
    rng = random.Random(size)
    parts = [rng.choice([b"", b"x" * rng.randrange(300), FAKE.encode() * rng.randint(1, 3), b"WARC/1.0\r\n", b"\r\n\r\nWARC/1.0\r\nContent-Length: 7\r\n\r\n"]) for _ in range(80)]
    data = b"".join(W.record("resource", {"WARC-Record-ID": f"<urn:page:{i}>"}, p) for i, p in enumerate(parts))
    got = W.read(file_of(spark, data), size)
    assert sorted((r["offset"], bytes(r["payload"])) for r in got.collect()) == brute(data)
    assert len(brute(data)) == 80


def test_all_cases(spark):
    pages = spark.createDataFrame([(1, "http://a/é b\r\nContent-Length: 3", "<p>" + FAKE), (1, None, ""), (None, "u", None), (2, "", "é" * 200_000), (2, "", "é" * 200_000), (3, None, None)], PAGES)
    for size in (997, W.RANGE):
        assert whole(W.pages_of(W.read(W.write(pages), size))) == whole(pages)
    files = W.write(pages)
    assert whole(W.pages_of(W.read(files.union(files)))) == whole(pages)
    rolled = W.write(pages, roll=100)
    assert rolled.count() >= 5 and whole(W.pages_of(W.read(rolled))) == whole(pages)
    assert W.read(W.write(spark.createDataFrame([], PAGES))).count() == 0


def test_damaged_files(spark):
    good = W.record("resource", {}, b"one") + W.record("resource", {}, b"two")
    for data, n in ((b"", 0), (b"junk" + good, 0), (good[:-3], 1), (good + b"junk", 2), (good + W.record("resource", {}, b"three")[:20], 2)):
        assert W.read(file_of(spark, data), 50).count() == n


def test_sql(spark, duck):
    got, want = same(W.op8_warc(spark, "/root/testdata/sf0.001"), duck.sql(W.OP8_SQL))
    assert got == want


def test_very_long_urls(spark):
    """Headers beyond what is read at first are read to their end, and the records after them are there."""
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b/" + "x" * 300_000, "two" * 100), (3, "é" * 50_000, None), (4, "http://c", "four"), (5, "y" * 70_000, FAKE), (6, "u", "six")], PAGES).coalesce(1)
    for size in (50_000, W.RANGE):
        assert whole(W.pages_of(W.read(W.write(pages), size))) == whole(pages)


def test_urls_stay_as_they_are(spark):
    urls = ["http://a/%20b", "http://a/%FF", "http://a/%zz", " lead", "tail\t", "a\r\nContent-Length: 3", "x\x00y", "%", "", "日本 語"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], PAGES)
    assert whole(W.pages_of(W.read(W.write(pages), 300))) == whole(pages)


def test_foreign_headers(spark):
    """Escapes are not touched, and bytes that are no text do not stop a task."""
    head = b"WARC/1.1\r\nWARC-Type: re\xffs\r\nWARC-Target-URI: http://a/%20b/\xff\r\nWARC-Record-ID: <urn:page:99999999999999999999>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (_, at, kind, page, url, payload), (_, _, _, second, _, _) = sorted(tuple(r) for r in W.read(file_of(spark, head + W.record("resource", {"WARC-Record-ID": "<urn:page:5>"}, b"x"))).collect())
    assert (at, kind, page, url, bytes(payload), second) == (0, "re\ufffds", None, "http://a/%20b/\ufffd", b"hi", 5)


@pytest.mark.parametrize("size, each", [(300, 3), (900, 1), (1 << 20, 1), (1 << 20, 1000)])
def test_gzip_members(spark, size, each):
    """A member for each record, for three, and one for all; payloads hold packed records themselves."""
    rng = random.Random(each)
    inner = gzip.compress(W.record("resource", {}, b"inner"), 0)
    parts = [rng.choice([b"", inner, rng.randbytes(400), inner + b"x" + inner, b"\x1f\x8b\x08", b"long " * (400 if size < 1000 else 60_000)]) for _ in range(40)]
    records = [W.record("resource", {"WARC-Record-ID": f"<urn:page:{i}>"}, p) for i, p in enumerate(parts)]
    data = b"".join(gzip.compress(b"".join(records[i : i + each]), rng.choice([0, 6])) for i in range(0, 40, each))
    files = file_of(spark, data)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in W.read(files, size).collect()) == list(enumerate(parts))
    assert W.stopped(files, size).count() == 0


def test_what_is_not_read_is_reported(spark):
    good = W.record("resource", {}, b"one") + W.record("resource", {}, b"two")
    for data, at in ((good, None), (good + b"junk", len(good)), (b"junk" + good, 0), (good + W.record("resource", {}, b"three")[:-3], len(good)), (good + b"WARC/1.0\r\nno end", len(good)), (gzip.compress(good) + gzip.compress(good)[:-4], len(gzip.compress(good)))):
        for size in (90,):
            assert [r["at"] for r in W.stopped(file_of(spark, data), size).collect()] == ([] if at is None else [at]), data


def test_a_task_for_each_range(spark):
    files = spark.createDataFrame([(f"f{i}", 10_000) for i in range(9)], "file string, bytes bigint")
    cut = W.ranges(files, 100)
    assert cut.count() == 900 and cut.rdd.getNumPartitions() == 900
