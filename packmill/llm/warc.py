"""Operator 8: WARC files, written from pages and read in parallel by boundary-chain verification.

A task reads one range of a file and takes every "WARC/1." at which a whole record header stands for
a candidate; the header's length gives the record's successor. In a file of gzip members, as archives
are commonly kept, a candidate is a member that unpacks to such a header, and its successor is the
member's end. Within its range a task follows the
candidates' successors to where they leave the range: rows (candidate, exit). A payload may hold text
that looks like a record, so candidates prove nothing by themselves. Pointer jumping from the start of
each file, over exits only, finds in a number of rounds that grows with the logarithm of the ranges
where the true chain enters each range; a second pass reads the records from there. Records that the
chain does not reach are thereby rejected.
"""

from __future__ import annotations

import datetime
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.llm.common import new_dir, small_batches, table, written
from packmill.llm.files import Attempt, filesystem, open_input

#: Bytes of a file that a task reads.
RANGE = 32 << 20
#: Bytes read at first for a header; a longer one is read on until its end.
HEADER = 1 << 16
_MAGIC = b"WARC/1.0\r\n"
#: Where a header begins, whatever the minor version is.
_START = b"WARC/1."
_LINE = re.compile(rb"WARC/1\.\d+\r?\n")
_GZIP = b"\x1f\x8b\x08"
#: Bytes read of a packed file at a time.
_PIECE = 1 << 18
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_FIELD = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def record(kind: str, fields: dict, payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(payload)}.items())
    return _MAGIC + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


#: The field of a URL that cannot stand in a header line as it is, percent-escaped.
ESCAPED = "X-Escaped-Target-URI"
_AWKWARD = re.compile("[\x00-\x1f\x7f]|^[ \t]|[ \t]$")


def _url_fields(url: str | None) -> dict:
    if url is None:
        return {}
    if not _AWKWARD.search(url):
        return {"WARC-Target-URI": url}
    return {ESCAPED: "".join(c if c > " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)}


def _url_of(fields: dict) -> str | None:
    """The URL as the header has it; bytes that are not UTF-8 become replacement characters."""
    if b"warc-target-uri" in fields:
        return fields[b"warc-target-uri"].decode("utf-8", "replace")
    kept = fields.get(ESCAPED.lower().encode())
    return None if kept is None else re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), kept).decode("utf-8", "replace")


def write(pages: DataFrame, folder: str | None = None, roll: int = 1 << 30) -> DataFrame:
    """Writes pages (page_id, url, html) as uncompressed WARC files of about `roll` bytes: (file, bytes, records).

    A null id, URL or page is a header that is absent, or a record of type "metadata" without payload. A URL
    stands in the header as it is; one with control characters, or blanks at its ends, has a field of its own.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")

    def work(batches):
        out, n, done = None, 0, []
        for batch in batches:
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    out, n = Attempt(folder, ".warc"), 0
                    out.write(record("warcinfo", {"WARC-Date": datetime.datetime(2024, 1, 1).isoformat() + "Z"}, b"software: packmill\r\n"))
                fields = _url_fields(url) | ({} if i is None else {"WARC-Record-ID": f"<urn:page:{i}>"})
                out.write(record("metadata" if html is None else "resource", fields, (html or "").encode("utf-8", "replace")))
                n += 1
                if out.size >= roll:
                    out.close()
                    done.append((out.uri, out.size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((out.uri, out.size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["file", "bytes", "records"])

    return written(small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(work, "file string, bytes bigint, records bigint"), "warc-files")


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, bytes, first): the ranges of files, spread over as many tasks."""
    cut = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("first"))
    return _spread(cut, cut.count())


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """One row to a task. The number is given, as small rows that stand for much work would else be put together."""
    return rows.repartitionByRange(max(1, min(n, 50_000)), "file", "first")


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """(start of the payload, its length) of the header at `at`, if a whole header is there."""
    stop = data.find(b"\r\n\r\n", at)
    found = _LENGTH.search(data, at, stop + 2) if stop >= 0 else None
    return (stop + 4, int(found[1])) if found else None


def _whole_header(source, data: bytes, base: int, at: int, total: int) -> bytes:
    """`data`, which stands at `base` of the file, with what follows up to the end of the header at `at`, or to the file's end."""
    parts, have, seen = [data], len(data), data.find(b"\r\n\r\n", at) >= 0
    tail = data[-3:]
    while not seen and base + have < total:
        source.seek(base + have)
        more = source.read(min(max(HEADER, have - at), total - base - have))
        if not more:
            break
        seen = b"\r\n\r\n" in tail + more
        parts.append(more)
        have, tail = have + len(more), (tail + more)[-3:]
    return b"".join(parts) if len(parts) > 1 else data


def _candidates(source, first: int, size: int, total: int):
    """(offsets, successors) of all candidates of a range, by offset. A successor beyond the file is -1."""
    if _packed(source):
        return _members(source, first, size, total)
    source.seek(first)
    data = source.read(min(size + HEADER + len(_MAGIC), total - first))
    starts, nexts, at = [], [], data.find(_START)
    stop, found = -1, None  # of the header at `at`; kept while they hold, so that text full of magics is scanned once
    while 0 <= at < size:
        if stop < at:
            data = _whole_header(source, data, first, at, total)
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            found = _LENGTH.search(data, at, stop + 2)
        elif found and found.start() < at:
            found = _LENGTH.search(data, at, stop + 2)
        if found and _LINE.match(data, at):
            after = first + stop + 4 + int(found[1]) + 4
            starts.append(first + at)
            nexts.append(after if after <= total else -1)
        at = data.find(_START, at + 1)
    return np.array(starts, np.int64), np.array(nexts, np.int64)


def _packed(source) -> bool:
    source.seek(0)
    return source.read(3) == _GZIP


def _unpack(source, at: int, total: int):
    """Yields the contents of the gzip member at `at`, piece by piece, and at last its end, or -1 if it is cut off or damaged."""
    packed = zlib.decompressobj(31)
    while at < total:
        source.seek(at)
        data = source.read(min(_PIECE, total - at))
        try:
            yield packed.decompress(data)
        except zlib.error:
            break
        at += len(data)
        if packed.eof:
            yield at - len(packed.unused_data)
            return
        if not data:
            break
    yield -1


def _members(source, first: int, size: int, total: int):
    """_candidates of a file of gzip members. A member is unpacked no further than shows that it is none of ours."""
    source.seek(first)
    data = source.read(min(size + len(_GZIP), total - first))
    starts, nexts, at = [], [], data.find(_GZIP)
    while 0 <= at < size:
        head, end = b"", None
        for piece in _unpack(source, first + at, total):
            if isinstance(piece, int):
                end = piece
            elif len(head) < len(_START):
                head += piece[: len(_START)]
                if not _START.startswith(head[: len(_START)]):
                    break
        if end is not None and head.startswith(_START):
            starts.append(first + at)
            nexts.append(end)
        at = data.find(_GZIP, at + 1)
    return np.array(starts, np.int64), np.array(nexts, np.int64)


class _Unpacked:
    """A member's contents as a file to read from its start on, for records one after the other."""

    def __init__(self, source, at: int, total: int):
        self.pieces, self.buf, self.base, self.end = _unpack(source, at, total), b"", 0, None

    def upto(self, n: int) -> None:
        parts, have = [self.buf], len(self.buf)
        while have < n and self.end is None:
            piece = next(self.pieces)
            if isinstance(piece, int):
                self.end = piece
            else:
                parts.append(piece)
                have += len(piece)
        self.buf = b"".join(parts)

    def records(self):
        """(header, payload) of each record."""
        while True:
            want = HEADER
            self.upto(want)
            if not self.buf or not _LINE.match(self.buf):
                return
            while b"\r\n\r\n" not in self.buf and self.end is None:
                want *= 2
                self.upto(want)
            head = _header(self.buf, 0)
            if head is None:
                return
            self.upto(head[0] + head[1] + 4)
            if len(self.buf) < head[0] + head[1]:
                return
            yield self.buf[: head[0]], self.buf[head[0] : sum(head)]
            self.buf = self.buf[sum(head) + 4 :]


def chain(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, bytes, first, enter): for each range that the chain from a file's start enters, the first record in it.

    A chain ends at the file's end, or before where no record stands at a successor; stopped() tells which.
    """
    return _chain(files, size)[0]


def stopped(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, bytes, at) of the files whose chain ends before they do, at the place where no whole record stands: what follows is not read."""
    enter, links = _chain(files.select("file", "bytes").distinct(), size)
    ends = enter.select("file", F.col("enter").alias("at")).join(links, ["file", "at"]).groupBy("file").agg(F.max("leave").alias("leave"), F.max("last").alias("last"))
    found = files.select("file", "bytes").distinct().filter("bytes > 0").join(ends, "file", "left")
    at = F.when(F.col("last").isNull(), 0).otherwise(F.greatest("leave", F.when(F.col("leave") == -1, F.col("last")).otherwise(-1)))
    return found.withColumn("at", at.cast("long")).filter("at < bytes").select("file", "bytes", "at")


def _chain(files: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """chain(), and the links (file, at, after, leave, last) of its candidates: last is the record from which leave is reached."""

    def link(batches):
        for batch in batches:
            for file, total, first in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "first"))):
                with open_input(file) as source:
                    start, after = _candidates(source, first, size, total)
                # follow successors inside the range: jumps double until all have left it
                place = np.searchsorted(start, after)
                inner = (place < len(start)) & (start[np.minimum(place, len(start) - 1)] == after) if len(start) else np.zeros(0, bool)
                to = np.where(inner, place, np.arange(len(start)))
                while len(to) and (to[to] != to).any():
                    to = to[to]
                leave, last = (after[to], start[to]) if len(to) else (after, start)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(start), pa.string()), pa.array(start), pa.array(after), pa.array(leave), pa.array(last)], ["file", "at", "after", "leave", "last"])

    cuts = ranges(files, size)
    links = written(cuts.mapInArrow(link, "file string, at bigint, after bigint, leave bigint, last bigint"), "links")
    # only a file's start and the exits of ranges can be where the chain enters a range
    zero = files.select("file", F.lit(0).cast("long").alias("at"))
    doors = zero.union(links.filter("leave >= 0").select("file", F.col("leave").alias("at"))).distinct()
    jump = written(doors.join(links, ["file", "at"]).select("file", "at", F.col("leave").alias("to")), "jump")
    reached = written(zero.join(jump.select("file", "at"), ["file", "at"], "left_semi"), "reached")
    most = files.agg(F.max("bytes")).first()[0] or 0
    for _ in range(int(-(-most // size)).bit_length()):
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = written(reached.union(more).distinct(), "reached")
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "jump")
    enter = reached.withColumn("first", (F.col("at") - F.col("at") % size)).groupBy("file", "first").agg(F.min("at").alias("enter"))
    return enter.join(files.select("file", "bytes"), "file").select("file", "bytes", "first", "enter"), links


def _row(file: str, at: int, head: bytes, payload: bytes) -> tuple:
    fields = {k.lower(): v for k, v in _FIELD.findall(head)}
    page = re.fullmatch(rb"<urn:page:(-?\d{1,19})>", fields.get(b"warc-record-id", b""))
    number = int(page[1]) if page and -(1 << 63) <= int(page[1]) < 1 << 63 else None
    return file, at, fields.get(b"warc-type", b"").decode("utf-8", "replace"), number, _url_of(fields), payload


def _plain_rows(source, file: str, total: int, at: int, stop: int):
    """The records of a range that the chain enters at `at`."""
    source.seek(at)
    data, base = source.read(stop - at), at
    while at < min(stop, total):
        if at - base + HEADER > len(data) and base + len(data) < total:
            source.seek(at)
            data, base = source.read(max(HEADER, stop - at)), at
        if _LINE.match(data, at - base):
            data = _whole_header(source, data, base, at - base, total)
        head = _header(data, at - base) if _LINE.match(data, at - base) else None
        if head is None or base + sum(head) + 4 > total:
            break
        if sum(head) > len(data):
            source.seek(base + head[0])
            payload = source.read(head[1])
        else:
            payload = data[head[0] : sum(head)]
        yield _row(file, at, data[at - base : head[0] - 2], payload)
        at = base + sum(head) + 4


def _packed_rows(source, file: str, total: int, at: int, stop: int):
    while 0 <= at < min(stop, total):
        member = _Unpacked(source, at, total)
        for head, payload in member.records():
            yield _row(file, at, head[:-2], payload)
        while member.end is None:
            member.buf = b""
            member.upto(1)
        at = member.end


def read(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, offset, kind, page_id, url, payload) of every record that the chains of `files` (file, bytes) reach.

    Files are plain or of gzip members, of version 1.0 or 1.1; the records of a member have its offset. Cases:
    an empty file has no records; a file that does not begin with a record has none that are reached; a record
    cut off at the end of a file, or a header without an end or a length, ends the chain, and stopped()
    reports it; headers may be of any length; a URL is what the header says, escapes included; bytes that are
    no UTF-8 become replacement characters; the same file given twice gives its records once.
    """
    files = files.select("file", "bytes").distinct()

    def records(batches):
        for batch in batches:
            for file, total, first, at in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "first", "enter"))):
                rows, held = [], 0
                with open_input(file) as source:
                    for row in (_packed_rows if _packed(source) else _plain_rows)(source, file, total, at, first + size):
                        rows.append(row)
                        held += len(row[-1])
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    entered = written(chain(files, size), "entered")
    return _spread(entered, entered.count()).mapInArrow(records, "file string, offset bigint, kind string, page_id bigint, url string, payload binary")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "kind", "page_id", "url", "payload"])


def pages_of(records: DataFrame) -> DataFrame:
    """The pages (page_id, url, html) that write() made records of."""
    html = F.when(F.col("kind") == "resource", F.decode("payload", "UTF-8"))
    return records.filter("kind in ('resource', 'metadata')").select("page_id", "url", html.alias("html"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages"))
    return pages_of(read(files)).select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


OP8_SQL = "SELECT page_id, url, length(html)::BIGINT AS n_chars, md5(html) AS html_md5 FROM pages"
