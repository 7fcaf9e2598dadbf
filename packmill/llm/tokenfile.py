"""Operator 9: token ids in files of independent zstandard frames.

Each document is a frame of its own (little-endian ids of 2 bytes, or 4 if the vocabulary needs them).
After the frames comes a seek table in the published seekable format: a skippable frame with the
compressed size, the decompressed size and a checksum (the low 32 bits of xxh64) of every frame, and a
footer. A reader takes the footer and the table from the end of the file, then reads and decompresses
only the frames asked for, and checks them. Any zstandard decoder reads such a file from end to end.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.llm.common import new_dir, small_batches, spread, table, written
from packmill.llm.files import Attempt, open_input
from packmill.llm.tokens import VOCABULARY, encoding

LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER = "<III", "<IBI"
_ENTRY_SIZE, _FOOTER_SIZE = 12, 9
#: A file is closed when it is at least this large.
ROLL = 512 << 20


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends frames; close() writes the seek table."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.entries = out, []
        self._zstd = zstandard.ZstdCompressor(level=level)

    def add(self, data: bytes) -> int:
        """The check sum of the frame."""
        frame, check = self._zstd.compress(data), checksum(data)
        self.out.write(frame)
        self.entries.append((len(frame), len(data), check))
        return check

    def close(self) -> None:
        body = b"".join(struct.pack(_ENTRY, *e) for e in self.entries) + struct.pack(_FOOTER, len(self.entries), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open file. Raises ValueError if there is no sound table."""
    end = source.seek(0, 2) or source.tell()
    if end < _FOOTER_SIZE + 8:
        raise ValueError("too short for a seek table")
    source.seek(end - _FOOTER_SIZE)
    n, flags, magic = struct.unpack(_FOOTER, source.read(_FOOTER_SIZE))
    length = n * _ENTRY_SIZE + _FOOTER_SIZE
    if magic != _SEEKABLE or flags != 0x80 or end < length + 8:
        raise ValueError("no seek table with checksums at the end")
    source.seek(end - length - 8)
    if struct.unpack("<II", source.read(8)) != (_SKIPPABLE, length):
        raise ValueError("the seek table's frame is damaged")
    sizes = list(struct.iter_unpack(_ENTRY, source.read(n * _ENTRY_SIZE)))
    out, at = [], 0
    for packed, size, check in sizes:
        out.append((at, packed, size, check))
        at += packed
    if at != end - length - 8:
        raise ValueError("the frames do not end where the seek table begins")
    return out


def read_frames(source, frames: list[int], table_: list | None = None) -> list[bytes]:
    """The contents of the frames asked for; nothing else is read or decompressed. Raises ValueError for a damaged one."""
    import zstandard

    table_, zstd, out = table_ or seek_table(source), zstandard.ZstdDecompressor(), []
    for k in frames:
        at, packed, size, check = table_[k]
        source.seek(at)
        try:
            data = zstd.decompress(source.read(packed), max_output_size=size or 1) if size else b""
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged") from e
        if len(data) != size or checksum(data) != check:
            raise ValueError(f"frame {k} has another checksum")
        out.append(data)
    return out


def id_bytes(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, roll: int = ROLL) -> DataFrame:
    """Writes the token ids of docs (doc_id, text) and gives the index (doc_id, file, frame, n_tokens, id_size, checksum).

    Cases: an empty text has a frame of no ids; a null text has no frame: its file, frame and checksum are
    null and its n_tokens 0; a null doc_id is written as any; repeated rows get frames of their own; an
    empty table writes no file.
    """
    folder = folder or new_dir(docs.sparkSession, "tokens")

    def work(batches):
        bpe, out, writer = encoding(vocabulary), None, None
        width = id_bytes(bpe.n_vocab)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    rows.append((None, None, 0, width, None))
                    continue
                if writer is None:
                    out = Attempt(folder, ".tok.zst")
                    writer = Writer(out)
                ids = np.array(bpe.encode_ordinary(text), f"<u{width}")
                rows.append((out.uri, len(writer.entries), len(ids), width, writer.add(ids.tobytes())))
                if out.size >= roll:
                    writer.close()
                    writer = None
            if rows:
                kinds = pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "file", "frame", "n_tokens", "id_size", "checksum"])
        if writer is not None:
            writer.close()

    return written(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(work, "doc_id bigint, file string, frame bigint, n_tokens bigint, id_size int, checksum bigint"), "token-index")


def read(index: DataFrame) -> DataFrame:
    """(doc_id, frame, tokens) of rows of the index: tasks go file by file, and only the rows' frames are decompressed."""

    def work(batches):
        held: dict = {}
        for batch in batches:
            rows: list = []
            for i, file, frame, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "frame", "id_size"))):
                if file not in held:
                    for source, _ in held.values():
                        source.close()
                    source = open_input(file)
                    held = {file: (source, seek_table(source))}
                rows.append((i, frame, np.frombuffer(read_frames(held[file][0], [frame], held[file][1])[0], f"<u{width}").astype(np.int32)))
            if rows:
                i, frame, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(frame, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "frame", "tokens"])

    files = index.filter("file is not null")
    n = files.agg(F.count_distinct("file")).first()[0]  # given, as few small rows that stand for much work would else be put together
    return files.repartition(max(1, n), "file").sortWithinPartitions("file", "frame").mapInArrow(work, "doc_id bigint, frame bigint, tokens array<int>")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without files and frames, which follow from how rows fell into tasks."""
    return write(spread(table(spark, sf_dir, "documents"))).select("doc_id", "n_tokens", "id_size", "checksum")
