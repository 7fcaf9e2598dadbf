import io

import numpy as np
import pytest

from helpers import docs_of, prose, with_clashes
from packmill.llm import tokenfile as K
from packmill.llm.files import open_input
from packmill.llm.tokens import encoding


class Memory(io.BytesIO):
    def close(self):
        self.data = self.getvalue()


def written(parts):
    out = Memory()
    w = K.Writer(out)
    for p in parts:
        w.add(p)
    w.close()
    return out.data


PARTS = [b"", b"a", b"bb" * 5000, bytes(range(256)) * 3, b""]


def test_round_trip_and_plain_decoding():
    import zstandard

    data = written(PARTS)
    assert K.read_frames(io.BytesIO(data), [4, 0, 3, 1, 2, 2]) == [PARTS[i] for i in (4, 0, 3, 1, 2, 2)]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
        assert r.read() == b"".join(PARTS)


def test_only_what_is_asked_for_is_read():
    class Spy(io.BytesIO):
        total = 0

        def read(self, n=-1):
            got = super().read(n)
            Spy.total += len(got)
            return got

    import os

    data = written([os.urandom(50_000) for _ in range(20)])
    K.read_frames(Spy(data), [7])
    assert Spy.total < 52_000


def test_damage_is_found():
    data = written(PARTS)
    frames = K.seek_table(io.BytesIO(data))
    at, packed, *_ = frames[2]
    with pytest.raises(ValueError):
        K.read_frames(io.BytesIO(data[: at + packed - 2] + bytes([data[at + packed - 2] ^ 255]) + data[at + packed - 1 :]), [2])
    for bad in (b"", data[:-1], data[:20], data + b"x"):
        with pytest.raises(ValueError):
            K.seek_table(io.BytesIO(bad))
    wrong = bytearray(data)
    wrong[-K._FOOTER_SIZE - 1] ^= 1  # the last frame's check sum
    with pytest.raises(ValueError):
        K.read_frames(io.BytesIO(bytes(wrong)), [4])
    assert K.seek_table(io.BytesIO(written([]))) == []


def test_ids_come_back(spark):
    bpe = encoding()
    rows = [(1, "Some text, here."), (1, "Some text, here."), (2, ""), (3, None), (None, "ñandú 日本 <|endoftext|>"), (4, prose(1, 50_000))]
    index = K.write(with_clashes(docs_of(spark, rows)), roll=1 << 12)
    got = sorted((r["doc_id"] or 0, list(r["tokens"])) for r in K.read(index).collect())
    assert got == sorted((i or 0, bpe.encode_ordinary(t)) for i, t in rows if t is not None)
    by = {r["doc_id"]: r for r in index.collect()}
    assert by[3]["file"] is None and by[3]["n_tokens"] == 0 and by[2]["n_tokens"] == 0 and by[2]["file"]
    one = index.filter("doc_id = 4").collect()[0]
    with open_input(one["file"]) as f:
        data = K.read_frames(f, [one["frame"]])[0]
    assert K.checksum(data) == one["checksum"] and np.frombuffer(data, "<u2").tolist() == bpe.encode_ordinary(rows[5][1])
    assert K.write(docs_of(spark, [])).count() == 0


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    bpe = encoding()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len(bpe.encode_ordinary(r["text"])), K.checksum(np.array(bpe.encode_ordinary(r["text"]), "<u2").tobytes())) for r in docs if r["text"] is not None)
    got = K.op9_tokens(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["checksum"]) for r in got if r["checksum"] is not None) == want
    assert len(got) == len(docs)
