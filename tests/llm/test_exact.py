"""Windows, segments and shingles made to share a hash: the bytes decide."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tessella.llm import blocks, neardup, phrases, repeats
from tests.llm import brute

#: Two runs of 13 words whose sums modulo 2^64 agree.
_SAME = "s1 s2 s3 s4 s5 s6 s7 s8 s9"
W, V = f"uatlayyl lgefyuux jzmmfieo zemmjnhx {_SAME}", f"zadcvgew kqjrihxs ycvpxvst ebvkpskr {_SAME}"


def test_windows_that_share_a_hash(spark):
    other = " ".join(f"o{i}" for i in range(13))
    some = [(1, W), (2, f"{W} {other} {V}"), (3, V)]
    cut = brute.op6(some)
    assert [sum(cut[i]) for i in range(3)] == [0, 13, 13]
    df = spark.createDataFrame(some, "doc_id long, text string")
    for n in (1, 2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {r["doc_id"]: r["n_removed"] for r in phrases.dedup_report(df).collect()} == {1: 0, 2: 13, 3: 13}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_removal_goes_by_digest():
    """Of a document's windows only those whose digest was told go, whatever their hashes."""
    text = f"{W} x {V}".encode()
    data = np.frombuffer(text, np.uint8)
    p = phrases.Piece(data, np.array([0, len(data)]))
    told = p.digests(data, np.array([0]))
    assert phrases._removed(p, data, told.tobytes()).tolist() == [True] * 13 + [False] * 14
    assert told.itemsize == 12 and len(set(p.digests(data, np.arange(len(p.windows))).tolist())) == len(p.windows)


def test_segments_that_share_a_hash(monkeypatch):
    """Segments of equal anchor and hash but other bytes are not collapsed; equal ones are."""
    texts = [b"a" * 160, b"b" * 160, b"a" * 160]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    monkeypatch.setattr(repeats, "segments", lambda data, offs: iter([(np.full(3, 9, np.uint64), offsets[:-1], offsets[:-1] + 60, np.arange(3), np.full(3, 5, np.uint64))]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([t.decode() for t in texts]), pa.array([np.full(1, 9, np.uint64).tobytes()] * 3)], names=["did", "version", "text", "shared"])
    (out,) = repeats._segments(True)(iter([batch]))
    rows = sorted(zip(out.column("did").to_pylist(), out.column("bytes").to_pylist(), strict=True))
    assert rows == [(1, texts[0]), (2, texts[1]), (3, None)]


def test_shingles_that_share_a_hash(spark, monkeypatch):
    text = "ruykjpzt mvfwiwlf zzz f1 f2 f3 dklmyyui lfuurcxi zzz"
    df = spark.createDataFrame([(1, text), (2, "a b c a b c a b"), (3, "a b"), (4, text + " f1 f2 f3")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_shingles"] for r in neardup.components(df, 3, 85).collect()} == {1: 7, 2: 3, 3: 1, 4: 8}
    own = [t.encode() for t in (text, "a b c a b c a b", "", "a b", text + " f1 f2 f3")]
    data, offsets = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0] + [len(t) for t in own])
    for few in (1, 2, 1 << 60):
        monkeypatch.setattr(neardup, "shingle_hash", lambda values, k, few=few: blocks.shingle_hash(values, k) % np.uint64(few))
        _, at = neardup.shingle_sets(data, offsets, 3)
        assert np.diff(at).tolist() == [7, 3, 0, 1, 8]


def test_partitions_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ways = {"op3": repeats.dedup_report, "op6": phrases.dedup_report}
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.collect()), key=str)).encode()).hexdigest()
    want = {k: digest(f(docs)) for k, f in ways.items()}
    for n in (1, 3):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {k: digest(f(docs)) for k, f in ways.items()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
