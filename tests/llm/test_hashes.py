"""Texts made to defeat polynomial hashes, and what follows from them for the operators that compare words."""

from __future__ import annotations

import hashlib

import numpy as np

from tessella.llm import blocks, neardup, phrases
from tests.llm import brute


def thue_morse(n: int, pair: str = "ab") -> str:
    """A word whose polynomial hash modulo 2^64 equals that of its complement, whatever the base, from 1,024 characters on."""
    return "".join(pair[i.bit_count() % 2] for i in range(n))


def test_words(spark):
    some = []
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n), thue_morse(n, "ba")
        tail = " ".join(f"w{i}" for i in range(12))
        texts = [a, b, f"{a} {tail}", f"{b} {tail}", f"x {b} {tail}", f"{a} {tail} y", f"{tail} {a}", f"{tail} {b}", f"{tail}  {b}\n"]
        some += [(10 * n + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.components(df, 3, 85).collect()} == brute.links(some, 3, 85)
    cut = brute.op6(some)
    want = {}
    for x, (i, t) in enumerate(some):
        kept = [w for w, c in zip(t.encode().split(), cut[x], strict=True) if not c]
        want[i] = (sum(cut[x]), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in phrases.dedup_report(df).collect()} == want


def test_word_hash():
    """Words of all lengths, alone and beside others, hash by their bytes alone; different words differ."""
    r = np.random.default_rng(1)
    own = [bytes(r.integers(97, 99, n, np.uint8)) for n in range(1, 70) for _ in range(30)] + [b"a" * n for n in range(1, 3000, 7)]
    own = list(dict.fromkeys(own))
    data = np.frombuffer(b" ".join(own), np.uint8)
    w = blocks.Words(data, np.array([0, len(data)]))
    assert len(w.hash) == len(own) == len(set(w.hash.tolist()))
    for i in range(0, len(own), 97):
        alone = blocks.Words(np.frombuffer(own[i], np.uint8), np.array([0, len(own[i])]))
        assert alone.hash[0] == w.hash[i]
    # Exchanged groups of eight bytes.
    x = np.frombuffer(b"abcdefgh12345678 12345678abcdefgh", np.uint8)
    assert len(set(blocks.Words(x, np.array([0, len(x)])).hash.tolist())) == 2
