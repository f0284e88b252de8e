"""URL filter: a sorted array of rule digests, memory-mapped and probed by binary search.

A rule is a host and a path prefix; it fits its host, all subdomains, and every
path that starts with its path. ``RuleArray.pack`` writes the sorted 64-bit
xxhash digests of all rules and, beside them, the full rule strings. The packed
bytes go to the executors as a broadcast of at most MAX_BYTES; each worker puts them in its own
temporary folder and maps them. A longer list is cut into several arrays, which the urls pass
one after the other with the longest rule found so far. A url's candidates are its host suffixes
no longer than a rule's host, with the prefixes of its path as long as some rule's path; their
digests are looked up with ``numpy.searchsorted``, CANDIDATES at a time, and every hit is confirmed
by comparing the full strings, so a digest collision cannot give a verdict.

Cases: null urls and urls without ``://`` have an empty host and path and get
the default verdict; repeated rows are judged alike; an empty table gives an
empty result; a url may be of any length. The id column may be null and of any
type; further columns of the input are not read.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of packed rules that a worker maps at once; and strings that are looked up at once.
MAX_BYTES, CANDIDATES = 64 << 20, 1 << 16


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host with A-Z lower-cased, and path."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    for end in (b"?", b"#"):
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


class RuleArray:
    """Digests, string offsets, verdicts and strings in one mapped file."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115  mapped as long as the object lives
        m = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        n, lengths, self.host = (int(x) for x in np.frombuffer(m, np.int64, 3))
        at = 24
        self.lengths = np.frombuffer(m, np.int64, lengths, at).tolist()
        at += 8 * lengths
        self.digests = np.frombuffer(m, np.uint64, n, at)
        at += 8 * n
        self.offsets = np.frombuffer(m, np.int64, n + 1, at)
        at += 8 * (n + 1)
        self.allows = np.frombuffer(m, np.uint8, n, at)
        self.strings = memoryview(m)[at + n :]

    @staticmethod
    def pack(rules: dict[bytes, tuple[bool, int]]) -> bytes:
        """rules: host and path together, to (whether it allows, length of its path)."""
        rows = sorted((xxhash.xxh64_intdigest(s), s, a) for s, (a, _) in rules.items())
        lengths = sorted({n for _, n in rules.values()})
        host = max((len(s) - n for s, (_, n) in rules.items()), default=0)
        offsets = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in rows], dtype=np.int64)]) if rows else np.zeros(1)
        parts = [np.array([len(rows), len(lengths), host], np.int64), np.array(lengths, np.int64), np.array([h for h, _, _ in rows], np.uint64), offsets.astype(np.int64), np.array([a for _, _, a in rows], np.uint8)]
        return b"".join(p.tobytes() for p in parts) + b"".join(s for _, s, _ in rows)

    def _suffixes(self, host: bytes) -> Iterator[bytes]:
        """The host and what follows each of its dots, as far as a rule can have it; shortest first."""
        at = len(host)
        while at > 0 and len(host) - at <= self.host:
            at = host.rfind(b".", 0, at)
            if len(host) - at - 1 <= self.host:
                yield host[at + 1 :]

    def probe(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[bytes | None, bool]]:
        """The longest fitting rule of each url and whether it allows."""
        best: list[tuple[bytes | None, bool]] = [(None, False)] * len(urls)
        owner: list[int] = []
        candidates: list[bytes] = []
        for i, (host, path) in enumerate(urls):
            heads = [path[:n] for n in self.lengths if n <= len(path)]
            for suffix in self._suffixes(host) if heads else ():
                candidates += [suffix + h for h in heads]
                owner += [i] * len(heads)
                if len(candidates) >= CANDIDATES:
                    self._confirm(owner, candidates, best)
                    owner, candidates = [], []
        self._confirm(owner, candidates, best)
        return best

    def _confirm(self, owner: list[int], candidates: list[bytes], best: list[tuple[bytes | None, bool]]) -> None:
        if not len(self.digests) or not candidates:
            return
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, keys)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys)
        for c in hit.tolist():
            k, s, i = int(at[c]), candidates[c], owner[c]
            while k < len(self.digests) and self.digests[k] == keys[c]:  # equal digests stand side by side
                if self.strings[self.offsets[k] : self.offsets[k + 1]] == s and len(s) > len(best[i][0] or b""):
                    best[i] = (s, bool(self.allows[k]))
                k += 1


def arrays(rules: list[tuple[str, str, str]]) -> list[bytes]:
    """Packed rules (verdict allow or block, host, path), in arrays of at most MAX_BYTES about; the last of equal rules counts."""
    own = {host.lower().encode() + path.encode(): (verdict == "allow", len(path.encode())) for verdict, host, path in rules}
    out: list[bytes] = []
    part: dict[bytes, tuple[bool, int]] = {}
    size = 0
    for rule, what in own.items():
        if part and size + len(rule) + 17 > MAX_BYTES:
            out.append(RuleArray.pack(part))
            part, size = {}, 0
        part[rule] = what
        size += len(rule) + 17
    return [*out, RuleArray.pack(part)]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row."""
    kind = pages.schema[id_col].dataType.simpleString()

    def step(packed):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with tempfile.NamedTemporaryFile(delete=False) as f:
                f.write(packed.value)
            array = RuleArray(f.name)
            os.unlink(f.name)  # the mapping stays valid
            for b in batches:
                urls = [split_url(u) for u in b.column(1).cast(pa.binary()).to_pylist()]
                before = zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)
                found = [max(x, y, key=lambda r: len(r[0] or b"")) for x, y in zip(before, array.probe(urls), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r for r, _ in found], pa.binary()), pa.array([a for _, a in found], pa.bool_())], names=[id_col, url_col, "rule", "allows"])

        return run

    df = pages.select(id_col, url_col, F.lit(None).cast("binary").alias("rule"), F.lit(False).alias("allows"))
    for packed in arrays(rules):
        df = df.mapInArrow(step(pages.sparkSession.sparkContext.broadcast(packed)), f"`{id_col}` {kind}, `{url_col}` string, rule binary, allows boolean")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [split_url(u) for u in b.column(1).cast(pa.binary()).to_pylist()]
            text = lambda xs: pa.array([None if x is None else x.decode("utf-8", "replace") for x in xs], pa.string())
            rules = b.column(2).to_pylist()
            verdict = [default if r is None else ("allow" if a else "block") for r, a in zip(rules, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), text([h for h, _ in urls]), text([p for _, p in urls]), text(rules), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return df.mapInArrow(named, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
