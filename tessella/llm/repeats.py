"""Suffix-array dedup: common-prefix interval trees over an enhanced suffix array.

A string of LENGTH bytes that stands twice is removed where it does not stand
first. No suffix array over the whole corpus is built; suffixes that can share
LENGTH bytes are brought together first:

1. The anchor of a window of LENGTH bytes is its leftmost least K-byte hash, a
   function of the window alone. Every document's anchors are asked for in
   packed blocks, and those that occur twice come back.
2. Consecutive windows with one shared anchor are a segment: its bytes go to the
   anchor's bucket. Equal segments (compared byte by byte) are collapsed
   in their task to the first, and again in the bucket; all others are removed whole.
3. In a bucket the segments that are left are cut down to runs of windows that
   occur twice in it, by their hashes: segments that merely share the anchor go no
   further, whatever their number, and those that differ only around a common passage
   become equal. Segments linked by common windows form sets, and
   in each set the suffixes of the segments are sorted, the common
   prefixes of neighbours taken, and the array scanned with a stack: each
   interval of suffixes with a common prefix of at least LENGTH is a node. A
   node whose suffixes have different bytes on their left (or of which one
   begins its run) is a maximal repeat of the bucket, and every occurrence
   is known, not only neighbours. ``repeat_groups`` returns these groups; for
   removal, each suffix gets the longest prefix it shares with an earlier one,
   which is where it stops being first on its way up the tree.

A segment ends where the next anchor's begins, so a repeat longer than a segment
is found as a chain of overlapping groups; their union is exact.

Cases: null text is empty; matches never cross documents; a null doc_id ranks
last; of rows with equal doc_id and text none removes from the other; rows with
equal doc_id and other text are compared by position; texts shorter than LENGTH
lose nothing; an empty table gives an empty result; texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm.blocks import BYTE, INVERSE, PIECE, mix, powers
from tessella.llm.common import settle, shuffle_partitions

LENGTH, K = 100, 40
LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 22) - 1)
#: A task's segments are collapsed in blocks of so many.
BLOCK_SEGMENTS = 1 << 17
#: Buckets are scanned together up to so many bytes.
SCAN_BYTES = 2 << 20
_SEGMENT = "bucket long, did long, version long, start long, size int, bytes binary"
_GONE = "did long, version long, start long, size int"
_GROUP = "bucket long, node long, length int, doc_id long, start long"
_names = ["bucket", "did", "version", "start", "size", "bytes"]


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, first window, last window, document, hash of the bytes) of the segments; positions are in data."""
    for lo in range(0, max(1, len(data)), PIECE):
        hi = min(len(data), lo + PIECE + LENGTH - 1)
        d, n = data[lo:hi], hi - lo - LENGTH + 1
        if n <= 0:
            return
        g = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(BYTE[d] * powers(len(d)), out=g[1:])
        h = mix((g[K:] - g[:-K]) * powers(len(d) - K + 1, INVERSE))
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, w = 1, LENGTH - K + 1
        while 2 * span <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[:n], m[w - span : w - span + n])
        inside = np.zeros(n + 1, np.int32)
        a, b = np.clip(offsets[:-1] - lo, 0, n), np.clip(offsets[1:] - LENGTH + 1 - lo, 0, n)
        np.add.at(inside, a[a < b], 1)
        np.add.at(inside, b[a < b], -1)
        p = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(p):
            continue
        at = (m[p] & _PLACE).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        p1, p2, at = p[first], p[np.append(first[1:], len(p)) - 1], at[first]
        own = mix((g[p2 + LENGTH] - g[p1]) * powers(len(d), INVERSE)[p1] + (p2 - p1).astype(np.uint64))
        yield h[at] & blocks.KEY_BITS, p1 + lo, p2 + lo, np.searchsorted(offsets, p1 + lo, "right") - 1, own


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = blocks.buffers(b.column("text"))
    for lo, hi in blocks.pieces(offsets):
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _ask(targets: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            ids = b.column("did").to_numpy()
            for lo, data, offsets in _texts(b):
                for key, _, _, doc, _ in segments(data, offsets):
                    yield key, ids[lo + doc]

    return lambda batches: blocks.ask(found(batches), targets, False)


def _segments(collapse: bool):
    """Rows of the segments with a shared anchor. A row without bytes is removed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            key, own, did, version, start, size = (np.concatenate([x[i] for x in held]) for i in range(6))
            text = [t for x in held for t in x[6]]
            held.clear()
            order = np.lexsort((start, did, own, key))
            new = np.ones(len(order), bool)
            if collapse:
                k, o = key[order], own[order]
                new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                # Equal hashes only suggest it: what differs in a byte goes to the bucket itself.
                heads = order[new][np.cumsum(new) - 1]
                new |= np.fromiter((i != h and text[i] != text[h] for i, h in zip(order.tolist(), heads.tolist(), strict=True)), bool, len(order))
            first, rest = order[new], order[~new]
            # What is removed whole mostly stands together: one row for each run of it.
            rest = rest[np.lexsort((start[rest], version[rest], did[rest]))]
            d, v, lo = did[rest], version[rest], start[rest]
            hi = lo + size[rest]
            begin = np.ones(len(rest), bool)
            begin[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (lo[1:] > hi[:-1])
            at = np.flatnonzero(begin)
            end = np.append(at[1:], len(rest))[: len(at)] - 1
            # A row that needs no bucket is dealt by chance.
            bucket = np.concatenate([key[first], mix(lo[at].astype(np.uint64) + d[at].astype(np.uint64))])
            columns = [np.concatenate([did[first], d[at]]), np.concatenate([version[first], v[at]]), np.concatenate([start[first], lo[at]])]
            length = np.concatenate([size[first], hi[end] - lo[at]])
            return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), *[pa.array(x) for x in columns], pa.array(length.astype(np.int32)), pa.array([text[i] for i in first.tolist()] + [None] * len(at), pa.binary())], names=_names)

        for b in batches:
            ids, versions, shared = b.column("did").to_numpy(), b.column("version").to_numpy(), b.column("shared").to_pylist()
            for lo, data, offsets in _texts(b):
                raw = memoryview(data)
                for key, p1, p2, doc, own in segments(data, offsets):
                    mine = np.zeros(len(key), bool)
                    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    for x, y in zip(begin, np.append(begin[1:], len(doc)), strict=True):
                        mine[x:y] = blocks.contains(np.sort(np.frombuffer(shared[lo + doc[x]], np.uint64)), key[x:y])
                    if mine.any():
                        row, p1, size = lo + doc[mine], p1[mine], (p2 - p1)[mine] + LENGTH
                        held.append((key[mine], own[mine], ids[row], versions[row], p1 - offsets[doc[mine]], size, [bytes(raw[s : s + n]) for s, n in zip(p1.tolist(), size.tolist(), strict=True)]))
                if sum(len(x[0]) for x in held) >= BLOCK_SEGMENTS:
                    yield close()
        if held:
            yield close()

    return run


class Suffixes:
    """The enhanced suffix array of some buckets' segments, for suffixes of at least LENGTH bytes."""

    def __init__(self, bucket: np.ndarray, texts: list[bytes], rank: np.ndarray):
        """bucket: non-decreasing bucket number of each segment; rank: places of the segments by document, then position."""
        size = np.array([len(t) for t in texts])
        width = int(size.max())
        flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts) + bytes(width), np.uint8)
        n = size - LENGTH + 1
        self.segment = np.repeat(np.arange(len(texts)), n)
        self.offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.length = size[self.segment] - self.offset
        rows = np.lib.stride_tricks.sliding_window_view(flat, width)[self.segment * width + self.offset]
        past = np.arange(width)[None, :] >= self.length[:, None]
        rows = np.where(past, 0, rows).astype(np.uint8)
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        order = order[np.argsort(bucket[self.segment][order], kind="stable")]
        rows = rows[order]
        self.order = order
        self.segment, self.offset, self.length = self.segment[order], self.offset[order], self.length[order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        common = np.minimum(common, np.minimum(self.length[1:], self.length[:-1]))
        own = bucket[self.segment]
        #: Common prefix with the one before.
        self.common = np.concatenate([[0], np.where(own[1:] == own[:-1], common, 0)])
        #: The byte on the left; -1 where the segment begins.
        self.left = np.where(self.offset > 0, flat[np.maximum(self.segment * width + self.offset - 1, 0)].astype(np.int64), -1)
        self.rank = rank[self.segment] * (width + 1) + self.offset

    def nodes(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """(from, to, common prefix, those that stop being first here) of each node that is a maximal repeat."""
        deep = self.common >= LENGTH
        begin = np.flatnonzero(deep[1:] & ~deep[:-1]) if len(deep) > 1 else np.zeros(0, np.int64)
        stop = np.flatnonzero(np.append(deep, False)[1:] < deep) + 1
        pair = stop - begin == 2
        for i in begin[pair].tolist():  # most nodes have two leaves
            a, b = self.left[i], self.left[i + 1]
            if a != b or a < 0:
                yield i, i + 2, int(self.common[i + 1]), [i if self.rank[i] > self.rank[i + 1] else i + 1]
        for lo, hi in zip(begin[~pair].tolist(), stop[~pair].tolist(), strict=True):
            yield from self._scan(lo, hi)

    def _scan(self, lo: int, hi: int) -> Iterator[tuple[int, int, int, list[int]]]:
        common, left, rank = self.common[lo:hi].tolist(), self.left[lo:hi].tolist(), self.rank[lo:hi].tolist()
        # Open nodes: [common prefix, from, first suffix, byte on the left or -1 if they differ, those that lost].
        stack: list[list] = []
        n = hi - lo
        for i in range(n):
            child = [None, i, i, left[i], []]  # a leaf
            after = common[i + 1] if i + 1 < n else 0
            while True:
                if stack and stack[-1][0] > after:
                    node = stack.pop()
                    self._join(node, child, rank)
                    if node[3] < 0:
                        yield lo + node[1], lo + i + 1, node[0], [lo + x for x in node[4]]
                    child = [None, node[1], node[2], node[3], []]
                    continue
                if stack and stack[-1][0] == after:
                    self._join(stack[-1], child, rank)
                elif after >= LENGTH:
                    stack.append([after, child[1], child[2], child[3], []])
                break

    @staticmethod
    def _join(node: list, child: list, rank: list[int]) -> None:
        if rank[child[2]] < rank[node[2]]:
            node[4].append(node[2])
            node[2] = child[2]
        else:
            node[4].append(child[2])
        if node[3] != child[3]:
            node[3] = -1


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Whole buckets, several at a time."""
    rows: list[tuple] = []
    held = 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held >= SCAN_BYTES and r[0] != rows[-1][0]:
                yield rows
                rows, held = [], 0
            rows.append(r)
            held += len(r[5] or b"")
    if rows:
        yield rows


def _collapsed(rows: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
    """Lists of rows with equal bytes in one bucket, first occurrence first; and rows without bytes."""
    plain = [r for r in rows if r[5] is None]
    rows = sorted((r for r in rows if r[5] is not None), key=lambda r: (r[0], r[5], r[1], r[3]))
    out: list[list[tuple]] = []
    for r in rows:
        if out and out[-1][0][0] == r[0] and out[-1][0][5] == r[5]:
            out[-1].append(r)
        else:
            out.append([r])
    return out, plain


def _numbers(same: list[list[tuple]]) -> np.ndarray:
    """Bucket number of each list."""
    keys = np.array([s[0][0] for s in same], np.int64)
    return np.cumsum(np.append(0, keys[1:] != keys[:-1])) if len(same) else np.zeros(0, np.int64)


def _window_hashes(texts: list[bytes]) -> np.ndarray:
    """Hash of every window of every text, one after the other."""
    out, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SCAN_BYTES):
            size += len(texts[hi])
            hi += 1
        flat = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        n = np.array([len(t) for t in texts[lo:hi]])
        g = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(BYTE[flat] * powers(len(flat)), out=g[1:])
        w = n - LENGTH + 1
        at = np.repeat(np.cumsum(n) - n - (np.cumsum(w) - w), w) + np.arange(w.sum())
        out.append(mix((g[at + LENGTH] - g[at]) * powers(len(flat), INVERSE)[at]))
        lo = hi
    return np.concatenate(out)


def _shared_runs(same: list[list[tuple]]) -> Iterator[list[list[tuple]]]:
    """The runs of windows that occur twice in their bucket, as lists of equal rows by bucket and bytes; sets without a common window apart, several of them at a time.

    The hashes only choose; that windows are equal is seen when their bytes are sorted.
    """
    number = _numbers(same)
    several = np.flatnonzero(np.bincount(number, minlength=1)[number] > 1) if len(number) else np.zeros(0, np.int64)
    if not len(several):
        return
    texts = [same[i][0][5] for i in several]
    n = np.array([len(t) for t in texts]) - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    order, begin = blocks.groups(_window_hashes(texts) ^ mix(number[several].astype(np.uint64))[owner])
    times = np.diff(np.append(begin, len(order)))
    shared = np.zeros(len(order), bool)
    shared[order] = np.repeat(times > 1, times)
    if not shared.any():
        return
    # Sets: the least segment that can be reached by common windows.
    label = np.arange(len(texts))
    while True:
        least = np.minimum.reduceat(label[owner[order]], begin)
        new = label.copy()
        np.minimum.at(new, owner[order], np.repeat(least, times))
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(shared)
    first = np.flatnonzero(np.append(True, (owner[at][1:] != owner[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)))
    last = np.append(first[1:], len(at)) - 1
    runs: dict[tuple, list[tuple]] = {}
    for i, a, z in zip(owner[at[first]].tolist(), place[at[first]].tolist(), (place[at[last]] + LENGTH).tolist(), strict=True):
        part = texts[i][a:z]
        runs.setdefault((int(label[i]), part), []).extend((r[0], r[1], r[2], r[3] + a, z - a, part) for r in same[several[i]])
    out, held, now = [], 0, None
    for (group, part), rows in sorted(runs.items(), key=lambda x: x[0]):
        if held >= SCAN_BYTES and group != now:
            yield out
            out, held = [], 0
        now = group
        held += len(part)
        # Sets, not buckets, are kept apart from here on.
        out.append(sorted(((group, *r[1:]) for r in rows), key=lambda r: (r[1], r[3])))
    if out:
        yield out


def _suffixes(same: list[list[tuple]]) -> tuple[Suffixes | None, list[list[tuple]]]:
    """Of the sets with several different runs."""
    number = _numbers(same)
    several = np.flatnonzero(np.bincount(number, minlength=1)[number] > 1) if len(number) else []
    if not len(several):
        return None, []
    rest = [same[i] for i in several]
    place = sorted(range(len(rest)), key=lambda i: (rest[i][0][1], rest[i][0][3]))
    rank = np.empty(len(rest), np.int64)
    rank[place] = np.arange(len(rest))
    return Suffixes(number[several], [s[0][5] for s in rest], rank), rest


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _buckets(batches):
        same, out = _collapsed(rows)
        out = [r[1:5] for r in out]
        for s in same:
            first = s[0]
            out += [r[1:5] for r in s[1:] if (r[1], r[3]) != (first[1], first[3])]
        for runs in _shared_runs([s[:1] for s in same]):
            for s in runs:
                out += [r[1:5] for r in s[1:] if (r[1], r[3]) != (s[0][1], s[0][3])]
            array, rest = _suffixes(runs)
            if array:
                segment, offset = array.segment.tolist(), array.offset.tolist()
                for _, _, common, lost in array.nodes():
                    for i in lost:
                        r = rest[segment[i]][0]
                        out.append((r[1], r[2], r[3] + offset[i], common))
        did, version, start, size = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(version, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], names=["did", "version", "start", "size"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _buckets(batches):
        same, _ = _collapsed(rows)
        out, node = [], 0
        for s in same:
            if len(s) > 1:  # equal segments: a repeat whatever stands around them
                node += 1
                out += [(s[0][0], node, len(s[0][5]), r[1], r[3]) for r in s]
        for runs in _shared_runs(same):
            for s in runs:
                if len({r[1:4] for r in s}) > 1:  # runs of several segments, equal once cut down
                    node += 1
                    out += [(rows[0][0], node, len(s[0][5]), r[1], r[3]) for r in s]
            array, rest = _suffixes(runs)
            if array:
                for lo, hi, common, _ in array.nodes():
                    node += 1
                    for i in range(lo, hi):
                        out += [(rows[0][0], node, common, r[1], r[3] + int(array.offset[i])) for r in rest[array.segment[i]]]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "node", "length", "doc_id", "start"])


def _in_buckets(keyed: DataFrame, collapse: bool) -> DataFrame:
    """Segments with a shared anchor, dealt by bucket and sorted. keyed: did, version, text and any others."""
    n = shuffle_partitions(keyed.sparkSession)
    asked = keyed.select("did", "text").mapInArrow(_ask(2 * n), blocks.QUESTION)
    shared = settle(asked, blocks.answer(False, 2 * n), "shared")
    return keyed.join(shared, "did").mapInArrow(_segments(collapse), _SEGMENT).repartition(n, "bucket").sortWithinPartitions("bucket")


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("version"))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """bucket, node (together the group), length, doc_id, start (bytes): every occurrence of every maximal repeat of a bucket.

    Null doc_ids appear as 2^63 - 1.
    """
    return _in_buckets(_keyed(docs, ["doc_id", "text"]), collapse=False).mapInArrow(_groups, _GROUP)


def _with_ranges(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with did, version and gone, the ranges to remove. Both joins read the same columns, so that Spark deals the texts by id only once."""
    keyed = _keyed(docs, columns)
    gone = _in_buckets(keyed, collapse=True).mapInArrow(_removals, _GONE).groupBy("did").agg(F.collect_list(F.struct("version", "start", "size")).alias("gone"))
    return keyed.join(gone, "did", "left")


def _kept(text: bytes, version: int, gone: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of removed runs."""
    own = [(g["start"], g["size"]) for g in gone or () if g["version"] == version]
    if not own:
        return text, 0
    mark = np.zeros(len(text) + 1, np.int64)
    start, size = np.array(own).T
    np.add.at(mark, start, 1)
    np.add.at(mark, start + size, -1)
    cut = np.cumsum(mark)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~cut].tobytes(), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, removed, spans, digest = [], [], [], []
        for t, v, g in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("version").to_pylist(), b.column("gone").to_pylist(), strict=True):
            t = t or b""
            kept, n = _kept(t, v, g)
            size.append(len(t))
            removed.append(len(t) - len(kept))
            spans.append(n)
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = _with_ranges(docs, ["doc_id", "text"])
    return out.select("doc_id", "text", "version", "gone").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
