"""Substring dedup on words by recompression.

Each document's words are parsed in rounds. A round names runs of one symbol,
then pairs: the alphabet is halved by a bit of the symbols' names, and a left
symbol followed by a right one becomes a pair. A name is a 64-bit hash of what
it stands for, so equal strings get equal names in every task without asking.
What a symbol looks like depends on a few neighbours only: its context, a range
of words kept with it. Inside a repeated window every symbol whose context lies
in the window therefore repeats too. A window's anchor is the highest such
symbol (the smallest name of several), known by the name of its context's words.

1. Every document's anchors go to shared targets in packed blocks; those of two
   or more documents come back.
2. Documents that have any are parsed again. Windows with such an anchor are
   verified: cryptographic digests (BLAKE2b, 80 bits, and 16 of a plain hash) of the 13 words' own bytes
   meet their equals, and the digests of windows that also stand in a document with
   a smaller id come back.
3. The words of the windows with these digests are removed. No other hash decides.

A window in two documents has the same anchor in both, so step 1 loses none.

Cases: null text has no words; a null doc_id ranks after all others; rows of
equal doc_id never remove words from each other; documents with fewer words
than a window lose nothing; an empty table gives an empty result; texts of any
length are taken whole; further columns are not read (``dedup_documents`` keeps
them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm.blocks import Words, mix, window_hash
from tessella.llm.common import guarded, settle, shuffle_partitions

WINDOW = 13
ROUNDS = 2
LAST = (1 << 63) - 1
#: A window's digest: 80 bits of BLAKE2b, and as the upper half of ``second`` 16 bits of its hash, by which windows are chosen whose digest is worth taking.
DIGEST = np.dtype([("first", "<u8"), ("second", "<u4")])
_RUN = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)


def recompress(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, last: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """One round. lo, hi: context of each symbol; last: it ends a document. A context reaches one symbol further where a neighbour decided, and beyond the document where there is none."""
    n = len(names)
    # Runs.
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | last[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    end = begin + size - 1
    first = np.ones(len(begin), bool)
    first[1:] = last[end[:-1]]
    final = last[end]
    # The neighbours on both sides are known to differ.
    lo, hi = np.where(first, lo[begin] - 1, lo[np.maximum(begin - 1, 0)]), np.where(final, hi[end] + 1, hi[np.minimum(end + 1, n - 1)])
    names = np.where(size > 1, mix(names[begin] * _RUN + size.astype(np.uint64)), names[begin])
    # Pairs.
    n, last = len(names), final
    left = (mix(names + np.uint64(level)) & np.uint64(1)).astype(bool)
    paired = np.zeros(n, bool)
    paired[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    second = np.zeros(n, bool)
    second[1:] = paired[:-1]
    # Contexts of both neighbours are in by the runs; now whether they are left or right also counts.
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    hi = np.where(left & ~last, hi[after], hi)
    lo = np.where(~left & ~first, np.minimum(lo, lo[before]), lo)
    head = np.flatnonzero(~second)
    tail = np.where(paired[head], after[head], head)
    out = np.where(paired[head], mix(names[head] * _PAIR + names[tail]), names[head])
    return out, lo[head], hi[tail], last[tail]


def anchors(w: Words, windows: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """The key of each window's anchor. exact: hash of each window's words, the key where no symbol of a higher level fits."""
    n = len(w.hash)
    at = np.arange(n)
    last = np.zeros(n, bool)
    last[w.first[1:][w.first[1:] > w.first[:-1]] - 1] = True
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * blocks.powers(n), out=sums[1:])
    keys = exact.copy()
    names, lo, hi = w.hash, at, at + 1
    for level in range(ROUNDS):
        names, lo, hi, last = recompress(names, lo, hi, last, level)
        begin = np.searchsorted(lo, windows)
        count = np.searchsorted(hi, windows + WINDOW, "right") - begin
        best = np.full(len(windows), np.iinfo(np.uint64).max)
        where = np.full(len(windows), -1)
        for j in range(int(count.max(initial=0))):
            i = np.minimum(begin + j, len(names) - 1)
            better = (j < count) & ((names[i] < best) | (where < 0))
            best = np.where(better, names[i], best)
            where = np.where(better, i, where)
        ok = where >= 0
        a, b = lo[where[ok]], hi[where[ok]]
        keys[ok] = mix((sums[b] - sums[a]) * blocks.powers(n, blocks.INVERSE)[a] + (b - a).astype(np.uint64))
    return keys


class Piece:
    """A few documents with their words, windows and the windows' keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets)
        self.windows = self.words.windows(WINDOW)
        self.doc = np.searchsorted(self.words.first, self.windows, "right") - 1
        self.hash = window_hash(self.words.hash, WINDOW)[self.windows] if len(self.windows) else np.zeros(0, np.uint64)

    def keys(self) -> np.ndarray:
        return anchors(self.words, self.windows, self.hash) & blocks.KEY_BITS if len(self.windows) else self.hash

    def digests(self, data: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Cryptographic digests of the words of the chosen windows, joined by one space. data: the piece's bytes."""
        w = self.words
        size = w.end - w.start
        raw = b" ".join(x for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True) for x in data[a:b].tobytes().split())
        at = np.cumsum(size + 1) - (size + 1)
        one = self.windows[chosen]
        digest = hashlib.blake2b
        own = np.frombuffer(b"".join(digest(raw[a:b], digest_size=10).digest() for a, b in zip(at[one].tolist(), (at + size)[one + WINDOW - 1].tolist(), strict=True)), np.dtype([("first", "<u8"), ("second", "<u2")]))
        out = np.empty(len(own), DIGEST)
        out["first"], out["second"] = own["first"], own["second"] | self.tags()[chosen].astype(np.uint32) << np.uint32(16)
        return out

    def tags(self) -> np.ndarray:
        return (self.hash >> np.uint64(48)).astype(np.uint16)


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, Piece, np.ndarray]]:
    data, offsets = blocks.buffers(b.column("text"))
    for lo, hi in blocks.pieces(offsets):
        own = data[offsets[lo] : offsets[hi]]
        yield lo, hi, Piece(own, offsets[lo : hi + 1] - offsets[lo]), own


def _ask(targets: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            ids = b.column("did").to_numpy()
            for lo, _, p, _ in _pieces(b):
                keys, doc = p.keys(), p.doc
                # Equal keys of one document mostly stand together: the rest costs little.
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                yield keys[new], ids[lo + doc[new]]

    return lambda batches: blocks.ask(found(batches), targets, True)


# Which windows also stand in a document with a smaller id?

_CLAIM = "target int, first binary, second binary, owners binary"
_claim = pa.schema([("target", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("owners", pa.binary())])


def _later(first: np.ndarray, second: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window and owner; whether a row's window has an earlier owner; whether a row is the first of its window."""
    order = np.lexsort((owners, second, first))
    f, s, o = first[order], second[order], owners[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    begin = np.flatnonzero(new)
    least = np.repeat(o[begin], np.diff(np.append(begin, len(f)))) if len(f) else o
    return order, o > least, new


def _claims(targets: int):
    """Windows whose anchor is shared. In a block only the smallest owner of a window asks; the others are told at once (their digests stand in ``first`` whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> Iterator[pa.RecordBatch]:
            digest, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, later, new = _later(digest["first"], digest["second"], owners)
            digest, owners = digest[order], owners[order]
            rows = [(-1, digest[later], digest["second"][:0], owners[later])] if later.any() else []
            first, second, owners = digest["first"][new], digest["second"][new], owners[new]
            rows += [(t, first[at], second[at], owners[at]) for t, at in blocks.deal(first, targets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([blocks.planes(r[3]) for r in rows], pa.binary())], schema=_claim)

        for b in batches:
            ids = b.column("did").to_numpy()
            shared = b.column("shared").to_pylist()
            for lo, hi, p, data in _pieces(b):
                keys = p.keys()
                ends = np.searchsorted(p.doc, np.arange(hi - lo + 1))
                mine = np.zeros(len(keys), bool)
                for i in range(hi - lo):
                    mine[ends[i] : ends[i + 1]] = blocks.contains(np.sort(np.frombuffer(shared[lo + i], np.uint64)), keys[ends[i] : ends[i + 1]])
                if mine.any():
                    held.append((p.digests(data, mine), ids[lo + p.doc[mine]]))
                if sum(len(x[0]) for x in held) >= blocks.BLOCK_KEYS:
                    yield from close()
        if held:
            yield from close()

    return run


def _verdicts(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for t, f, s, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o = blocks.from_planes(o, np.int64)
                if t < 0:
                    yield blocks.reply(np.frombuffer(f, DIGEST), o, targets)
                else:
                    held.append((np.frombuffer(f, np.uint64), np.frombuffer(s, np.uint32), o))
        if held:
            first, second, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            order, later, _ = _later(first, second, owners)
            if later.any():
                told = np.empty(int(later.sum()), DIGEST)
                told["first"], told["second"] = first[order][later], second[order][later]
                yield blocks.reply(told, owners[order][later], targets)

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """did, gone: packed digests of the windows of each document that also stand in one with a smaller id. docs: did, text and any others."""
    targets = 2 * shuffle_partitions(docs.sparkSession)
    asked = docs.select("did", "text").mapInArrow(_ask(targets), blocks.QUESTION)
    shared = settle(asked, blocks.answer(True, targets), "shared")
    claims = docs.join(shared, "did").mapInArrow(_claims(targets), _CLAIM)
    return settle(claims, _verdicts(targets), "gone", DIGEST)


def _removed(p: Piece, data: np.ndarray, gone: bytes) -> np.ndarray:
    """Which words of the piece's one document go."""
    out = np.zeros(len(p.words.start) + 1, np.int64)
    own = np.frombuffer(gone, DIGEST)
    told, tagged = set(own.tolist()), np.zeros(1 << 16, bool)
    tagged[own["second"] >> np.uint32(16)] = True
    some = np.flatnonzero(tagged[p.tags()])
    hit = p.windows[some[np.fromiter((d in told for d in p.digests(data, some).tolist()), bool, len(some))]]
    np.add.at(out, hit, 1)
    np.add.at(out, hit + WINDOW, -1)
    return np.cumsum(out)[:-1] > 0


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; gone null means that nothing goes."""
    for b in batches:
        ids, gone = b.column("doc_id"), b.column("gone").to_pylist()
        texts = b.column("text").cast(pa.binary()).to_pylist()
        words, removed, digest = [], [], []
        for t, g in zip(texts, gone, strict=True):
            own = (t or b"").split()
            if g and own:  # rows of one id may hold different texts
                data = np.frombuffer(t, np.uint8)
                cut = _removed(Piece(data, np.array([0, len(data)])), data, g)
                kept = [w for w, c in zip(own, cut.tolist(), strict=True) if not c]
            else:
                kept = own
            words.append(len(own))
            removed.append(len(own) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the removed words; the rest stays as it is, the white space before a removed word goes with it."""
    for b in batches:
        at = b.schema.get_field_index("text")
        texts = b.column(at).cast(pa.binary()).to_pylist()
        for i, g in enumerate(b.column("gone").to_pylist()):
            if g and texts[i]:
                data = np.frombuffer(texts[i], np.uint8)
                p = Piece(data, np.array([0, len(data)]))
                cut = _removed(p, data, g)
                mark = np.zeros(len(data) + 1, np.int64)
                begin = np.concatenate([[0], p.words.end[:-1]])
                np.add.at(mark, begin[cut], 1)
                np.add.at(mark, p.words.end[cut], -1)
                texts[i] = data[np.cumsum(mark)[:-1] == 0].tobytes().lstrip(b" \t\r\n\v\f")
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(b.columns)]
        keep = [k for k, n in enumerate(b.schema.names) if n not in ("gone", "did")]
        yield pa.RecordBatch.from_arrays([columns[k] for k in keep], names=[b.schema.names[k] for k in keep])


def _with_windows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with did (null ids last) and gone. Both joins read the same columns, so that Spark deals the texts by id only once."""
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"))
    return keyed.join(repeated_windows(keyed), "did", "left")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _with_windows(docs, ["doc_id", "text"]).select("doc_id", "text", "gone").mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents without the words that repeat; all rows and columns stay."""

    def stage(docs: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return _with_windows(docs, docs.columns).mapInArrow(_rewrite, schema)

    return guarded(docs, ["doc_id", "text"], stage)
