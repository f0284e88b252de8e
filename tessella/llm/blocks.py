"""Numpy helpers on whole Arrow batches of texts, and the exchange of keys in packed blocks.

Texts stay bytes in one buffer; words, windows and hashes are arrays over it.
Where keys of all documents must meet (which occur more than once?), a task
packs its keys into one block per target instead of one row per key, and
already answers what it can see itself, so that a target never gets more than
one entry per key from a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes, which bounds the arrays.
PIECE = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: An odd base of polynomial hashes modulo 2^64, and its inverse.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A value for each byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
#: The first n of eight bytes.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: int = BASE) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, 2 * PIECE), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most about ``most`` bytes together; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=g[1:])
    return mix((g[k:] - g[:n]) * powers(n, INVERSE))


def shingle_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values. Each is mixed with a key of its place before they are added, so that no two shingles collide by the sum's form."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = mix(np.arange(1, k + 1, dtype=np.uint64) * _GOLD)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += mix(values[j : n + j] ^ key[j]) * (mix(key[j : j + 1]) | np.uint64(1))
    return mix(h)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word. Eight bytes at a time are mixed with a key of their place before they are added, so that no two texts collide by the sum's form (as they do in a polynomial modulo 2^64)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), np.uint64, padded, 0, (1,))
    n = (end - start + 7) >> 3
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n)
    at = np.repeat(start, n) + 8 * place
    value = eight[at] & _HEAD[np.minimum(np.repeat(end, n) - at, 8)]
    key = mix(np.arange(1, int(n.max()) + 1, dtype=np.uint64) * _GOLD)
    h = np.add.reduceat(mix(value ^ key[place]) * (mix(key) | np.uint64(1))[place], begin)
    return mix(h + (end - start).astype(np.uint64) * _GOLD)


class Words:
    """The words of some texts: start, end (bytes), hash, and first (word number at which each text begins). offsets: of the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts = []
        lo, n = 0, len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        while lo < n:
            hi = min(n, lo + PIECE)
            while hi < n and not (IS_SPACE[data[hi]] or edge[hi]):  # not inside a word
                hi += 1
            parts.append(self._words(data[lo:hi], edge[lo : hi + 1], lo))
            lo = hi
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.offsets, self.first = offsets, np.searchsorted(self.start, offsets)

    @staticmethod
    def _words(data: np.ndarray, edge: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = IS_SPACE[data]
        starts, ends = ~space, ~space
        starts[1:] &= space[:-1] | edge[1:-1]
        ends[:-1] &= space[1:] | edge[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s + at, e + at, word_hash(data, s, e)

    def numbers(self, data: np.ndarray) -> np.ndarray:
        """A number for each word, equal for equal bytes and no others. data: as given to the constructor."""
        size = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start - offsets[:-1], size) + np.arange(int(offsets[-1]))
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])
        return words.dictionary_encode().indices.to_numpy()

    def windows(self, k: int) -> np.ndarray:
        """Numbers of the words at which k consecutive words of one text begin."""
        n = np.maximum(np.diff(self.first) - (k - 1), 0)
        return np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values stand together (first come first), and where each group begins in it."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression finds the zeros of small numbers."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def deal(keys: np.ndarray, targets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Target number and the places of its keys, in their order."""
    to = ((keys * _GOLD >> np.uint64(40)) % np.uint64(targets)).astype(np.int64)
    order, begin = groups(to)
    for lo, hi in zip(begin, [*begin[1:], len(to)], strict=True):
        yield int(to[order[lo]]), order[lo:hi]


def contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


# Which keys occur more than once?

QUESTION = "target int, keys binary, owners binary, known binary"
ANSWER = "target int, keys binary, owners binary"
#: A block is closed at so many keys.
BLOCK_KEYS = 1 << 20
#: The bits of a key that is only asked for; two keys that agree in them cost a needless look.
KEY_BITS = np.uint64((1 << 48) - 1)
_question = pa.schema([("target", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("known", pa.binary())])
_answer = pa.schema([("target", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])


def ask(found: Iterator[tuple[np.ndarray, np.ndarray]], targets: int, distinct_owners: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of keys (key, owning document) for ``answer``.

    known: 1 where the block itself holds the key more than once (in different
    documents if distinct_owners); all its owners then stand in rows of target
    -1, which need no answer, and the key goes on once.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def close() -> Iterator[pa.RecordBatch]:
        keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, begin = groups(keys)
        keys, owners = keys[order], owners[order]
        if distinct_owners:
            twice = np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin)
        else:
            twice = np.diff(np.append(begin, len(keys))) > 1
        every = np.repeat(twice, np.diff(np.append(begin, len(keys))))
        rows = [(-1, keys[every], owners[every], None)] if every.any() else []
        k, o = keys[begin], owners[begin]
        rows += [(t, k[at], o[at], twice[at]) for t, at in deal(k, targets)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([planes(r[1]) for r in rows]), pa.array([planes(r[2]) for r in rows]), pa.array([None if r[3] is None else r[3].tobytes() for r in rows], pa.binary())], schema=_question)

    for keys, owners in found:
        if len(keys):
            held.append((keys, owners))
            count += len(keys)
        if count >= BLOCK_KEYS:
            yield from close()
            count = 0
    if held:
        yield from close()


def reply(keys: np.ndarray, owners: np.ndarray, targets: int) -> pa.RecordBatch:
    """Blocks of answers, dealt by owner for ``deliver``; an owner's stand together, so that the compression finds them."""
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    rows = [(t, keys[at], owners[at]) for t, at in deal(mix(owners.astype(np.uint64)), targets)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([planes(r[1]) if r[1].dtype == np.uint64 else r[1].tobytes() for r in rows], pa.binary()), pa.array([planes(r[2]) for r in rows], pa.binary())], schema=_answer)


def deliver(name: str, kind: np.dtype | type = np.uint64):
    """For mapInArrow over answers dealt by target: one row for each owner. kind: of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = from_planes if kind is np.uint64 else np.frombuffer
        held = [(unpack(k, kind), from_planes(o, np.int64)) for b in batches for k, o in zip(b.column("keys").to_pylist(), b.column("owners").to_pylist(), strict=True)]
        if held:
            keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            order, begin = groups(owners)
            keys, ids = keys[order], owners[order][begin]
            ends = np.append(begin[1:], len(keys))
            for lo in range(0, len(ids), 1000):
                part = slice(lo, lo + 1000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([keys[a:b].tobytes() for a, b in zip(begin[part], ends[part], strict=True)], pa.binary())], names=["did", name])

    return run


def answer(distinct_owners: bool, targets: int):
    """For mapInArrow over questions dealt by target: each document's keys that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for t, k, o, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k, o = from_planes(k, np.uint64), from_planes(o, np.int64)
                if t < 0:
                    yield reply(k, o, targets)
                else:
                    held.append((k, o, np.frombuffer(known, bool)))
        if held:
            keys, owners, known = (np.concatenate(x) for x in zip(*held, strict=True))
            order, begin = groups(keys)
            keys, owners, known = keys[order], owners[order], known[order]
            n = np.diff(np.append(begin, len(keys)))
            twice = np.logical_or.reduceat(known, begin)
            twice |= (np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin)) if distinct_owners else n > 1
            wanted = np.repeat(twice, n) & ~known  # the owners of known keys have been told
            if wanted.any():
                yield reply(keys[wanted], owners[wanted], targets)

    return run
