"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

``Lexicon`` compiles the words that the vocabulary itself names as frequent (and
any further ones) into a minimal acyclic automaton: equal suffixes share their
states, and every transition carries how many words sort before it, so that
following a word sums up its number, under which its ids are found. The arrays
are packed into one file, which each worker maps from its temporary folder; the
size is that of the vocabulary. A batch's distinct pieces walk through the
automaton together, a byte at a time; pieces that it does not hold are merged
exactly, all of them together, lowest rank first.

Texts are split at single spaces between other characters, where a piece always
ends, so a text is a list of units of which few are new in a batch.

Cases: null text is empty and has no ids; texts of any length and repeated rows
are taken whole; an empty table gives an empty result; strings of special tokens
in a text become those tokens, as the tokenizers library does; the id column may
hold nulls; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm.blocks import mix

#: Fixed values of byte-level BPE: white space, and what a piece is.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
_SPACES = [chr(c) for c in (9, 10, 11, 12, 13, 32)]
_WIDE = re.compile(f"[{WHITE[6:]}]")
_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Longer pieces are merged one by one with a heap.
LONG = 128
BATCH_BYTES, MAX_UNITS = 4 << 20, 200_000
NONE = np.iinfo(np.int64).max
MARK = "\ud800"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes of each id, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        wanted = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and model["type"] == "BPE" and spec["normalizer"] is None and spec["post_processor"] is None
        if not wanted or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level BPE file")
        letter = byte_letters()
        own = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*own.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for t, i in own.items():
            self.tokens[i] = bytes(letter[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(own[a], own[b], own[a + b]) for a, b in pairs]
        self.bytes = np.zeros(256, np.int64)
        for c, b in letter.items():
            self.bytes[b] = own[c]
        self.words = [self.tokens[i] for i in own.values()]


class Merges:
    """Rank and result of a pair of ids, in an open-addressing table."""

    def __init__(self, merges: list[tuple[int, int, int]], first: np.ndarray):
        self.first = first
        a, b, r = np.array(merges, np.int64).reshape(-1, 3).T
        bits = max(4, (4 * len(merges)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.rank, self.result = np.full(1 << bits, -1), np.full(1 << bits, NONE), np.zeros(1 << bits, np.int64)
        self.probes = 1
        for rank, (k, x) in enumerate(zip((a << 32 | b).tolist(), r.tolist(), strict=True)):
            at, n = int(self._slot(np.array([k]))[0]), 1
            while self.key[at] not in (-1, k):
                at, n = (at + 1) & int(self.mask), n + 1
            if self.key[at] == -1:
                self.key[at], self.rank[at], self.result[at] = k, rank, x
                self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & self.mask).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = self._slot(key)
        open_ = np.flatnonzero((self.key[at] != key) & (self.key[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(self.mask)
            open_ = open_[(self.key[at[open_]] != key[open_]) & (self.key[at[open_]] != -1)]
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NONE), self.result[at]

    def encode(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and each one's number of ids. data: the pieces' bytes, none of them empty."""
        ids, owner = self.first[data], np.repeat(np.arange(len(length)), length)
        rank, result = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
        self._look(ids, owner, rank, result, np.arange(len(ids)))
        done_ids, done_owner = [], []
        while len(ids):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            n = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            if (stop := least == NONE).any():  # nothing is left to merge in these
                out = np.repeat(stop, n)
                done_ids.append(ids[out])
                done_owner.append(owner[out])
                ids, owner, rank, result = ids[~out], owner[~out], rank[~out], result[~out]
                least, n = least[~stop], n[~stop]
                if not len(ids):
                    break
            here = rank == np.repeat(least, n)
            # Of overlapping pairs every second one, from the left of each run.
            run = np.flatnonzero(here & ~np.append(False, here[:-1]))
            at = np.flatnonzero(here)
            here[at] = (at - run[np.searchsorted(run, at, "right") - 1]) % 2 == 0
            at = np.flatnonzero(here)
            ids[at] = result[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, rank, result = ids[keep], owner[keep], rank[keep], result[keep]
            at = place[at]
            near = np.zeros(len(ids), bool)
            near[at] = near[np.maximum(at - 1, 0)] = True
            self._look(ids, owner, rank, result, np.flatnonzero(near))
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(length), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(length))

    def _look(self, ids: np.ndarray, owner: np.ndarray, rank: np.ndarray, result: np.ndarray, at: np.ndarray) -> None:
        rank[at] = NONE
        at = at[at < len(ids) - 1]
        at = at[owner[at] == owner[at + 1]]
        rank[at], result[at] = self.find(ids[at], ids[at + 1])

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece, with a heap over its pairs."""
        ids = self.first[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        rank, result = self.find(ids[:-1], ids[1:])
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1], x) for i, (r, x) in enumerate(zip(rank.tolist(), result.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, a, b, x = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = x, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    pair = ids[left], ids[right]
                    if pair not in memo:
                        r, y = self.find(np.array(pair[:1]), np.array(pair[1:]))
                        memo[pair] = int(r[0]), int(y[0])
                    if memo[pair][0] != NONE:
                        heapq.heappush(heap, (memo[pair][0], left, *pair, memo[pair][1]))
        return [x for x in ids if x >= 0]


class Lexicon:
    """A mapped minimal acyclic transducer from words to ids."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115  mapped as long as the object lives
        m = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(m, np.int64, 5)
        at, parts = 40, []
        for n in sizes.tolist():
            parts.append(np.frombuffer(m, np.int64, n, at))
            at += 8 * n
        #: Transitions: state * 256 + byte, sorted; where to, and words before. final: a word ends in the state. offsets, ids: by word number.
        self.arc, self.to, self.final, self.offsets, self.ids = parts[0], parts[1] >> 32, parts[2], parts[3], parts[4]
        self.skip = parts[1] & 0xFFFFFFFF

    @staticmethod
    def pack(words: Iterable[bytes], merges: Merges) -> bytes:
        words = sorted({w for w in words if w})
        # States are built along sorted words; what a new word leaves behind is final and shared with its equal.
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # [a word ends here, transitions], from the root

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                end, arcs = path.pop()
                state = (end, tuple(arcs))
                if state not in known:
                    known[state] = len(states)
                    states.append(state)
                path[-1][1][-1] = (path[-1][1][-1][0], known[state])

        last = b""
        for w in words:
            same = len(os.path.commonprefix([last, w]))
            close(same)
            for b in w[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        # A state stands after those it leads to, the root last; numbers are turned round so that the root is 0.
        top, below, rows = len(states) - 1, [], []
        for i, (end, arcs) in enumerate(states):
            n = int(end)
            for b, to in arcs:
                rows.append(((top - i) << 8 | b, (top - to) << 32 | n))
                n += below[to]
            below.append(n)
        rows.sort()
        arc, to = np.array(rows, np.int64).reshape(-1, 2).T
        final = np.array([int(s[0]) for s in reversed(states)], np.int64)
        ids, n = merges.encode(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts = [np.ascontiguousarray(arc), np.ascontiguousarray(to), final, np.append(0, np.cumsum(n)), ids]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.astype(np.int64).tobytes() for p in parts)

    def numbers(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is no word."""
        out = np.full(len(start), -1)
        who, state, number = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for step in range(int(length.max(initial=0))):
            key = state << 8 | data[start[who] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            who, at, number = who[ok], at[ok], number[ok]
            state, number = self.to[at], number + self.skip[at]
            end = length[who] == step + 1
            out[who[end]] = np.where(self.final[state[end]] > 0, number[end], -1)
            who, state, number = who[~end], state[~end], number[~end]
            if not len(who):
                break
        return out


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every span, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Numbered(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Coder:
    """Encodes lists of texts. Units and their ids are kept from batch to batch up to MAX_UNITS."""

    def __init__(self, vocabulary: Vocabulary, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon, self.special = merges, lexicon, vocabulary.special
        self.token_length = np.array([len(t) for t in vocabulary.tokens])
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.find = regex.compile(PIECE).findall
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.units = Numbered()
        self.done = 0
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _codes(self, text: str) -> list[int]:
        units, out = self.units, []
        for part in self._special.split(text) if self._special and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(units[part])
            elif part:
                odd = part[0] == " " or part[-1] == " " or any(f"{s} " in part or f" {s}" in part for s in _SPACES) or (not part.isascii() and _WIDE.search(part))
                own = _CUT.split(part) if odd else part.split(" ")
                # A unit's key has no space in front; the first of a part, which has none in the text either, gets a mark that no text holds.
                out.append(units[MARK + own[0]])
                out += map(units.__getitem__, own[1:])
        return out

    def _encode_new(self) -> None:
        new = list(self.units)[self.done :]
        if not new:
            return
        pieces = Numbered()
        flat: list[int] = []
        counts: list[int] = []
        fixed: dict[int, int] = {}
        put = pieces.__getitem__
        for k, u in enumerate(new):
            if u in self.special:
                fixed[k] = self.special[u]
                counts.append(0)
            elif u.isalpha():
                flat.append(put(f" {u}"))
                counts.append(1)
            elif u[:-1].isalpha() and u[-1] in ",.":
                flat.append(put(f" {u[:-1]}"))
                flat.append(put(u[-1]))
                counts.append(2)
            else:
                found = self.find(u[1:] if u[0] == MARK else f" {u}")
                flat += map(put, found)
                counts.append(len(found))
        ids, start, length = self._encode_pieces([p.encode() for p in pieces])
        flat, counts = np.array(flat, np.int64), np.array(counts, np.int64)
        # From units to pieces to ids.
        unit_ids = ids[spans(start[flat], length[flat])]
        sums = np.append(0, np.cumsum(length[flat]))
        ends = np.cumsum(counts)
        n = sums[ends] - sums[ends - counts]
        if fixed:
            at = np.array(list(fixed), np.int64)
            unit_ids = np.insert(unit_ids, sums[ends[at]], np.array(list(fixed.values()), np.int64))
            n[at] = 1
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.ids = np.concatenate([self.ids, unit_ids])
        self.done = len(self.units)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each piece's place and number of ids in them."""
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.cumsum(size) - size
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        number = self.lexicon.numbers(data, at, size)
        known = np.flatnonzero(number >= 0)
        start[known] = self.lexicon.offsets[number[known]]
        length[known] = self.lexicon.offsets[number[known] + 1] - start[known]
        base = len(self.lexicon.ids)
        unseen = np.flatnonzero((number < 0) & (size <= LONG))
        ids, n = self.merges.encode(data[spans(at[unseen], size[unseen])], size[unseen]) if len(unseen) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        start[unseen], length[unseen] = base + np.cumsum(n) - n, n
        parts = [self.lexicon.ids, ids]
        base += len(ids)
        for i in np.flatnonzero((number < 0) & (size > LONG)).tolist():
            own = np.array(self.merges.encode_long(pieces[i]), np.int64)
            start[i], length[i] = base, len(own)
            base += len(own)
            parts.append(own)
        return np.concatenate(parts), start, length

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > MAX_UNITS:
            self._reset()
        codes = [np.array(self._codes(t), np.int64) for t in texts]
        self._encode_new()
        return [self.ids[spans(self.start[c], self.length[c])] for c in codes]

    def decode(self, ids: np.ndarray) -> str:
        return self.token_bytes[spans(self.token_start[ids], self.token_length[ids])].tobytes().decode("utf-8", "replace")


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns, extra: Iterable[bytes] = ()) -> DataFrame:
    """One row per input row: columns(coder, ids of a batch of texts) gives the columns after the id."""
    vocabulary = Vocabulary(path)
    merges = Merges(vocabulary.merges, vocabulary.bytes)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, merges, Lexicon.pack([*vocabulary.words, *extra], merges)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, merges, packed = shared.value
        with tempfile.NamedTemporaryFile(delete=False) as f:
            f.write(packed)
        coder = Coder(vocabulary, merges, Lexicon(f.name))
        os.unlink(f.name)  # the mapping stays valid
        for b in batches:
            texts, lo, size = b.column(1), 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    own = [t or "" for t in texts.slice(lo, i + 1 - lo).to_pylist()]
                    out = columns(coder, coder.encode(own))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, i + 1 - lo), *out.values()], names=[id_col, *out])
                    lo, size = i + 1, 0

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every text."""
    return _coded(docs, path, id_col, text_col, "ids array<int>", lambda _, ids: {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the inverse of ``encode``. Null ids give an empty text; an id outside the vocabulary is an error."""
    tokens = coded.sparkSession.sparkContext.broadcast(Vocabulary(path).tokens)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [b"".join(map(tokens.value.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted."""

    def columns(coder: Coder, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        digest = lambda b: hashlib.sha256(b).hexdigest()
        own = {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))} if with_ids else {}
        return {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([digest(x.astype("<u4").tobytes()) for x in ids], pa.string()),
            "decoded_sha256": pa.array([digest(coder.decode(x).encode()) for x in ids], pa.string()),
            **own,
        }

    return _coded(docs, path, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, columns)
