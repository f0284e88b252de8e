"""Language spans: script ranges narrow the candidates, Viterbi labels the words.

A word is a run of letters (ASCII letters and all bytes of other characters,
A-Z lower-cased). Its score per language is the log likelihood of its byte
2- to 4-grams, hashed to a table that is learned from labelled rows. The
script of a word's highest character rules out the languages in which that
script hardly ever stands. Over a text's words the best labelling is found with a penalty for each
change of language, so that a span needs some words of evidence.

``fit`` learns from a sample of about ROWS_PER_LANGUAGE rows of each language,
drawn by a hash of the id where the rows are; only the sample, whose size does not
follow the input's, is then dealt to COUNT_TASKS tasks. Prediction takes every row.

Cases: null texts and texts without a letter are ``und`` with score 0 and have
no spans; rows without lang or text teach nothing; with nothing to learn from
everything is ``und``; repeated rows are predicted alike; an empty table gives
an empty result; texts are taken whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm.blocks import Words, mix

ROWS_PER_LANGUAGE = 1500
#: A model has a table of BUCKETS numbers for each, 256 kB, and goes to every task: the bound of that broadcast.
MAX_LANGUAGES = 1000
#: The tasks that count the sample's grams.
COUNT_TASKS = 16
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
SWITCH = 12.0
#: A language keeps a script that at least this share of its words has.
SCRIPT_SHARE = 0.002
RULED_OUT = -100.0
UNDETERMINED = "und"
#: First code points of blocks, and the script that begins there.
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"),
]
_BEGIN = np.array([b for b, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


class Batch:
    """The words of some texts and, once for each different word, its grams and script."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LETTER[data]
        w = self.words = Words(data, offsets)
        order, begin = blocks.groups(w.hash)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        one = order[begin]
        size = w.end[one] - w.start[one]
        at = np.cumsum(size + 2) - (size + 2)
        flat = np.full(int((size + 2).sum()), 32, np.uint8)
        own = np.repeat(at + 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[own] = data[np.repeat(w.start[one] - (own[np.cumsum(size) - size] if len(size) else 0), size) + own]
        ends = np.repeat(at + size + 2, size + 2)
        wide = np.concatenate([flat, np.zeros(4, np.uint8)]).astype(np.uint64)
        buckets, owner = [], []
        value = np.zeros(len(flat), np.uint64)
        number = np.repeat(np.arange(len(one)), size + 2)
        for n in range(1, max(GRAMS) + 1):
            value = value << np.uint64(8) | wide[n - 1 : len(flat) + n - 1]
            if n in GRAMS:
                ok = np.arange(len(flat)) + n <= ends
                buckets.append((mix(value[ok] * np.uint64(8) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
                owner.append(number[ok])
        self.bucket, self.owner = np.concatenate(buckets), np.concatenate(owner)
        # The highest lead byte of a word, and its code point as far as scripts need it.
        self.script = np.zeros(len(one), np.int64)
        if len(one):
            lead = np.maximum.reduceat(np.where(flat >= 0xC0, flat, 0), at)
            spot = np.flatnonzero((flat >= 0xC0) & (flat == lead[number]))
            spot = spot[np.append(True, number[spot][1:] != number[spot][:-1])] if len(spot) else spot
            a, b, c = wide[spot].astype(np.int64), wide[spot + 1].astype(np.int64) & 63, wide[spot + 2].astype(np.int64) & 63
            point = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0x10000))
            code = np.zeros(len(one), np.int64)
            code[number[spot]] = point
            self.script = _SCRIPT[np.searchsorted(_BEGIN, code, "right") - 1]


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray, rows: np.ndarray):
        """Counts by language: of hashed grams, of words by script, of rows."""
        self.languages = languages
        p = grams + 0.1
        self.table = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32))
        if languages:
            self.table -= self.table.mean(1, keepdims=True)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        fits = share >= SCRIPT_SHARE
        fits[:, ~fits.any(0)] = True  # a script that no language has tells nothing
        self.narrow = np.where(fits, 0, RULED_OUT).T.astype(np.float32)
        self.prior = np.log(np.maximum(rows, 1) / max(rows.sum(), 1)).astype(np.float32)

    def scores(self, b: Batch) -> np.ndarray:
        out = np.zeros((len(b.script), len(self.languages)), np.float64)
        for i in range(len(self.languages)):
            out[:, i] = np.bincount(b.owner, self.table[b.bucket, i], len(b.script))
        return (out + self.narrow[b.script]).astype(np.float32)

    def label(self, b: Batch) -> np.ndarray:
        """The language number of every word: Viterbi over all texts at once, one word of each a step."""
        score, first = self.scores(b), b.words.first
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        live = np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), "right")  # texts with a word at each step
        start = first[:-1][order]
        stay = np.zeros((len(b.which), len(self.languages)), bool)
        best = np.zeros(len(b.which), np.int16)
        now = np.tile(self.prior, (len(order), 1))
        for t, k in enumerate(live.tolist()):
            at = start[:k] + t
            v = now[:k]
            if t:
                top = v.argmax(1)
                change = v[np.arange(k), top][:, None] - SWITCH
                stay[at] = v >= change
                best[at] = top
                v = np.maximum(v, change)
            now[:k] = v + score[b.which[at]]
        out = np.zeros(len(b.which), np.int16)
        current = now.argmax(1)
        for t in range(len(live) - 1, -1, -1):
            k = int(live[t])
            at = start[:k] + t
            own = current[:k]
            out[at] = own
            if t:
                current[:k] = np.where(stay[at, own], own, best[at])
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, offsets = blocks.buffers(batch.column("text"))
        grams = {x: np.zeros(BUCKETS, np.int64) for x in set(langs)}
        scripts = {x: np.zeros(len(_NAMES), np.int64) for x in grams}
        for lo, hi in blocks.pieces(offsets):
            b = Batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            doc = np.repeat(np.arange(hi - lo), np.diff(b.words.first))
            for x in set(langs[lo:hi]):
                times = np.bincount(b.which[(langs[lo:hi] == x)[doc]], minlength=len(b.script))
                grams[x] += np.bincount(b.bucket, times[b.owner], BUCKETS).astype(np.int64)
                scripts[x] += np.bincount(b.script, times, len(_NAMES)).astype(np.int64)
        keys = sorted(grams)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([grams[x].tobytes() for x in keys]), pa.array([scripts[x].tobytes() for x in keys]), pa.array([int((langs == x).sum()) for x in keys])], names=["lang", "grams", "scripts", "n"])


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    total = lambda c: sum(np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()).tobytes()
    return pa.table({"lang": [key[0].as_py()], "grams": [total("grams")], "scripts": [total("scripts")], "n": [sum(rows.column("n").to_pylist())]})


def fit(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from rows (doc_id, text, lang); the model has one column per language."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # One row per language: broadcast, so that no text is dealt by its language.
    share = rows.sparkSession.createDataFrame([(r["lang"], rows_per_language / r["count"]) for r in counts], "l string, share double")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).filter(draw < F.col("share")).select("lang", "text")
    schema = "lang string, grams binary, scripts binary, n long"
    # Each task sends one table of fixed size per language; the sum has one row per language.
    found = sorted(sample.repartition(COUNT_TASKS).mapInArrow(_count, schema).groupBy("lang").applyInArrow(_add, schema).collect(), key=lambda r: r["lang"])
    array = lambda c, width: np.array([np.frombuffer(r[c], np.int64) for r in found], np.float64).reshape(-1, width)
    return Model([r["lang"] for r in found], array("grams", BUCKETS), array("scripts", len(_NAMES)), np.array([r["n"] for r in found], np.float64))


def _labelled(docs: DataFrame, model: Model, schema: str, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = blocks.buffers(b.column("text"))
            for lo, hi in blocks.pieces(offsets, 4 * blocks.PIECE):
                part = Batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                labels = shared.value.label(part) if shared.value.languages else np.zeros(len(part.which), np.int16)
                out = columns(shared.value, part, labels, b.column("lettered").to_numpy(zero_copy_only=False)[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *out.values()], names=["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, {schema}")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the language of most letters (bytes), and its share of them."""

    def columns(model: Model, b: Batch, labels: np.ndarray, lettered: np.ndarray) -> dict[str, pa.Array]:
        w, n = b.words, len(lettered)
        doc = np.repeat(np.arange(n), np.diff(w.first))
        k = max(1, len(model.languages))
        size = np.bincount(doc * k + labels, w.end - w.start, n * k).reshape(n, k)
        top, total = size.argmax(1), size.sum(1)
        known = lettered & (total > 0) & bool(model.languages)
        score = np.where(known, size[np.arange(n), top] / np.maximum(total, 1), 0.0)
        return {"lang_pred": pa.array([model.languages[t] if ok else UNDETERMINED for t, ok in zip(top.tolist(), known.tolist(), strict=True)], pa.string()), "score": pa.array(score, pa.float64())}

    return _labelled(docs, model, "lang_pred string, score double", columns)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: [start, end, lang] of each run of words of one language, in bytes of the text."""

    def columns(model: Model, b: Batch, labels: np.ndarray, lettered: np.ndarray) -> dict[str, pa.Array]:
        w, out = b.words, []
        for i, ok in enumerate(lettered.tolist()):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            own = labels[lo:hi]
            if not ok or not model.languages or lo == hi:
                out.append([])
                continue
            base = w.offsets[i]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ends = np.append(edge[1:], hi - lo) - 1
            out.append([{"start": int(w.start[lo + x] - base), "end": int(w.end[lo + y] - base), "lang": model.languages[own[x]]} for x, y in zip(edge, ends, strict=True)])
        return {"spans": pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))}

    return _labelled(docs, model, "spans array<struct<start:bigint,end:bigint,lang:string>>", columns)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def held_out_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model learns from the other rows."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
