"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

Strings are words (and runs of single letters, as in ``i d i o t``), lower-cased, with marks for
begin and end. Two strings are alike by the triples of letters that both hold in order, not
necessarily side by side: a triple weighs LETTER_GAP for each letter it passes over and MARK_GAP
for each character that is no letter, up to a span of SPAN letters. So ``id-iot``, ``i.d.i.o.t`` and
``idxiot`` stay close to ``idiot``. The kernel is normalised by the weights of a string's triples.

- Landmarks are strings of the sample: those whose documents are toxic most oddly often, and others
  drawn by hash. A string's features are its kernel values with each landmark times the inverse root of
  the landmarks' own kernel matrix (Nyström).
- The machine is trained on sentences, each shown by its worst string, with squared hinge loss. Labels
  stand at documents: all sentences of a clean document are clean; of a toxic document those are toxic that the
  machine of the round before is SURE of. The first machine learns from strings that stand oddly often in
  toxic documents, against others.
- As kernel and machine are linear in the triples' weights, the landmarks fold into one table of
  a number for each triple; a text is scored by that table, each different string of a batch once.
- A document's score is a logistic function of its two worst strings and of how many are clearly
  toxic, in all and for its length, fitted on sampled documents that the machine has not seen.

``fit`` learns from a sample of at most about ROWS labelled documents of each class, drawn by a hash of the
id; SENTENCES of each, evenly over the text, train the machine. Every document is scored whole.

Cases: null and empty texts, and those without letters, have no sentence and get the score of such a
document (below every threshold unless such rows are labelled toxic); labels null in toxic teach nothing, of several for one document the
largest counts; a null doc_id teaches nothing; with one class only (or none) to learn from all scores are 0; repeated
rows score alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import mix
from tessella.llm.common import cut

#: Bounds of what is learned from: documents of each class, sentences of a document, landmarks.
ROWS, SENTENCES, LANDMARKS, DRAWN = 2000, 16, 96, 32
SPAN, LETTER_GAP, MARK_GAP, MOST_MARKS = 5, 0.5, 0.9, 3
#: Letters of a string; what is longer counts as several strings, whose triples still reach over the cut.
LONGEST = 24
#: Words of a sentence; what is longer counts as several.
SENTENCE_WORDS = 32
SYMBOLS = 64
_BEGIN, _END = 26, 27
TRIPLES = SYMBOLS**3
COST, ROUNDS = 1.0, 2
#: A string counts as likely toxic from this association with toxic documents (the root of the likelihood ratio, about a z-score); at most so many.
ODD, LIKELY = 3.8, 500
#: A toxic document's sentence is toxic from this score of the round before; its other sentences teach nothing.
SURE = 0.5
#: A string is clearly toxic from this score.
CLEARLY = 0.75
THRESHOLD = 0.7
#: Characters of texts that are worked on at once.
PIECE = 1 << 20

_SPACE, _LETTER, _OTHER, _STOP = range(4)
_KIND = np.full(0x3100, _LETTER, np.uint8)
_KIND[:128] = _OTHER
_KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
_KIND[[*range(0xA1, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x200B, 0x2028), *range(0x202A, 0x202F), *range(0x2030, 0x205F), *range(0x2060, 0x2070), *range(0x3001, 0x3004)]] = _OTHER
_KIND[[ord(c) for c in ".!?|"]] = _STOP


class Strings:
    """The strings of some texts. first, last: characters; doc; sentence: numbers of the strings' sentences, all texts' together. symbols, marks: of the different strings, flat, from begin to begin; which: the different string of each."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64) + 1
        at = np.cumsum(size) - size
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = at
        kind = np.where(code < len(_KIND), _KIND[np.minimum(code, len(_KIND) - 1)], _LETTER)
        space = kind == _SPACE
        letter = np.flatnonzero(kind == _LETTER)
        # A word: letters between spaces. A stop before a space, and a line end, end a sentence.
        word = np.cumsum(space)[letter]
        stop = code == 10
        stop[:-1] |= (kind[:-1] == _STOP) & space[1:]
        new = np.append(True, word[1:] != word[:-1])[: len(letter)]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(letter)))
        stops = np.cumsum(stop)[letter[begin]] if len(begin) else begin
        # Three or more single letters in one sentence, equally far apart, are one string.
        single = n == 1
        edge = np.append(True, (single[1:] != single[:-1]) | ~single[1:] | (stops[1:] != stops[:-1]))[: len(n)]
        far = np.diff(letter[begin])
        edge[2:] |= ~edge[1:-1] & (far[1:] != far[:-1])
        run = np.flatnonzero(edge)
        length = np.diff(np.append(run, len(n)))
        apart = edge | np.repeat(length < 3, length)
        begin, stops = begin[apart], stops[apart]
        # Long strings in several pieces.
        n = np.diff(np.append(begin, len(letter)))
        pieces = np.maximum(1, -(-n // LONGEST))
        owner = np.repeat(np.arange(len(begin)), pieces)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = begin[owner] + part * LONGEST
        hi = np.minimum(lo + LONGEST, (begin + n)[owner])
        self.first, self.last = letter[lo], letter[hi - 1] + 1
        self.doc = np.searchsorted(at, self.first, "right") - 1
        # Sentences, of SENTENCE_WORDS strings at most.
        fresh = np.append(True, stops[owner][1:] != stops[owner][:-1])[: len(owner)]
        start = np.flatnonzero(fresh)
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        self.sentence = np.cumsum(fresh | (place % SENTENCE_WORDS == 0)) - 1
        self._spell(code, letter, lo, hi, part == 0, np.append(owner[1:] != owner[:-1], True)[: len(owner)])

    def _spell(self, code: np.ndarray, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
        """A piece's symbols: its letters, a mark at both ends of a string, and the first letters of the next piece, which only end triples (own: how many begin some)."""
        more = np.where(tail, 0, np.minimum(SPAN, np.append(hi[1:] - lo[1:], 0)[: len(lo)]))
        size = head + (hi - lo) + tail + more
        own = head + (hi - lo) + tail
        begin = np.cumsum(size) - size
        total = int(size.sum())
        place = np.arange(total) - np.repeat(begin, size)
        source = np.repeat(lo - head, size) + place
        letters = (place >= np.repeat(head.astype(np.int64), size)) & (place < np.repeat(size - tail, size))
        c = code[letter[np.clip(source, 0, max(0, len(letter) - 1))]] if len(letter) else np.zeros(0, np.uint32)
        plain = (c >= 97) & (c < 123)
        symbol = np.where(plain, c.astype(np.int64) - 97, 28 + (c.astype(np.int64) * 2654435761 >> 12) % (SYMBOLS - 28))
        symbol = np.where(letters, symbol, np.where(place == 0, _BEGIN, _END)).astype(np.uint8)
        between = np.zeros(len(letter), np.int64)
        between[1:] = np.minimum(letter[1:] - letter[:-1] - 1, MOST_MARKS)
        inner = letters & (place > np.repeat(head.astype(np.int64), size))
        marks = np.where(inner, between[np.clip(source, 0, max(0, len(letter) - 1))] if len(letter) else 0, 0).astype(np.uint8)
        # The different ones.
        value = mix(symbol.astype(np.uint64) | marks.astype(np.uint64) << np.uint64(8) | place.astype(np.uint64) << np.uint64(16) | np.repeat(own, size).astype(np.uint64) << np.uint64(40)) if total else np.zeros(0, np.uint64)
        key = np.add.reduceat(value, begin) if total else value
        _, one, self.which = np.unique(key, return_index=True, return_inverse=True)
        size = size[one]
        self.begin = np.cumsum(size) - size
        take = np.repeat(begin[one] - self.begin, size) + np.arange(int(size.sum()))
        self.symbol, self.size, self.own = symbol[take].astype(np.int32), size, own[one]
        self.passed = np.cumsum(marks[take].astype(np.int64))

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(triple, weight) that begins at each symbol, one after the other for all shapes within SPAN; weight 0 where there is none."""
        n = len(self.symbol)
        place = np.arange(n) - np.repeat(self.begin, self.size)
        room = np.where(place < np.repeat(self.own, self.size), np.repeat(self.size, self.size) - place, 0)
        decay = MARK_GAP ** np.arange(SPAN * MOST_MARKS + 1)
        s = np.concatenate([self.symbol, np.zeros(SPAN, np.int32)])
        passed = np.concatenate([self.passed, np.zeros(SPAN, np.int64)])
        for b in range(2, SPAN):
            weight = np.where(room > b, LETTER_GAP ** (b - 2) * decay[np.clip(passed[b : n + b] - passed[:n], 0, len(decay) - 1)], 0.0).astype(np.float32)
            for a in range(1, b):
                yield s[:n] << 12 | s[a : n + a] << 6 | s[b : n + b], weight

    def norms(self) -> np.ndarray:
        """Of the different strings; one for those without a triple."""
        total = np.zeros(len(self.symbol), np.float64)
        for _, w in self.triples():
            total += w * w
        own = np.add.reduceat(total, self.begin) if len(total) else total
        return np.sqrt(np.where(own > 0, own, 1.0))

    def folded(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's numbers over the triples of each different string, by weight, normalised."""
        total, squares = np.zeros(len(self.symbol), np.float64), np.zeros(len(self.symbol), np.float64)
        for t, w in self.triples():
            total += table[t] * w
            squares += w * w
        if not len(total):
            return total
        own = np.add.reduceat(squares, self.begin)
        return np.add.reduceat(total, self.begin) / np.sqrt(np.where(own > 0, own, 1.0))

    def with_landmarks(self, rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Kernel values of each different string with each landmark. rows: the matrix's row of each triple (0: none)."""
        out = np.zeros((len(self.begin), matrix.shape[1]), np.float32)
        number = np.repeat(np.arange(len(self.begin)), self.size)
        for t, w in self.triples():
            r = rows[t]
            hit = np.flatnonzero((r > 0) & (w > 0))
            order = number[hit]
            if len(hit):
                start = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
                for lo in range(0, len(start), 4096):
                    hi = start[lo + 4096] if lo + 4096 < len(start) else len(hit)
                    part = slice(int(start[lo]), int(hi))
                    out[order[start[lo : lo + 4096]]] += np.add.reduceat(matrix[r[hit[part]]] * w[hit[part]][:, None], start[lo : lo + 4096] - start[lo])
        return out / self.norms()[:, None].astype(np.float32)

    def spelled(self) -> list[str | None]:
        """The different strings of plain letters between both marks; None for others."""
        out = []
        for b, n, o in zip(self.begin.tolist(), self.size.tolist(), self.own.tolist(), strict=True):
            s = self.symbol[b : b + n]
            out.append(_text(s) if n == o and s[0] == _BEGIN and s[-1] == _END and self.passed[b + n - 1] == self.passed[b] else None)
        return out


_ALPHABET = "".join(chr(c) for c in range(97, 123)) + "^$" + "".join(chr(0x100 + c) for c in range(SYMBOLS - 28))


def _text(symbols: np.ndarray) -> str:
    return "".join(_ALPHABET[s] for s in symbols.tolist())


def _triples_of(text: str) -> dict[int, float]:
    """Weights of a spelled string's triples."""
    s, out = [_ALPHABET.index(c) for c in text], {}
    for i in range(len(s)):
        for b in range(2, SPAN):
            for a in range(1, b):
                if i + b < len(s):
                    t = s[i] << 12 | s[i + a] << 6 | s[i + b]
                    out[t] = out.get(t, 0.0) + LETTER_GAP ** (b - 2)
    return out


def _norm(text: str) -> float:
    n = len(text)
    return sum(LETTER_GAP ** (2 * (b - 2)) * (b - 1) * max(0, n - b) for b in range(2, SPAN)) ** 0.5 or 1.0


class Landmarks:
    def __init__(self, texts: list[str]):
        self.texts = texts
        own = [_triples_of(t) for t in texts]
        every = sorted({t for x in own for t in x})
        self.rows = np.zeros(TRIPLES, np.int32)
        self.rows[every] = np.arange(1, len(every) + 1)
        self.matrix = np.zeros((len(every) + 1, len(texts)), np.float32)
        for j, x in enumerate(own):
            for t, w in x.items():
                self.matrix[self.rows[t], j] = w / _norm(texts[j])
        self.triples = np.array(every, np.int64)

    def features(self, texts: list[str]) -> np.ndarray:
        """Kernel values of spelled strings with each landmark."""
        out = np.zeros((len(texts), self.matrix.shape[1]))
        for k, text in enumerate(texts):
            for t, w in _triples_of(text).items():
                out[k] += self.matrix[self.rows[t]] * w
            out[k] /= _norm(text)
        return out

    def root(self) -> np.ndarray:
        """The inverse root of their kernel matrix."""
        value, vector = np.linalg.eigh(self.matrix.astype(np.float64).T @ self.matrix)
        return vector / np.sqrt(np.maximum(value, 1e-3))

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """One number for each triple: what it adds with these weights of the landmarks."""
        table = np.zeros(TRIPLES, np.float32)
        table[self.triples] = self.matrix[1:] @ weights
        return table


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine of squared hinge loss, classes of equal weight; Newton's method. y: 1 or -1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * COST
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    unit = np.eye(len(w))
    unit[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        xa = x[active]
        w = np.linalg.solve(unit + 2 * (xa * c[active, None]).T @ xa, 2 * xa.T @ (c[active] * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, the last one for the constant; Newton's method. y: 0 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """table: a number for each triple; bias: of a sentence; head: weights of a document's features."""

    def __init__(self, table: np.ndarray | None = None, bias: float = 0.0, head: np.ndarray | None = None):
        self.table, self.bias, self.head = table, bias, head

    def worst(self, s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(worst string, its score, document) of each sentence."""
        first = np.flatnonzero(np.append(True, s.sentence[1:] != s.sentence[:-1])) if len(s.sentence) else np.zeros(0, np.int64)
        if not len(first):
            return first, np.zeros(0), first
        value = s.folded(self.table)[s.which]
        best = np.maximum.reduceat(value, first)
        hit = np.flatnonzero(value == best[s.sentence - s.sentence[0]])
        return hit[np.append(True, s.sentence[hit][1:] != s.sentence[hit][:-1])], best + self.bias, s.doc[first]

    def features(self, s: Strings, texts: int) -> np.ndarray:
        """Of each text its worst and its second worst string, how many strings are clearly toxic, and which share of all."""
        score = s.folded(self.table)[s.which] + self.bias if len(s.which) else np.zeros(0)
        some = np.flatnonzero(score > -1)
        some = some[np.lexsort((-score[some], s.doc[some]))]
        score, begin = score[some], np.searchsorted(s.doc[some], np.arange(texts + 1))
        top = np.full((texts, 2), -1.0)
        for k in range(2):
            has = begin[1:] - begin[:-1] > k
            top[has, k] = np.minimum(score[begin[:-1][has] + k], 1)
        toxic, strings = np.bincount(s.doc[some[score > CLEARLY]], minlength=texts)[:texts], np.bincount(s.doc, minlength=texts)[:texts]
        return np.column_stack([top, np.log1p(toxic), np.log((toxic + 0.2) / (strings + 50.0))])

    def scores(self, s: Strings, texts: int) -> np.ndarray:
        if self.head is None:
            return np.zeros(texts)
        return 1 / (1 + np.exp(-np.clip(self.features(s, texts) @ self.head[:-1] + self.head[-1], -30, 30)))


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PIECE):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _texts(b: pa.RecordBatch) -> list[str]:
    return b.column("text").fill_null("").to_pylist()


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, toxic, clean): in how many documents of the batch a string stands."""
    for b in batches:
        toxic, texts = np.array(b.column("toxic").to_pylist(), np.int64), _texts(b)
        for lo, hi in _pieces(texts):
            s = Strings(texts[lo:hi])
            pair = np.unique(s.which.astype(np.int64) << 32 | s.doc)
            bad = toxic[lo + (pair & 0xFFFFFFFF)]
            t, c = np.bincount(pair >> 32, bad, len(s.begin)), np.bincount(pair >> 32, 1 - bad, len(s.begin))
            text = s.spelled()
            keep = [k for k, x in enumerate(text) if x]
            yield pa.RecordBatch.from_arrays([pa.array([text[k] for k in keep], pa.string()), pa.array(t[keep].astype(np.int64)), pa.array(c[keep].astype(np.int64))], names=["string", "toxic", "clean"])


def _witnesses(landmarks: Landmarks, model: Model):
    """For mapInArrow: (doc, toxic, x) of SENTENCES sentences of each document, evenly over it. x: the features of a sentence's worst string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, toxic, texts = b.column("doc_id").to_numpy(), b.column("toxic").to_numpy(), _texts(b)
            for lo, hi in _pieces(texts):
                s = Strings(texts[lo:hi])
                if not len(s.sentence):
                    continue
                worst, _, doc = model.worst(s)
                begin = np.searchsorted(doc, doc)
                n, place = np.bincount(doc)[doc], np.arange(len(doc)) - begin
                some = (place * SENTENCES // n) != ((place - 1) * SENTENCES // n)
                value = s.with_landmarks(landmarks.rows, landmarks.matrix)[s.which[worst[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc[some]]), pa.array(toxic[lo + doc[some]].astype(np.int64)), pa.array([v.tobytes() for v in value.astype(np.float32)], pa.binary())], names=["doc", "toxic", "x"])

    return run


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            for lo, hi in _pieces(texts):
                x = model.features(Strings(texts[lo:hi]), hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(b.column("toxic").to_numpy()[lo:hi].astype(np.int64)), pa.array([v.tobytes() for v in x], pa.binary())], names=["toxic", "x"])

    return run


def _draw(doc_id: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    share = F.when(F.col("toxic") == 1, rows / n[1]).otherwise(rows / n[0])
    drawn = known.filter(_draw(F.col("doc_id"), 1) < share)  # about 2 * rows
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("head", _draw(F.col("doc_id"), 2) < 0.3).dropDuplicates(["toxic", "text"]))
    learn = sample.filter(~F.col("head"))
    size = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model()
    strings = cut(learn.mapInArrow(_associations, "string string, toxic long, clean long").groupBy("string").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
    t, c, share = F.col("t"), F.col("c"), size[1] / (size[0] + size[1])
    against = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0)
    odd = F.when(t > (t + c) * share, F.sqrt(2 * (against(t, share) + against(c, 1 - share)))).otherwise(0)
    likely = [r["string"] for r in strings.filter(odd > ODD).orderBy(odd.desc(), "string").limit(LIKELY).collect()]
    other = [r["string"] for r in strings.filter((odd <= ODD) & (F.col("c") > 0)).orderBy(F.xxhash64("string"), "string").limit(10 * LIKELY).collect()]
    if not likely or not other:
        return Model()
    landmarks = Landmarks(likely[:LANDMARKS] + other[:DRAWN])
    root = landmarks.root()
    x = landmarks.features(likely + other) @ root
    weights, bias = machine(x, np.where(np.arange(len(x)) < len(likely), 1.0, -1.0))
    for _ in range(ROUNDS):
        model = Model(landmarks.fold(root @ weights), bias)
        # At most SENTENCES x rows of some hundred bytes.
        found = sorted(learn.mapInArrow(_witnesses(landmarks, model), "doc long, toxic long, x binary").collect(), key=lambda r: (r["doc"], bytes(r["x"])))
        own = np.array([np.frombuffer(r["x"], np.float32) for r in found]).astype(np.float64) @ root
        bad = np.array([r["toxic"] for r in found]) == 1
        some = ~bad | (own @ weights + bias > SURE)
        y = np.where(np.append(np.ones(len(likely), bool), bad[some]), 1.0, -1.0)
        weights, bias = machine(np.vstack([x[: len(likely)], own[some]]), y)
    model = Model(landmarks.fold(root @ weights), bias)
    rest = sorted(((r["toxic"], bytes(r["x"])) for r in sample.filter("head").mapInArrow(_feature_rows(model), "toxic long, x binary").collect()))
    if rest:
        # The sample holds as many documents of each class as it can; the weights bring back how common they are.
        t = np.array([r[0] for r in rest], np.float64)
        model.head = logistic(np.array([np.frombuffer(r[1], np.float64) for r in rest]), t)
        drawn_share = min(1.0, rows / n[1]) / min(1.0, rows / n[0])
        model.head[-1] -= np.log(drawn_share)
    return model


def _run(docs: DataFrame, model: Model, columns, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of TRIPLES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            for lo, hi in _pieces(texts):
                out = columns(shared.value, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *out.values()], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: 0 to 1, of every whole text."""
    return _run(docs, model, lambda m, t: {"score": pa.array(m.scores(Strings(t), len(t)), pa.float64())}, "score double")


def toxic_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: [start, end, score] of the worst string of each toxic sentence, in characters of the lower-cased text."""

    def columns(m: Model, texts: list[str]) -> dict[str, pa.Array]:
        s = Strings(texts)
        empty = np.zeros(0, np.int64)
        worst, value, doc = m.worst(s) if m.table is not None else (empty, empty, empty)
        out: list[list[dict]] = [[] for _ in texts]
        for k in np.flatnonzero(value > 0).tolist():
            base = int(s.at[doc[k]])
            out[doc[k]].append({"start": int(s.first[worst[k]]) - base, "end": int(s.last[worst[k]]) - base, "score": float(value[k])})
        return {"spans": pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))}

    return _run(docs, model, columns, "spans array<struct<start:bigint,end:bigint,score:double>>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def held_out_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the model learns from the other rows."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
