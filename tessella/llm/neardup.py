"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles, counted by their words and handled as 64-bit hashes. From it come
MinHash band keys and two odd sketches. In the first
each MinHash sample flips one bit of a small bitmap, so that the XOR of two
bitmaps has about as many ones as the samples differ, which estimates high
similarities closely. In the second every shingle flips a bit: the XOR has at
most as many ones as the sets differ in elements, a bound that drops no pair
wrongly and is sharp for all but long texts. Only that bound and the sizes rule
a pair out; the estimate merely says which pairs to try first.

1. Documents of the same word sequence are one class, known by a cryptographic
   digest (BLAKE2b, 128 bits) of the lower-cased words themselves; only its smallest
   doc_id goes on.
2. In each band bucket every class is paired with the smallest one (a star, so
   pairs grow with the bucket, not with its square). Pairs whose sizes or set
   sketches rule the similarity out are dropped, the others verified on the words of
   the full texts, shingle by shingle, and connected components found.
3. Where a bucket still has several components, each class outside the first is
   paired with members drawn differently for each bucket; the NEAREST by both
   sketches are verified, and components found again.
4. Where a bucket still has several components, the classes outside its first
   component are joined with the others of the bucket, sizes and set sketches
   being part of the join's condition; what passes is verified, and components
   found again. After that every candidate pair of the bands is either verified or
   inside one component. Step 3 only makes step 4 short.

With BANDS x BAND_ROWS a pair at the threshold 0.85 shares no band with a
probability of 7.7e-7, one at 0.80 with one of 7.3e-5. No later step drops a
similar pair, and no link rests on hashes alone.

Hot keys: the members of a class, of a bucket and the partners of a hub are dealt in
parts of bounded size (``common.dealt``), and a hub's text, or in step 4 the classes outside, travels once to a part.

Cases: texts without a word, and null texts, are linked with nothing; shorter
texts than a shingle are one shingle; a null doc_id is linked with nothing, its
component_id is null and it is kept; rows of equal doc_id share a component;
repeated rows each get their row in ``components``, and ``keep_one`` leaves one
of rows equal in doc_id and text; an empty table gives an empty result; texts
are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import blocks
from tessella.llm.blocks import LOWER, Words, mix, shingle_hash
from tessella.llm.common import WORD, copied, cut, dealt, guarded, hot_keys, spread_join

BANDS, BAND_ROWS = 24, 5
SKETCH_LONGS, SET_LONGS = 4, 16
NEAREST = 3
_COLUMNS = [f"s{i}" for i in range(SKETCH_LONGS)] + [f"t{i}" for i in range(SET_LONGS)]
_SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _COLUMNS)
#: Shingles whose MinHash values are taken at once: few enough for the processor's cache.
_CACHE = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, one after the other, and where each text's begin. Shingles are distinct by their words; should two of them share a hash, it stands twice."""
    data = LOWER[data]
    w = Words(data, offsets)
    at = w.windows(k)
    doc = np.searchsorted(w.first, at, "right") - 1
    h = shingle_hash(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    new = _new(h[order], doc[order])
    if not new.all():
        # Where hashes coincide the words tell whether the shingles do.
        word = w.numbers(data)
        differ = lambda o: np.logical_or.reduce([word[at[o][1:] + j] != word[at[o][:-1] + j] for j in range(k)])
        if (differ(order) & ~new[1:]).any():
            order = np.lexsort((*(word[at + j] for j in range(k)), h, doc))
            new = _new(h[order], doc[order])
            new[1:] |= differ(order)
    h, doc = h[order][new], doc[order][new]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence is the one shingle
        own = [mix(shingle_hash(w.hash[w.first[i] : w.first[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short]
        place = np.searchsorted(doc, short)
        h, doc = np.insert(h, place, np.array(own, np.uint64)), np.insert(doc, place, short)
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def _new(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return out


def minhashes(h: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """Samples x texts. begin: where each text's shingles begin; every text has some."""
    factor = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    flip = mix(factor)
    out = np.full((count, len(begin)), np.iinfo(np.uint64).max)
    ends = np.append(begin[1:], len(h))
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + _CACHE, "right")))
        for a in range(int(begin[lo]), int(ends[hi - 1]), _CACHE):  # a long text in several steps
            b = min(a + _CACHE, int(ends[hi - 1])) if hi == lo + 1 else int(ends[hi - 1])
            part, where = h[a:b], np.maximum(begin[lo:hi] - a, 0)
            for p in range(count):
                np.minimum(out[p, lo:hi], np.minimum.reduceat((part ^ flip[p]) * factor[p], where), out=out[p, lo:hi])
            if b == ends[hi - 1]:
                break
        lo = hi
    return out


def _signatures(k: int):
    samples = BANDS * BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = blocks.buffers(b.column("text"))
            digest = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(_words(t)), digest_size=16).digest() for t in b.column("text").cast(pa.large_binary()).to_pylist()), np.uint64).reshape(-1, 2)
            for lo, hi in blocks.pieces(offsets):
                h, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                n = np.diff(at)
                d1, d2 = digest[lo:hi].T
                full = np.flatnonzero(n)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                sketch = np.zeros((hi - lo, SKETCH_LONGS + SET_LONGS), np.uint64)
                if len(full):
                    begin = at[full]
                    m = minhashes(h, begin, samples)
                    for band in range(BANDS):
                        key = np.full(len(full), band + 1, np.uint64)
                        for r in range(BAND_ROWS):
                            key = mix(key * blocks._GOLD + m[band * BAND_ROWS + r])
                        bands[full, band] = key
                    for p in range(samples):
                        bit = mix(m[p] + np.uint64(p)) % np.uint64(64 * SKETCH_LONGS)
                        sketch[full, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
                    bit = mix(h + np.uint64(1)) % np.uint64(64 * SET_LONGS)
                    np.bitwise_xor.at(sketch, (np.repeat(np.arange(hi - lo), n), SKETCH_LONGS + (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                longs = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32)), longs(bands.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), longs(d1), longs(d2), lists, *[longs(sketch[:, i]) for i in range(len(_COLUMNS))]], names=["doc_id", "n_shingles", "d1", "d2", "bands", *_COLUMNS])

    return run


def _words(text: bytes | None) -> list[bytes]:
    """The words with A-Z lower-cased; bytes are split at ASCII white space."""
    return (text or b"").lower().split()


def _shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    w = _words(text)
    return {tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k)), strict=False))


def _linked(k: int, percent: int):
    """For mapInArrow over rows (a, __part, b, text) in this order: the text of a stands first, with a null b, and those of its partners follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, {}
        for b in batches:
            out = []
            for a, part, other, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.large_binary()), strict=True):
                if now != (a, part):
                    now, heads = (a, part), {}
                text = text.as_py()
                if other is None:
                    heads[text] = heads.get(text) or _shingles(text, k)  # an id may stand in rows with several texts
                    continue
                own = _shingles(text, k)
                for x in heads.values():
                    both = len(x & own)
                    if 100 * both >= percent * (len(x) + len(own) - both):
                        out.append((a, other))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _differ(x: str, y: str, columns: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in columns), F.lit(0))


def plausible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and set sketches of two rows with prefixes x and y allow the similarity. Both are bounds: no similar pair fails."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    # Sets of n and m elements with similarity J differ in (n + m) (1 - J) / (1 + J) of them.
    apart = (100 + percent) * _differ(x, y, _COLUMNS[SKETCH_LONGS:]) <= (100 - percent) * (n + m)
    return (100 * n >= percent * m) & (100 * m >= percent * n) & apart


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of the (distinct) edges stands in one edge only and is no smaller end."""
    role = lambda x, larger: F.struct(F.col(x).alias("node"), F.lit(larger).alias("larger"))
    of = edges.select(F.inline(F.array(role("a", 0), role("b", 1)))).groupBy("node").agg(F.sum("larger").alias("up"), F.count("*").alias("n"))
    return of.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()[0] == 0


def connect(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached. edges: a, b. Stars are merged until no two of them meet.

    Each round links every node's larger neighbours, then its smaller ones, with
    its smallest; minima are aggregated before they are joined, so a node with
    very many neighbours is no single task's work. Each round is written to the
    checkpoint folder. Edges are made distinct as one column, so that what is written
    has no partitioning by their ends: Spark takes two scans of a table that has one for
    different, and would run a round's exchanges twice.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    edges = cut(edges.filter("a <> b").select(pair(F.least("a", "b"), F.greatest("a", "b")).alias("e")).distinct().select("e.*"))
    while not _are_stars(edges):
        both = edges.select(F.inline(F.array(pair(a, b), pair(b, a))))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(b.alias("a"), m.alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.explode(F.array(pair(m, b), pair(m, a))).alias("e"))
        edges = cut(star.filter("e.a <> e.b").distinct().select("e.*"))
    return edges.select(b.alias("node"), a.alias("component"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives that are similar enough, by the words of their full texts. Not written: to be read once."""
    pairs = cut(pairs)
    pairs = dealt(pairs, hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"]), ["a"], ["b"])
    partners = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "__part", "b", "text")
    heads = pairs.select("a", "__part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "__part", F.lit(None).cast("long").alias("b"), "text")
    order = ["a", "__part", "b"]
    rows = heads.union(partners).repartition("a", "__part").sortWithinPartitions(*order)
    return rows.select(*order, "text").mapInArrow(_linked(k, percent), "a long, b long")


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(docs.mapInArrow(_signatures(k), _SIGNATURE))
    full = sig.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    member = cut(spread_join(full.select("doc_id", "d1", "d2"), classes, ["d1", "d2"], ["doc_id"]).select("doc_id", "rep", "d1", "d2"))
    # Asked of the classes, not of the members that are representatives: for a filter Spark would build Bloom filters in the driver and send them with every task.
    slim = full.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    # Of rows with one doc_id and several texts, each is a representative of its own class.
    reps = slim.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *_COLUMNS, "bands", "d1", "d2").dropDuplicates(["rep", "d1", "d2"])
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n")).filter("hub <> top").select("key", "hub", "n"))
    in_bucket = cut(spread_join(keyed, shared, ["key"], ["rep"]))
    # From here on only classes count that share a bucket.
    some = in_bucket.select("rep").distinct()
    reps = cut(reps.drop("bands", "d1", "d2").join(some, "rep", "left_semi"))
    texts = docs.filter(F.col("doc_id").isNotNull()).join(some.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    texts = cut(texts.filter(F.col("text").rlike(WORD)))
    side = lambda x: reps.select(*[F.col(c).alias(f"{x}{c}" if c != "rep" else x) for c in reps.columns])

    pairs = in_bucket.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(plausible("a", "b", percent)).select("a", "b").distinct()
    # An id that stands in several classes links them.
    ties = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    ties = member.join(ties, "doc_id").filter("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    label = connect(ties.union(_verified(pairs, texts, k, percent)))

    def joined(label: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components when those of ``label`` are linked by the pairs that are similar enough: a star for each stands for all earlier links."""
        return connect(label.select(F.col("component").alias("a"), F.col("node").alias("b")).union(_verified(pairs, texts, k, percent)))

    def undecided(label: DataFrame) -> DataFrame:
        """Of the buckets with more than one component: key, hub, rep, c (component), first (the hub's component), with b and bc drawn from their bucket."""
        of = in_bucket.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "hub", "rep", F.coalesce("component", "rep").alias("c"))
        drawn = F.min_by(F.struct(F.col("rep").alias("b"), F.col("c").alias("bc")), F.xxhash64("rep", "key")).alias("x")
        several = of.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.when(F.col("rep") == F.col("hub"), F.col("c"))).alias("first"), drawn)
        several = cut(several.filter("lo <> hi").select("key", "n", "first", "x.*"))
        return spread_join(of, several, ["key"], ["rep"])

    near = undecided(label).filter("c <> first AND c <> bc").select(F.col("rep").alias("a"), "b").distinct()
    near = near.join(side("a"), "a").join(side("b"), "b").filter(plausible("a", "b", percent)).select("a", "b", _differ("a", "b", _COLUMNS).alias("differ")).distinct()
    nearest = Window.partitionBy("a").orderBy("differ", "b")
    near = near.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= NEAREST).select("a", "b")
    label = joined(label, near)

    rest = cut(undecided(label))
    outside = rest.filter("c <> first")
    # The others of a bucket with very many of them are dealt in parts, and those outside come to each.
    hot = hot_keys(rest.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    others = dealt(rest.select("key", F.col("rep").alias("b"), F.col("c").alias("bc")).join(side("b"), "b"), hot, ["key"], ["b"])
    minor = copied(outside.select("key", F.col("rep").alias("a"), F.col("c").alias("ac")).join(side("a"), "a"), hot, ["key"])
    minor = minor.withColumnsRenamed({"key": "k", "__part": "__p"})
    on = (F.col("k") == F.col("key")) & (F.col("__p") == F.col("__part")) & (F.col("ac") != F.col("bc")) & plausible("a", "b", percent)
    more = minor.join(others, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    label = joined(label, more).withColumnRenamed("node", "rep")

    # A class's representative is its smallest id, so a component's smallest representative is its smallest id.
    of_doc = member.join(label, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sig.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, with all columns; of rows equal in doc_id and text one stays."""

    def stage(docs: DataFrame) -> DataFrame:
        gone = components(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
        marked = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
        left = marked.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
        unknown = left.filter(F.col("doc_id").isNull())
        return left.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "__row"]).union(unknown)

    return guarded(docs, ["doc_id", "text"], stage)
