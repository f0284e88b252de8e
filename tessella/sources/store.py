"""The persisted index: a log of sorted segments.

A write makes a segment, a folder with one file set per table, and then one entry of the
log, which lists the segments that count from then on. An entry's file must not exist before: of two
writers that start from the same entry one is refused. So readers never see half a write, and a
job that fails leaves the log alone and may simply run again.

An update writes what changed and no more: the new rows of its paths, the paths themselves
(``gone``), and for the counts (vocabulary, trigrams, word forms) new minus old, the old ones from
the replaced texts. A reader leaves out rows whose path a later segment names, and adds the counts
up. When FANOUT segments of one size have gathered, they are merged into one, so there are
few of them after any number of updates, and a table is one scan whatever their number.

In a segment a table is dealt to parts: by ranges of its key, with the bounds in the log (a key
with more rows than a part holds is dealt over several by path), or by a hash of the path. Inside a
part rows are sorted by key, in small pages, front-coded. ``Index.pick`` and ``Index.starting``
read only the parts, and for few keys only the pages, that may hold the keys asked for.
The postings of trigrams, by far the largest table, are not dealt at all: they lie where their texts
were read, in runs of some documents that are sorted by trigram, so of every file some pages are read.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import index as ix

#: The key that each stored table is sorted by; path: dealt by hash.
KEYS = {"file": "path", "text": "path", "word_posting": "word", "trigram_posting": "gram", "vocab": "term", "gram_count": "gram", "word_form": "term", "gone": "path"}
#: Counts, kept as sums of what each segment adds: their keys, and the count that says whether a key is there.
SUMS = {"vocab": (["term"], "doc_cnt", "cnt"), "gram_count": (["gram"], "df"), "word_form": (["term", "word"], "n")}
_SCHEMAS = {
    "file": "path string, mtime long, n_grams long", "text": "path string, mtime long, text string", "word_posting": "path string, word string", "trigram_posting": "gram string, path string, at binary",
    "vocab": "term string, doc_cnt long, cnt long", "gram_count": "gram string, df long", "word_form": "term string, word string, n long", "gone": "path string",
}
#: Text of a part, about; segments of one size that are merged; log entries that are kept for running readers.
PART_BYTES, FANOUT, KEPT = 16 << 20, 4, 2
#: Documents from which the bounds of the parts are taken.
BOUND_DOCS = 500
#: So many keys are looked for page by page.
FEW_KEYS = 200
_LAST = "\U0010ffff"
#: Postings that are packed together on their way to their part.
BLOCK_ROWS = 500_000
_LAYOUT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.page.row.count.limit": "2000", **{f"parquet.enable.dictionary#{c}": "false" for c in ("path", "term", "word", "at")}}


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Only a local session may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.gettempdir() + '/tessella'}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and read from there: computed once, and not again when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


# The log


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another one when it was written anew."""
    fs, p = _folder(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))

def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []


def _entry(spark: SparkSession, index_dir: str, name: str) -> dict:
    fs, p = _folder(spark, f"{index_dir}/log/{name}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def log(spark: SparkSession, index_dir: str) -> dict:
    """The last entry: seq, folded, segments (oldest first; id, seq, docs and for each table its parts and bounds)."""
    names = [n for n in _children(spark, f"{index_dir}/log") if n.endswith(".json")]
    return _entry(spark, index_dir, names[-1]) if names else {"seq": 0, "folded": True, "segments": []}


def _commit(spark: SparkSession, index_dir: str, entry: dict) -> str:
    """Adds the entry; raises if another writer has added one with its number."""
    fs, p = _folder(spark, f"{index_dir}/log/{entry['seq']:012d}.json")
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
    names = _children(spark, f"{index_dir}/log")
    kept = {s["id"] for n in names[-KEPT:] for s in _entry(spark, index_dir, n)["segments"]}
    for n in names[:-KEPT]:
        for s in _entry(spark, index_dir, n)["segments"]:
            if s["id"] not in kept:
                _remove(spark, f"{index_dir}/segments/{s['id']}")
        _remove(spark, f"{index_dir}/log/{n}")
    return str(entry["seq"])


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


# Segments


def _bounds(weights: list[tuple[str, int]], parts: int) -> list[str]:
    """Keys that cut the sorted keys in parts of about equal weight; a heavy key may stand several times."""
    rows = sorted(w for w in weights if w[0] is not None)
    if parts < 2 or not rows:
        return []
    upto = np.cumsum([n for _, n in rows])
    return [rows[int(np.searchsorted(upto, upto[-1] * k / parts, "right"))][0] if upto[-1] * k / parts < upto[-1] else rows[-1][0] for k in range(1, parts)]


def _part_of(key: str, bounds: list[str], spread: Column) -> Column:
    """The part of each row of a range-dealt table; spread: a number that deals the rows of a key in several parts."""
    edges = np.array(bounds, object)

    @F.pandas_udf("int")
    def part(keys: pd.Series, spread: pd.Series) -> pd.Series:
        codes, own = pd.factorize(keys)
        own = np.asarray(own, object)
        lo, hi = np.searchsorted(edges, own, "left"), np.searchsorted(edges, own, "right")
        return pd.Series(lo[codes] + spread.to_numpy() % (hi - lo + 1)[codes])

    return part(F.col(key), spread)


def _dealt_in_blocks(table: DataFrame, parts: int, bounds: list[str]) -> DataFrame:
    """path, word, part of postings (path, word), each row at its part. They travel sorted and packed: a path and a word stand once in a block, and blocks are compressed."""
    edges = np.array(bounds, object)

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.Table.from_batches(rows)
        word, path = (one[c].combine_chunks().dictionary_encode("encode") for c in ("word", "path"))
        names, codes = [], []
        for x in (word, path):  # codes follow the order of the strings
            own = np.array(x.dictionary.to_pylist(), object)
            by = np.argsort(np.array([k or "" for k in own], object), kind="stable")  # a path may be null
            rank = np.empty(len(own), np.int64)
            rank[by] = np.arange(len(own))
            names.append(own[by])
            codes.append(rank[x.indices.to_numpy()])
        lo, hi = np.searchsorted(edges, names[0], "left"), np.searchsorted(edges, names[0], "right")
        part = lo[codes[0]] + one["spread"].to_numpy() % (hi - lo + 1)[codes[0]]
        order = np.lexsort((codes[1], codes[0], part))
        part, codes = part[order], [c[order] for c in codes]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for a, z in zip(begin, [*begin[1:], len(part)], strict=True):
            columns = []
            for own, c in zip(names, codes, strict=True):
                used, which = np.unique(c[a:z], return_inverse=True)
                columns.append(pa.DictionaryArray.from_arrays(pa.array(which.astype(np.int32)), pa.array(own[used], pa.string())))
            b, sink = pa.RecordBatch.from_arrays(columns, names=["word", "path"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield from block(held)
                held = []
        if held:
            yield from block(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in zip(b.column("part").to_pylist(), b.column("rows"), strict=True):
                for own in pa.ipc.open_stream(rows.as_buffer()):
                    word, path = (own.column(c).dictionary_decode() for c in ("word", "path"))
                    yield pa.RecordBatch.from_arrays([path, word, pa.array(np.full(len(own), part, np.int32))], names=["path", "word", "part"])

    spread = F.pmod(F.xxhash64("path"), F.lit(1 << 20)).alias("spread")
    blocks = table.select("path", "word", spread).mapInArrow(pack, "part int, rows binary").repartitionById(parts, F.col("part"))
    return blocks.mapInArrow(unpack, "path string, word string, part int")


def _write(table: DataFrame, at: str, name: str, seq: int, parts: int, bounds: list[str]) -> None:
    key = KEYS[name]
    if name == "trigram_posting":  # in sorted runs, as they were made
        table = table if parts > 1 else table.coalesce(1)
        table.select("gram", "path", "at", F.lit(seq).cast("long").alias("seq")).write.options(**_LAYOUT).mode("overwrite").parquet(f"{at}/{name}/part=0")
        return
    table = table.select(*[c.split()[0] for c in _SCHEMAS[name].split(", ")])
    if parts < 2:
        table = table.withColumn("part", F.lit(0)).coalesce(1)
    elif name == "word_posting":
        table = _dealt_in_blocks(table, parts, bounds)
    else:  # a count stands once
        part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int") if key == "path" else _part_of(key, bounds, F.lit(0).cast("long"))
        table = table.withColumn("part", part).repartitionById(parts, F.col("part"))
    table = table.withColumn("seq", F.lit(seq).cast("long"))
    table.sortWithinPartitions("part", key, *(["path"] if "path" in table.columns and key != "path" else [])).write.options(**_LAYOUT).partitionBy("part").mode("overwrite").parquet(f"{at}/{name}")


def _scan(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    schema = _SCHEMAS[name] + ", seq long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _segment(spark: SparkSession, index_dir: str, tables: dict[str, DataFrame], seq: int, parts: int, bounds: dict[str, list[str]], docs: int, found: str | None = None) -> dict:
    """Writes the tables, several at a time, so that the tail of one does not hold up the next; returns the log's line."""
    name = found or uuid.uuid4().hex
    at = f"{index_dir}/segments/{name}"
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(_write, t, at, k, seq, parts, bounds.get(k, [])) for k, t in tables.items()]:
            done.result()
    line = {"id": name, "seq": seq, "docs": docs, "parts": dict.fromkeys(KEYS, parts), "bounds": bounds, "held": {}}
    for k in KEYS:
        line["held"][k] = sorted(int(c.split("=")[1]) for c in _children(spark, f"{at}/{k}") if c.startswith("part="))
    return line


class Index(Mapping):
    """The tables of an index by name, as ``ix.build_index`` has them, of the segments of one log entry."""

    def __init__(self, spark: SparkSession, index_dir: str, entry: dict):
        self.spark, self.index_dir, self.entry = spark, index_dir, entry

    def __iter__(self) -> Iterator[str]:
        return iter(["file", "text", "word_posting", "term_posting", "trigram_posting", "doc_len", "vocab", "gram_count", "word_form"])

    def __len__(self) -> int:
        return 9

    def __getitem__(self, name: str) -> DataFrame:
        if name not in list(self):
            raise KeyError(name)
        return self._shown(name, self._live(self._stored(name)))

    @staticmethod
    def _stored(name: str) -> str:
        return {"doc_len": "file", "term_posting": "text"}.get(name, name)

    def _shown(self, name: str, table: DataFrame) -> DataFrame:
        """A table as it is given out: from the stored one that it is made of."""
        if name == "file":
            return table.select("path", "mtime")
        if name == "doc_len":
            return table.select("path", "n_grams")
        if name == "text":
            return table.select("path", "text")
        if name == "word_posting":
            return table.select("path", "word", F.lower("word").alias("word_lower"))
        if name == "trigram_posting":
            return table.select("gram", "path", ix.unpacked("at").alias("at"))
        if name == "term_posting":
            return ix.build_term_postings(table, self.entry["folded"])
        return table

    def paths_of(self, name: str, parts: dict[int, list[int]] | None = None) -> list[str]:
        """Folders of a stored table's parts; parts: by the segment's number, all if None."""
        return [f"{self.index_dir}/segments/{s['id']}/{name}/part={p}" for k, s in enumerate(self.entry["segments"]) for p in (s["held"][name] if parts is None else parts.get(k, [])) if p in s["held"][name]]

    def _live(self, name: str, paths: list[str] | None = None, only: Column | None = None) -> DataFrame:
        """The rows that count: added up, or those that no later segment replaces."""
        table = _scan(self.spark, name, self.paths_of(name) if paths is None else paths)
        table = table if only is None else table.filter(only)
        if name in SUMS:
            keys, there, *more = SUMS[name]
            return table.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in (there, *more)]).filter(F.col(there) > 0)
        gone = self.paths_of("gone")
        if gone:
            last = _scan(self.spark, "gone", gone).groupBy("path").agg(F.max("seq").alias("__seq"))
            table = table.join(last, "path", "left").filter(F.col("__seq").isNull() | (F.col("__seq") <= F.col("seq"))).drop("__seq")
        return table.drop("seq")

    def parts_of(self, name: str, keys: DataFrame, prefix: bool = False) -> dict[int, list[int]]:
        """Which parts of which segments may hold one of the keys (the only column). At most all parts come to the driver."""
        key, segments = KEYS[name], self.entry["segments"]
        if key == "path":
            ways = [F.struct(F.lit(k).alias("k"), F.pmod(F.xxhash64("path"), F.lit(s["parts"][name])).cast("int").alias("p")) for k, s in enumerate(segments)]
            found = keys.toDF("path").select(F.explode(F.array(*ways)).alias("x")).select("x.*").distinct()
        else:
            edges = [np.array(s["bounds"].get(name, []), object) for s in segments]

            def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    own = np.array([x for x in b.column(0).to_pylist() if x is not None], object)
                    pairs = set()
                    for k, e in enumerate(edges):
                        lo, hi = np.searchsorted(e, own, "left"), np.searchsorted(e, own + _LAST if prefix and len(own) else own, "right")
                        pairs |= {(k, p) for a, z in set(zip(lo.tolist(), hi.tolist(), strict=True)) for p in range(a, z + 1)}
                    rows = sorted(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.int32())], names=["k", "p"])

            found = keys.mapInArrow(which, "k int, p int").distinct()
        out: dict[int, list[int]] = {}
        for r in found.collect():
            out.setdefault(r["k"], []).append(r["p"])
        return out

    def pick(self, name: str, keys: DataFrame) -> DataFrame:
        """The table's rows with one of the keys (the only column), and perhaps others: from the parts, and for few keys the pages, that may hold them."""
        stored, key = self._stored(name), KEYS[self._stored(name)]
        few = [r[0] for r in keys.distinct().limit(FEW_KEYS + 1).collect()]
        only = None
        if len(few) <= FEW_KEYS:
            tests = [F.col(key) == F.lit(x) for x in sorted(x for x in few if x is not None)] or [F.lit(False)]
            while len(tests) > 1:  # a balanced tree of equalities, which the reader tests against the pages' bounds
                tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
            only = tests[0]
        return self._shown(name, self._live(stored, self.paths_of(stored, self.parts_of(stored, keys)), only))

    def starting(self, name: str, prefixes: DataFrame) -> DataFrame:
        """The rows of vocab or word_form whose term starts with one of the prefixes (the only column), and perhaps others."""
        few = [r[0] for r in prefixes.distinct().limit(FEW_KEYS + 1).collect()]
        only = None
        if len(few) <= FEW_KEYS:
            tests = [(F.col("term") >= F.lit(x)) & (F.col("term") < F.lit(x + _LAST)) for x in sorted(x for x in few if x is not None)] or [F.lit(False)]
            while len(tests) > 1:
                tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
            only = tests[0]
        return self._live(name, self.paths_of(name, self.parts_of(name, prefixes, True)), only)


def _made(docs: DataFrame, folded: bool) -> dict[str, DataFrame]:
    """The stored tables of written documents, but for text and what is counted from other tables."""
    return {"file": docs.select("path", "mtime", ix.length_in_grams().alias("n_grams")), "word_posting": ix.build_postings(docs), "trigram_posting": ix.build_positions(docs, pack=True), "vocab": ix.count_terms(docs, folded)}


def _cuts(docs: DataFrame, parts: int, count: int, folded: bool) -> dict[str, list[str]]:
    """Bounds of the range-dealt tables, from some documents."""
    if parts < 2:
        return {}
    some = materialized(docs.filter(F.pmod(F.xxhash64("path"), F.lit(max(1, count // BOUND_DOCS))) == 0).select("path", "text"))
    weigh = lambda df, key: [(r[0], r[1]) for r in df.groupBy(key).count().collect()]
    grams, words, terms = weigh(ix.build_trigrams(some), "gram"), weigh(ix.build_postings(some), "word"), weigh(ix.count_terms(some, folded), "term")
    # A count has one row a key.
    single = lambda rows: _bounds([(k, 1) for k, _ in rows], parts)
    return {"word_posting": _bounds(words, parts), "vocab": single(terms), "gram_count": single(grams), "word_form": single([(w.lower(), 1) for w, _ in words])}


def write_index(docs: DataFrame, index_dir: str, folded: bool = True, parts: int | None = None) -> str:
    """Writes an index anew from docs (path, mtime, text); returns its version. The texts are written first and the rest is made from them, so docs are read once.

    parts: of each table; by default spark.sql.shuffle.partitions for the texts, and for the others by the texts' bytes.
    """
    spark = docs.sparkSession
    seq, name = log(spark, index_dir)["seq"] + 1, uuid.uuid4().hex
    at = f"{index_dir}/segments/{name}"
    first = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(docs, at, "text", seq, first, [])
    fs, p = _folder(spark, f"{at}/text")
    parts = parts or max(8, int(fs.getContentSummary(p).getLength()) // PART_BYTES)
    kept = _scan(spark, "text", [f"{at}/text"])
    count = kept.count()
    bounds = _cuts(kept, parts, count, folded)
    _segment(spark, index_dir, _made(kept, folded), seq, parts, bounds, count, name)
    counts = {"gram_count": ix.build_gram_counts(_scan(spark, "trigram_posting", [f"{at}/trigram_posting"])), "word_form": ix.build_forms(_scan(spark, "word_posting", [f"{at}/word_posting"]))}
    line = _segment(spark, index_dir, counts, seq, parts, bounds, count, name)
    line["parts"]["text"] = first
    return _commit(spark, index_dir, {"seq": seq, "folded": folded, "segments": [line]})


def _less(new: DataFrame, old: DataFrame, name: str) -> DataFrame:
    """What the counts change by."""
    keys, *counts = SUMS[name]
    both = new.select(*keys, *counts).unionByName(old.select(*keys, *[(-F.col(c)).alias(c) for c in counts]))
    return _changes(both, name)


def _changes(table: DataFrame, name: str) -> DataFrame:
    keys, *counts = SUMS[name]
    return table.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counts]).filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in counts]))


def update_index(spark: SparkSession, index_dir: str, docs: DataFrame, gone: DataFrame) -> str | None:
    """Puts docs (path, mtime, text) in place of what stands under their paths and takes out the paths of ``gone``; what is written follows these texts and those they replace, not the index.

    Returns the version, or None if there was nothing to do. Doing it twice changes nothing more.
    """
    entry = log(spark, index_dir)
    index, seq, folded = Index(spark, index_dir, entry), entry["seq"] + 1, entry["folded"]
    docs = materialized(docs.select("path", "mtime", "text"))
    paths = materialized(docs.select("path").union(gone.select("path")).distinct())
    old = materialized(index.pick("text", paths).join(paths, "path", "left_semi"))
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    replaced = old.count()
    if not count and not replaced:
        return None
    parts = max(1, size // PART_BYTES)
    counts = {
        "vocab": _less(ix.count_terms(docs, folded), ix.count_terms(old, folded), "vocab"),
        "gram_count": _less(ix.build_gram_counts(ix.build_trigrams(docs)), ix.build_gram_counts(ix.build_trigrams(old)), "gram_count"),
        "word_form": _less(ix.build_forms(ix.build_postings(docs)), ix.build_forms(ix.build_postings(old)), "word_form"),
    }
    tables = {"text": docs, **_made(docs, folded), **counts, "gone": old.select("path")}
    line = _segment(spark, index_dir, tables, seq, parts, _cuts(docs, parts, count, folded), count + replaced)
    segments = _merged(spark, index_dir, [*entry["segments"], line], folded)
    if line not in segments:
        _remove(spark, f"{index_dir}/segments/{line['id']}")  # no entry ever names it
    return _commit(spark, index_dir, {"seq": seq, "folded": folded, "segments": segments})


def _tier(segment: dict) -> int:
    return int(np.log(max(1, segment["docs"])) / np.log(FANOUT) + 1e-9)


def _merged(spark: SparkSession, index_dir: str, segments: list[dict], folded: bool) -> list[dict]:
    """The segments, of which the last ones of no larger size than the last are one where there are FANOUT of them."""
    known = {s["id"] for s in segments}
    while True:
        n = 0
        while n < len(segments) and _tier(segments[-1 - n]) <= _tier(segments[-1]):
            n += 1
        if n < FANOUT:
            return segments
        whole, run = n == len(segments), segments[-n:]
        own = Index(spark, index_dir, {"segments": run, "folded": folded})
        model = max(run, key=lambda s: s["docs"])
        tables = {k: own._live(k) for k in KEYS if k not in SUMS and k != "gone"}
        tables["trigram_posting"] = tables["trigram_posting"].repartition(max(model["parts"].values()), "path").sortWithinPartitions("gram", "path")
        tables |= {k: _changes(_scan(spark, k, own.paths_of(k)), k) for k in SUMS}
        gone = _scan(spark, "gone", own.paths_of("gone")).select("path").distinct()
        if not whole:
            tables["gone"] = gone
        docs = tables["file"].count() + (0 if whole else gone.count())
        line = _segment(spark, index_dir, tables, run[-1]["seq"], max(model["parts"].values()), model["bounds"], docs)
        for s in run:
            if s["id"] not in known:
                _remove(spark, f"{index_dir}/segments/{s['id']}")
        segments = [*segments[:-n], line]


def read_index(spark: SparkSession, index_dir: str) -> Index:
    return Index(spark, index_dir, log(spark, index_dir))


def read_meta(spark: SparkSession, index_dir: str) -> DataFrame:
    """path, mtime of the stored files; no text is read."""
    return read_index(spark, index_dir)["file"]
