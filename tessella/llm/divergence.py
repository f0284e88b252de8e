"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are runs of letters (ASCII letters and all other characters), A-Z lower-cased. A language
keeps the terms of at least LEAST_DOCUMENTS of its documents. A group is a (language, source);
its share of a kept term is an integer, 1 + floor(SCALE * (count + 5) / (N + 5 * V)), where N is the
group's number of kept terms' occurrences and V the number of kept terms. Two groups' distance is the sum over all
kept terms of the absolute differences of their shares.

Heavy-light split. Most terms stand in few groups, and a group without a term has one share for all
such terms, its *floor*. So:

- Heavy terms, which more than LIGHT_GROUPS groups of the language have, go through dense numpy tiles
  (a block of terms x two blocks of sources), all pairs of the tile at once.
- Light terms are summed as if of every pair at most one group had the term: from the floors and a
  histogram of each group's shares (few, since counts are small), which needs no term by term
  work. For each pair in a light term's posting list (at most LIGHT_GROUPS^2) a correction puts right
  what this got wrong.

All partial sums are integers and are added exactly.

How it is spread: a task counts the terms of its own documents batch by batch (exact
dictionaries, no hashes) and sends (language, source, term, count, documents) once a batch, so a term
that stands in every document is a row a batch. Counts are summed and written; terms are dealt by
(language, term), tiles by their number, pairs by source. No task holds a language or a source.

Cases: null text, lang and source count as ''; a group without any term, or whose terms are not kept, takes
part with its floor; with V = 0 all distances are 0; a language of one source has no pair; repeated
rows are documents of their own; an empty table gives an empty result; texts are taken whole; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import blocks
from tessella.llm.common import cut, group_join

LEAST_DOCUMENTS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: A term of at most so many groups is light.
LIGHT_GROUPS = 8
#: Sources on each side of a tile, and terms in it.
TILE_SOURCES, TILE_TERMS = 256, 2048
#: Letters as they are, A-Z lower-cased; all else is a blank.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each piece of a batch; a row with an empty term for each group that occurs."""
    for b in batches:
        data, offsets = blocks.buffers(b.column("text"))
        group = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
        names = list(dict.fromkeys(map(lambda g: (g["lang"], g["source"]), group.to_pylist())))
        number = {g: k for k, g in enumerate(names)}
        of = np.array([number[g["lang"], g["source"]] for g in group.to_pylist()], np.int64)
        yield _counted(names, np.arange(len(names)), pa.array([""] * len(names)), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
        for lo, hi in blocks.pieces(offsets, 4 * blocks.PIECE):
            piece, at = LETTER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            texts = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(piece.tobytes())])
            words = pc.split_pattern(texts, b" ")
            coded = words.values.dictionary_encode()
            code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(lo, hi), np.diff(words.offsets.to_numpy()))
            terms = coded.dictionary
            some = code != terms.index(pa.scalar(b"", terms.type)).as_py()
            code, doc = code[some], doc[some]
            if not len(code):
                continue
            width = len(terms)
            in_doc, times = np.unique(doc * width + code, return_counts=True)
            key = of[in_doc // width] * width + in_doc % width
            order, begin = blocks.groups(key)
            one = key[order[begin]]
            yield _counted(names, one // width, terms.take(pa.array(one % width)).cast(pa.binary()).cast(pa.string()), np.add.reduceat(times[order], begin), np.diff(np.append(begin, len(key))))


def _counted(names: list[tuple], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    column = lambda i: pa.array([x[i] for x in names], pa.string()).take(pa.array(group))
    return pa.RecordBatch.from_arrays([column(0), column(1), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, kept: Column) -> Column:
    """The exact share of a count; the product may exceed 64 bits."""
    return F.call_function("div", (n + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE), (total + SMOOTH * kept).cast("decimal(19,0)")).cast("long") + 1


def kept_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, all_n, groups) of the kept terms, all_n and groups over the whole language; (lang, source, i, of, total, kept, floor, n) of every group: its number i of ``of`` in the language, N and V."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counts = rows.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = counts.withColumns({"all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term), "groups": F.count("*").over(term)})
    every = cut(every.filter((F.col("term") == "") | (F.col("all_docs") >= LEAST_DOCUMENTS)).drop("docs", "all_docs"))
    kept = every.filter("term <> ''")
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    groups = every.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("term") != "").cast("long")).alias("n"))
    groups = groups.join(vocabulary, "lang", "left").withColumn("kept", F.coalesce("v", F.lit(0).cast("long"))).drop("v")
    numbered = Window.partitionBy("lang")
    groups = groups.withColumns({"i": F.row_number().over(numbered.orderBy("source")) - 1, "of": F.count("*").over(numbered).cast("int")})
    return kept, cut(groups.withColumn("floor", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(0)))


def _shared(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The kept terms' rows with p, their share, and i, of, floor of the group."""
    rows = group_join(kept.withColumnRenamed("n", "times"), groups, ["lang", "source"], ["term"])
    return rows.withColumn("p", share(F.col("times"), F.col("total"), F.col("kept"))).withColumnRenamed("times", "n")


# Distances of pairs

_PAIR = "lang string, i int, j int, value long"
_pair_names = ["lang", "i", "j", "value"]


def _pairs_of(lang: str, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value.astype(np.int64))], names=_pair_names)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each posting list of a light term (lang, i, p, floor: arrays by group), for every pair in it: the true difference less what the histograms say. Summed over a batch."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        i, p, floor = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("i", "p", "floor"))
        size = pc.list_value_length(b.column("i")).to_numpy().astype(np.int64)
        begin = np.cumsum(size) - size
        a, z = [], []
        for step in range(1, int(size.max(initial=0))):  # pairs that stand so far apart in their list
            n = np.maximum(size - step, 0)
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            a.append(at)
            z.append(at + step)
        if not a or not sum(map(len, a)):
            continue
        a, z = np.concatenate(a), np.concatenate(z)
        row = np.repeat(np.arange(len(size)), size)[a]
        value = np.abs(p[a] - p[z]) - np.abs(p[a] - floor[z]) - np.abs(floor[a] - p[z]) + np.abs(floor[a] - floor[z])
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero((langs == lang)[row])
            key = i[a[own]] << 32 | i[z[own]]
            order, start = blocks.groups(key)
            if len(start):
                one = key[order[start]]
                yield _pairs_of(lang, one >> 32, one & 0xFFFFFFFF, np.add.reduceat(value[own][order], start))


def _light(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a pair of blocks of groups (side 0 or 1, i, floor, times: the number of light terms, shares and how many terms have each): the light terms' sum for every pair, as if no term stood in both groups."""
    lang, a, b = (k.as_py() for k in key[:3])
    side = [rows.filter(pc.equal(rows.column("side"), s)).sort_by("i").to_pylist() for s in ((0, 1) if a != b else (0, 0))]
    floors = [np.array([r["floor"] for r in s], np.int64) for s in side]
    number = [np.array([r["i"] for r in s], np.int64) for s in side]
    light = side[0][0]["light"]

    def excess(r: dict, other: np.ndarray) -> np.ndarray:
        """Sum over the group's own light terms of |p - floor of the other| - |floor - floor of the other|."""
        p, k = np.array([x["p"] for x in r["shares"] or ()], np.int64), np.array([x["k"] for x in r["shares"] or ()], np.int64)
        return (np.abs(p[:, None] - other[None, :]) * k[:, None]).sum(0) - np.abs(r["floor"] - other) * k.sum()

    value = light * np.abs(floors[0][:, None] - floors[1][None, :])
    value += np.array([excess(r, floors[1]) for r in side[0]]).reshape(value.shape)
    value += np.array([excess(r, floors[0]) for r in side[1]]).reshape(value.shape[::-1]).T
    x, y = np.nonzero(number[0][:, None] < number[1][None, :])
    return pa.Table.from_batches([_pairs_of(lang, number[0][x], number[1][y], value[x, y])])


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a tile (rows: side, i, term, p less the group's floor; and with a null term each group's floor): the sum of differences of every pair."""
    lang, a, b = (k.as_py() for k in key[:3])
    side, i, floor = rows.column("side").to_numpy(), rows.column("i").to_numpy(), rows.column("floor").to_numpy()
    more = rows.column("more").to_numpy()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    code = terms.indices.fill_null(-1).to_numpy()
    dense, number = [], []
    for s in (0, 1) if a != b else (0, 0):
        own = np.flatnonzero((side == s) & (code < 0))
        own = own[np.argsort(i[own])]
        number.append(i[own].astype(np.int64))
        d = np.repeat(floor[own][:, None], len(terms.dictionary), 1)
        has = np.flatnonzero((side == s) & (code >= 0))
        d[np.searchsorted(number[-1], i[has]), code[has]] += more[has]
        dense.append(d)
    value = np.array([np.abs(dense[1] - row).sum(1) for row in dense[0]], np.int64).reshape(len(dense[0]), len(dense[1]))
    x, y = np.nonzero(number[0][:, None] < number[1][None, :])
    return pa.Table.from_batches([_pairs_of(lang, number[0][x], number[1][y], value[x, y])])


def _sided(rows: DataFrame) -> DataFrame:
    """The rows (lang, i, of, ...) in every pair of blocks of sources a <= b that their group belongs to, with side: 0 in a, 1 in b."""
    own = F.floor(F.col("i") / TILE_SOURCES).cast("int")
    every = F.sequence(F.lit(0), F.floor((F.col("of") - 1) / TILE_SOURCES).cast("int"))
    place = F.transform(every, lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"), (x < own).cast("int").alias("side")))
    return rows.select("*", F.explode(place).alias("__x")).select(*rows.columns, "__x.a", "__x.b", "__x.side")


def distances(kept: DataFrame, groups: DataFrame, light_groups: int = LIGHT_GROUPS) -> DataFrame:
    """lang, i, j, value: the distance of every pair of groups i < j of a language."""
    rows = _shared(kept, groups).select("lang", "term", "i", "of", "p", "floor", "groups")
    heavy, light = rows.filter(F.col("groups") > light_groups), rows.filter(F.col("groups") <= light_groups)
    lists = light.filter("groups > 1").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("i", "p", "floor"))).alias("x")).select("lang", "x.i", "x.p", "x.floor")
    corrections = lists.mapInArrow(_corrections, _PAIR)

    number = light.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("light"))
    shares = light.groupBy("lang", "i", "p").agg(F.count("*").alias("k")).groupBy("lang", "i").agg(F.collect_list(F.struct("p", "k")).alias("shares"))
    base = groups.select("lang", "i", "of", "floor").join(number, "lang", "left").join(shares, ["lang", "i"], "left").withColumn("light", F.coalesce("light", F.lit(0).cast("long")))
    lights = _sided(base).groupBy("lang", "a", "b").applyInArrow(_light, _PAIR)

    tiles = F.pmod(F.xxhash64("term"), F.greatest(F.floor(F.col("heavy") / TILE_TERMS), F.lit(1))).cast("int")
    many = heavy.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("heavy"))
    many = F.broadcast(many) if many.count() <= 50_000 else many
    dense = heavy.join(many, "lang").select("lang", "i", "of", "floor", "term", (F.col("p") - F.col("floor")).alias("more"), tiles.alias("tile"))
    floors = groups.join(many, "lang").select("lang", "i", "of", "floor", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("more"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("heavy") / TILE_TERMS), F.lit(1)).cast("int") - 1)).alias("tile"))
    tiled = _sided(dense.unionByName(floors)).groupBy("lang", "a", "b", "tile").applyInArrow(_tile, _PAIR)
    return corrections.union(lights).union(tiled).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS, light_groups: int = LIGHT_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank. part pair: the language's other sources by distance; part term: the terms that the group has more of than the language, by the difference of the shares, up to ``top``."""
    kept, groups = kept_terms(docs)
    near = distances(kept, groups, light_groups)
    both = near.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x"), "value").select("lang", "x.*", "value")
    name = lambda n, as_: groups.select("lang", F.col("i").alias(n), F.col("source").alias(as_))
    pairs = both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    language = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n"))
    rows = group_join(_shared(kept, groups).select("lang", "source", "term", "p", "all_n", "kept"), cut(language), ["lang"], ["term", "source"])
    q = share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
