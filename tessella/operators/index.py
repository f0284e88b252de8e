"""The index tables, built from documents (path, text), and their upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessella.functions.text import GRAM, exploded, fold, folded_term, gram_count, raw_terms, trigrams, words

MIN_WORD = 3


def build_postings(docs: DataFrame) -> DataFrame:
    """path, word, word_lower: the distinct words of each document, from three characters. Distinct inside the row, so nothing is shuffled."""
    own = F.filter(F.array_distinct(words(F.col("text"))), lambda w: F.length(w) >= MIN_WORD)
    return exploded(docs, ["path"], own, "word").withColumn("word_lower", F.lower("word"))


def build_term_postings(docs: DataFrame, folded: bool = True) -> DataFrame:
    """path, term, n. folded: terms without diacritics; otherwise lower-case words of three characters or more."""
    n = exploded(docs, ["path"], _terms(folded), "term").groupBy("path", "term").agg(F.count("*").alias("n"))
    return fold(n, "term").groupBy("path", "term").agg(F.sum("n").alias("n")) if folded else n


def _terms(folded: bool) -> Column:
    return raw_terms(F.col("text")) if folded else F.filter(F.transform(words(F.col("text")), lambda w: F.lower(w)), lambda w: F.length(w) >= MIN_WORD)


def count_terms(docs: DataFrame, folded: bool = True) -> DataFrame:
    """term, doc_cnt, cnt: ``build_vocab`` of ``build_term_postings`` in one step. Terms are folded and counted inside a batch of documents, so only partial sums by term are shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            terms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            if folded:
                one = pa.array([x if x.isascii() else folded_term(x) for x in terms], pa.string()).dictionary_encode()
                terms, code = one.dictionary.to_pylist(), one.indices.to_numpy().astype(np.int64)[code]
            in_doc = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * len(terms) + code)
            n = lambda x: pa.array(np.bincount(x, minlength=len(terms)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), n(in_doc % len(terms)), n(code)], names=["term", "doc_cnt", "cnt"])

    parts = docs.select(_terms(folded).alias("terms")).mapInArrow(partial, "term string, doc_cnt long, cnt long")
    return parts.groupBy("term").agg(F.sum("doc_cnt").alias("doc_cnt"), F.sum("cnt").alias("cnt"))


def build_forms(word_postings: DataFrame) -> DataFrame:
    """term, word, n: the spellings of each lower-case word, and in how many documents each stands."""
    return word_postings.groupBy("word").agg(F.count("*").alias("n")).select(F.lower("word").alias("term"), "word", "n")


def build_vocab(term_postings: DataFrame) -> DataFrame:
    """term, doc_cnt, cnt. One row per document and term comes in, so a count of rows counts documents."""
    return term_postings.groupBy("term").agg(F.count("*").alias("doc_cnt"), F.sum("n").cast("long").alias("cnt"))


def build_trigrams(docs: DataFrame) -> DataFrame:
    """gram, path: distinct in each document."""
    return exploded(docs, ["path"], F.array_distinct(trigrams(F.col("text"))), "gram").select("gram", "path")


#: Characters that are worked on at once.
_PIECE = 1 << 20


def leb(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, low ones first; the top bit says that another follows. Also where each begins, and the end."""
    n = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, int(values.max(initial=0)).bit_length() // 7 + 1))
    n = np.broadcast_to(n, values.shape)
    at = np.append(0, np.cumsum(n))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        more = n > k
        out[at[:-1][more] + k] = (values[more] >> 7 * k & 127) | (n[more] > k + 1) << 7
    return out, at


def unleb(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and how many of them end before each byte."""
    last = data < 128
    ended = np.append(0, np.cumsum(last))
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1) if len(data) else np.zeros(0, np.int64)
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, begin) if len(data) else np.zeros(0, np.int64), ended


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Pieces of the bytes, from each place to the next."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def pieces(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row begins in them, and the end."""
    array = array.cast(pa.binary())
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]] if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def gaps(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of rising places, in lists that begin at the edges, the distances; a list's first place stands as it is. No list is empty."""
    out = np.diff(at, prepend=0)
    out[edges[:-1]] = at[edges[:-1]]
    return out


def ungaps(own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(own))
    return upto[1:] - np.repeat(upto[edges[:-1]], np.diff(edges))


def packed(at: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Lists of places in some 1.5 bytes a place."""
    data, begin = leb(gaps(at, edges))
    return binaries(data, begin[edges])


@F.arrow_udf(ArrayType(IntegerType()))
def unpacked(column: pa.Array) -> pa.Array:
    """The lists of ``packed``."""
    data, begin = pieces(column)
    own, ended = unleb(data)
    edges = ended[begin]
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ungaps(own, edges).astype(np.int32)))


def _positions(batches: Iterator[pa.RecordBatch], pack: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, paths, lo = b.column("low").to_pylist(), b.column("path"), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _PIECE):
                size += len(texts[hi])
                hi += 1
            code = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            n = np.array([len(t) for t in texts[lo:hi]], np.int64)
            grams = np.maximum(n - (GRAM - 1), 0)
            at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
            start = np.repeat(np.cumsum(n) - n, grams) + at
            doc = np.repeat(np.arange(lo, hi), grams)
            lo = hi
            if not len(start):
                continue
            key = code[start] << 42 | code[start + 1] << 21 | code[start + 2]
            order = np.argsort(key, kind="stable")  # documents and places are in order already
            key, doc, at = key[order], doc[order], at[order]
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            own, which = np.unique(key[begin], return_inverse=True)
            names = pa.array(["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in own.tolist()], pa.string())
            for part in range(0, len(begin), 200_000):
                some = slice(part, part + 200_000)
                edges = np.append(begin, len(at))[part : part + 200_001]
                own, edges = at[edges[0] : edges[-1]], edges - edges[0]
                lists = packed(own, edges) if pack else pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which[some])), paths.take(pa.array(doc[begin[some]])), lists], names=["gram", "path", "at"])


def build_positions(docs: DataFrame, pack: bool = False) -> DataFrame:
    """gram, path, at: where each lower-case trigram of a document begins, in order. Grouped inside the document, so nothing is shuffled.

    The rows come in runs, each of some documents and sorted by gram. pack: ``at`` in the bytes of ``packed``.
    """
    return docs.select("path", F.lower(F.coalesce("text", F.lit(""))).alias("low")).mapInArrow(partial(_positions, pack=pack), f"gram string, path string, at {'binary' if pack else 'array<int>'}")


def build_gram_counts(trigram_postings: DataFrame) -> DataFrame:
    """gram, df: the number of documents that have it."""
    return trigram_postings.groupBy("gram").agg(F.count("*").alias("df"))


def length_in_grams() -> Column:
    return gram_count(F.col("text"))


def build_lengths(docs: DataFrame) -> DataFrame:
    """path, n_grams: trigrams of each document, repeats counted."""
    return docs.select("path", length_in_grams().alias("n_grams"))


def delete_paths(index: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these paths; the counts, if they are there, are made anew from what is left of the postings."""
    gone = paths.select("path").distinct()
    return _counted({k: t.join(gone, "path", "left_anti").select(*t.columns) for k, t in index.items() if k not in COUNTS}, index)


#: Tables that are sums over another one.
COUNTS = {"vocab": ("term_posting", build_vocab), "gram_count": ("trigram_posting", build_gram_counts), "word_form": ("word_posting", build_forms)}


def _counted(tables: dict[str, DataFrame], like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return tables | {k: count(tables[of]) for k, (of, count) in COUNTS.items() if k in like}


def build_index(docs: DataFrame, folded: bool = True) -> dict[str, DataFrame]:
    """docs: path, mtime, text. folded: whether terms lose their diacritics."""
    terms, grams, own = build_term_postings(docs, folded), build_positions(docs), build_postings(docs)
    counts = {"vocab": build_vocab(terms), "gram_count": build_gram_counts(grams), "word_form": build_forms(own)}
    return {"file": docs.select("path", "mtime"), "text": docs.select("path", "text"), "word_posting": own, "term_posting": terms, "trigram_posting": grams, "doc_len": build_lengths(docs), **counts}


def upsert_docs(index: dict[str, DataFrame], docs: DataFrame, folded: bool = True) -> dict[str, DataFrame]:
    """The tables with these documents in place of what stood under their paths. Doing it twice changes nothing more. folded: as the index was built."""
    out = delete_paths({k: v for k, v in index.items() if k not in COUNTS}, docs)
    new = build_index(docs, folded)
    return _counted({k: t.unionByName(new[k]) for k, t in out.items()}, index)
