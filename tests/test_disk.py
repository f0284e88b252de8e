"""What the index and its searches put on disk: rows that are shuffled, and bytes that are written."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa

from tessella.jobs.search import highlights
from tessella.operators import index as ix
from tessella.operators import search as s
from tessella.sources.store import read_index, update_index, write_index


def docs(spark, texts):
    return spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "path string, mtime long, text string")


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def stages(spark):
    context = spark.sparkContext
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {found.apply(i).stageId(): (found.apply(i).shuffleWriteRecords(), found.apply(i).shuffleWriteBytes()) for i in range(found.size())}


def shuffled(spark, action):
    """Rows and bytes that an action's stages shuffle."""
    before = stages(spark)
    action()
    new = [x for k, x in stages(spark).items() if k not in before]
    return sum(n for n, _ in new), sum(b for _, b in new)


def some_texts(n, words=120):
    r = random.Random(1)
    own = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 6))) for _ in range(200)]
    return {f"/w/p{i}": " ".join(r.choice(own) for _ in range(words)) for i in range(n)}


def test_postings_are_not_shuffled_row_by_row(spark, tmp_path):
    """Trigram postings stay where their texts are read, word postings travel in blocks; the places of all trigrams take up little."""
    at, texts = str(tmp_path / "i"), some_texts(300)
    n, _ = shuffled(spark, lambda: write_index(docs(spark, texts), at, parts=4))
    index = read_index(spark, at)
    assert index["trigram_posting"].count() > 60_000 and n < 0.5 * index["word_posting"].count()
    assert rows(index["trigram_posting"]) == rows(ix.build_positions(docs(spark, texts))) and rows(index["word_posting"]) == rows(ix.build_postings(docs(spark, texts)))
    at_rest = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{at}/segments") for f in fs if "trigram_posting" in d and f.endswith(".parquet"))
    assert at_rest < 3.5 * sum(map(len, texts.values()))


def test_odd_rows_are_stored(spark, tmp_path):
    """A null path, a null and an empty text, characters of every width, and places beyond two bytes."""
    at = str(tmp_path / "i")
    some = spark.createDataFrame([(None, 1, "no path here"), ("a", 2, None), ("b", 3, ""), ("c", 4, "𝔸𝔹ℂ dé ÉTÉ 𝔸𝔹ℂ"), ("d", 5, "x" * 300 + "y" * 20_000 + "needle")], "path string, mtime long, text string")
    write_index(some, at, parts=3)
    full, index = ix.build_index(some), read_index(spark, at)
    for k in ("trigram_posting", "word_posting", "text"):
        assert rows(index[k]) == rows(full[k])
    update_index(spark, at, docs(spark, {"b": "needle again needle"}), spark.createDataFrame([("d",)], "path string"))
    got = s.term_hits(spark.createDataFrame([("needle",), ("𝔸𝔹ℂ",), ("nothing",)], "term string"), read_index(spark, at))
    assert rows(got) == [("b", "needle", 2), ("c", "𝔸𝔹ℂ", 2)] or rows(got) == sorted([("b", "needle", 2), ("c", "𝔸𝔹ℂ", 2)], key=str)


def test_numbers_in_bytes():
    own = np.array([0, 127, 128, 5, 16_383, 16_384, 2**30, 0])
    data, at = ix.leb(own)
    assert ix.unleb(data)[0].tolist() == own.tolist() and at.tolist() == [0, 1, 2, 4, 5, 7, 10, 15, 16]
    assert ix.leb(own[:0])[0].tolist() == [] and ix.unleb(own[:0].astype(np.uint8))[0].tolist() == []
    lists = [[3, 9, 10], [0], [7, 500_000], [1]]
    edges = np.append(0, np.cumsum([len(x) for x in lists]))
    blobs = ix.packed(np.concatenate(lists), edges)
    for part in (blobs, blobs.slice(1, 2)):
        assert ix.unpacked.func(part).to_pylist() == lists[1:3] if len(part) == 2 else lists
    assert ix.unpacked.func(pa.array([], pa.binary())).to_pylist() == []


def test_positions_travel_once_for_all_terms(spark, monkeypatch):
    """However many terms share a trigram, its positions in a file are dealt once; counts of overlapping terms are those of a look at every text, in pieces of any size and also where terms are too many for one task."""
    texts = some_texts(60, 80) | {"/w/over": "aaaaaaa abab ababab", "/w/zé": "zéé éz"}
    index = ix.build_index(docs(spark, texts))
    index["trigram_posting"] = index["trigram_posting"].persist()
    words = sorted({w[:k] for t in texts.values() for w in t.split() for k in (3, 4, 5) if len(w) >= k})
    terms = [*words[::3], "aaa", "aaaa", "abab", "zéé", " ab", "none of it", "aaaaaaaaaa"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted([(p, t, n) for t in set(terms) for p, x in texts.items() if (n := sum(x.lower().startswith(t, i) for i in range(len(x))))], key=str)
    assert rows(s.term_hits(df, index)) == want
    n, _ = shuffled(spark, lambda: s.term_hits(df, index).write.format("noop").mode("overwrite").save())
    assert n < len(want)  # before: a row for each term, file and trigram of the term
    monkeypatch.setattr(s, "_PLACES", 50)
    assert rows(s.term_hits(df, index)) == want
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert rows(s.term_hits(df.filter("term in ('aaa', 'abab', 'zéé', 'none of it')"), index)) == [x for x in want if x[1] in ("aaa", "abab", "zéé")]
    index["trigram_posting"].unpersist()


def test_highlights_carry_numbers_of_queries(spark, monkeypatch):
    """For each text the numbers of its queries are kept, not the terms of each of them."""
    r = random.Random(2)
    own = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(40)})
    texts = {f"/w/p{i}": f"{' '.join(own[:20])}\n{' '.join(own)}\nlz{i}" for i in range(40)}
    asked = {k: r.sample(own, 10) for k in range(200)}
    q = spark.createDataFrame([(k, " ".join(x)) for k, x in asked.items()] + [(999, "LZ"), (1000, None), (1001, " ")], "query_id long, query string")
    index = ix.build_index(docs(spark, texts))
    want = sorted([(k, p, n + 1, line.index(t), line.index(t) + 12) for k, x in asked.items() for p, text in texts.items() for n, line in enumerate(text.split("\n")) if all(t in line for t in x) for t in x] + [(999, p, 3, 0, 2) for p in texts])
    assert sorted(map(tuple, highlights(q, index).collect())) == want
    _, size = shuffled(spark, lambda: highlights(q, index).write.format("noop").mode("overwrite").save())
    assert size < 600_000
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, highlights(q.filter("query_id > 150"), index).collect())) == [x for x in want if x[0] > 150]
