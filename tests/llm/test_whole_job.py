"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import common, language, licences, neardup, quality, repeats, vectors
from tessella.llm.licence_texts import FORMS, TEXTS
from tessella.llm.oracles import ORACLES
from tests.compare import rows_of, sql_rows
from tests.llm import brute


def test_near_pairs_with_far_odd_sketches(spark):
    """Pairs exactly at 0.80 that share bands and whose odd sketches lie further apart than such pairs' mostly do."""
    some = []
    for seed in (284, 870, 956, 1295, 1377):
        w = [f"w{seed}x{i}" for i in range(40)]
        some += [(2 * seed, " ".join(w[:36])), (2 * seed + 1, " ".join(w[4:]))]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.components(df, 1, 80).collect()} == {i: i - i % 2 for i, _ in some}


def test_real_licence_files(spark):
    """Files of published packages, named by licence and package: with titles, copyright lines, bullets and filled-in appendices."""
    files = sorted(Path(__file__).with_name("licence_files").glob("*.txt"))
    df = spark.createDataFrame([(i, f.read_text(encoding="utf-8")) for i, f in enumerate(files)], "doc_id long, text string")
    got = {files[r["doc_id"]].name: r["licence"] for r in licences.scan(df).collect()}
    assert len(got) == 7 and got == {f.name: f.name.rsplit(".", 2)[0] for f in files}


def test_planted_licences(spark, tmp_path):
    """Every known form of a whole text, as it is and disguised, in a table beside other documents: all found, by Spark and SQL alike."""
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = [*TEXTS, *FORMS]
    disguised = [f"Copyright (c) 1999 Some One\n{t.upper()}\n\n(c) 2001 Other" if n % 2 else t.replace(", ", " ,\t").replace("license", "licence") for n, (_, t) in enumerate(known)]
    planted = spark.createDataFrame([(10_000 + n, t) for n, t in enumerate(disguised)] + [(-1, known[0][1] + " more"), (-2, None)], "doc_id long, text string")
    plain.union(planted).write.parquet(str(tmp_path / "documents.parquet"))
    df = licences.scan(spark.read.parquet(str(tmp_path / "documents.parquet")))
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert (columns, rows) == sql_rows(str(tmp_path), ORACLES["op5_licence_scan"])
    found = {r["doc_id"]: r["licence"] for r in df.filter("doc_id >= 10000 OR doc_id < 0").collect()}
    assert found.pop(-1) is None and found.pop(-2) is None
    assert all(found.values()) and sum(found[10_000 + n] == i for n, (i, _) in enumerate(known)) >= 0.9 * len(known)  # BSD License titles two of them


def test_copyright_lines_end_with_line_feeds(spark, tmp_path):
    """Prose behind other separators of Unicode is no line of its own."""
    spark.createDataFrame([(i, f"some words{x}copyright 2020 and these words of prose stay") for i, x in enumerate("\n\u2028\u2029\u0085\r ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = licences.scan(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == sql_rows(str(tmp_path), ORACLES["op5_licence_scan"])
    assert df.select("digest").distinct().count() == 2


def _bucket(texts: list[bytes]) -> pa.RecordBatch:
    n = len(texts)
    columns = [pa.array([1] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([7] * n, pa.int64()), pa.array([len(t) for t in texts], pa.int32()), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=repeats._names)


def test_bucket_of_a_common_anchor():
    """100,000 segments that share 40 bytes and no 100: none goes, and no matrix of all suffixes is made."""
    r = np.random.default_rng(1)
    noise = r.integers(97, 123, (100_000, 120), np.uint8)
    anchor = bytes(r.integers(97, 123, 40, np.uint8))
    (out,) = repeats._removals(iter([_bucket([bytes(x[:60]) + anchor + bytes(x[60:]) for x in noise])]))
    assert out.num_rows == 0


def test_bucket_of_a_common_passage():
    """Different bytes around one passage of 130: all occurrences but the first go, and beside them what an earlier text has too."""
    r = np.random.default_rng(2)
    passage = bytes(r.integers(97, 123, 130, np.uint8))
    texts = [bytes(r.integers(97, 123, 20, np.uint8)) + passage + bytes(r.integers(97, 123, 10, np.uint8)) for _ in range(1500)]
    (out,) = repeats._removals(iter([_bucket(texts)]))
    gone = {i: set() for i in range(1500)}
    for i, start, size in zip(*(out.column(c).to_pylist() for c in ("did", "start", "size")), strict=True):
        gone[i] |= set(range(start - 7, start - 7 + size))
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, _, n, _, _ in brute.op3([(i, t.decode()) for i, t in enumerate(texts)])}


def test_hot_keys(spark):
    """A key with most of the rows is dealt in parts, and every row finds its partner once."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    per = common.cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")))
    out = common.spread_join(rows, per, ["k"], ["id"])
    assert out.count() == 9000 and out.filter("k = 0").select("low").distinct().collect()[0][0] == 0
    hot = common.hot_keys(per, ["k"])
    assert [tuple(r) for r in hot.collect()] == [(0, 7)]
    assert common.hot_keys(per.filter("k > 0"), ["k"]) is None and common.hot_keys(per.limit(0), ["k"]) is None
    assert common.dealt(rows, hot, ["k"], ["id"]).filter("k = 0").groupBy("__part").count().filter("count > 1200").count() == 0


def test_top_k_counts_every_row(spark):
    """Rows of equal id and vector, and rows of the query's id, are candidates; scores beyond 64 bits do not wrap; a query of several rounds is whole."""
    rows_ = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.top_k(df, F.col("id") == 0, 10).collect())
    m = 1 << 20
    one = [(0, 1, 1, m), (0, 2, 1, m), (0, 3, 0, 0), (0, 4, 2, -m)]
    other = [(0, 1, 1, m), (0, 2, 1, m), (0, 3, 2, m // 2), (0, 4, 0, 0)]
    assert got == sorted(one + other)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 3.0]), (4, [1e308, 0.0])], "vec_id long, embedding array<double>")
    best = (1 << 63) - 1
    assert [tuple(r)[1:] for r in vectors.top_k(huge, F.col("id") == 0, 10).orderBy("rank").collect()] == [(1, 1, best), (2, 3, 3 * m), (3, 2, 1 - best)]


def test_top_k_rounds(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vectors.top_k(df, F.col("id") % 10 == 0, 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 1000)
    assert whole == sorted(map(tuple, vectors.top_k(df, F.col("id") % 10 == 0, 5).collect())) and len(whole) == 300


def test_quality_by_value(spark):
    """Lines of one Unicode line separator are words and lines; fences of two groups are those of the plain version."""
    texts = [(1, "\u2028\n\u2028\n\u0085\n\u0085\n \n \n", "en", "a"), (2, "one two\none two\n\t\none", None, "a"), (2, "one two\none two\n\t\none", None, "a"), (None, None, "en", None)]
    r = random.Random(3)
    for i in range(3, 150):
        w = [r.choice(["ab", "cde", "fghij"]) + str(r.randint(0, 999)) for _ in range(r.randint(12, 60))]
        w[3] = w[2] if i % 5 == 0 else w[3]
        w[1] = "#$%" * 5 if i % 11 == 0 else w[1]
        w[5] = "x" * 400 if i % 37 == 0 else w[5]
        texts.append((i, " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]), "en" if i % 3 else "de", "a" if i % 2 else None))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    got = quality.assess(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.quality(texts), key=str)
    by = {x["doc_id"]: x for x in got}
    assert by[1]["n_dup_lines"] == 2 and by[2]["n_dup_lines"] == 1 and by[11]["kept"] is False and by[37]["kept"] is False
    kept = [x["doc_id"] for x in quality.filter_documents(df).collect()]
    assert sorted(kept) == sorted(x[0] for x in brute.quality(texts) if x[-1])


def test_language_by_brute_force(spark):
    """The labelling of least cost over all sequences of labels, with word scores added up gram by gram."""
    train = [(i, t, x) for i, (x, t) in enumerate([("en", "the house and the garden with that"), ("fr", "la maison et le jardin avec une"), ("de", "das haus und der garten mit dem")] * 5)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), 100)
    texts = ["the garden et le jardin", "Haus und maison", "das haus mit the house and", "x", "a1b2 et", "la", "und und und la la la"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for switch in (12.0, 1.0):
        language.SWITCH, before = switch, language.SWITCH
        try:
            got = {r["doc_id"]: [(s["start"], s["end"], s["lang"]) for s in r["spans"]] for r in language.spans(df, model).collect()}
            want = {i: brute.spans(t, model, switch) for i, t in enumerate(texts)}
        finally:
            language.SWITCH = before
        assert got == want
