from __future__ import annotations

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.functions import paths as p
from tessella.functions import text as t
from tessella.functions.globs import glob_to_regex
from tessella.operators import scan
from tessella.operators import search as s
from tessella.operators.index import build_index, build_lengths, build_term_postings, build_vocab


def one(spark, column, **values):
    names = ", ".join(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())).select(column.alias("x")).first()["x"], names


@pytest.mark.parametrize(
    ("glob", "tree", "yes", "no"),
    [
        ("**/node_modules", True, ["/a/node_modules", "node_modules/x/y", "/a/node_modules/b"], ["/a/node_modules2"]),
        ("**/*.png", False, ["/a/b.png", "c.png", "/a/.x.png"], ["/a/b.png/c", "/a/b.pngx"]),
        ("a/**", False, ["a/b", "a/b/c"], ["a", "ab/c"]),
        ("a/**/b", False, ["a/b", "a/x/y/b"], ["ab"]),
        ("{a,b}?.txt", False, ["a1.txt", "bx.txt"], ["a.txt", "c1.txt", "a/.txt"]),
        ("x+y(1)", False, ["x+y(1)"], ["xxy1"]),
        ("**/*.py[cod]", False, ["/a/b.pyc", "x.pyo"], ["/a/b.py", "x.pyx", "x.py/"]),
        ("[!a-c]x[]y]", False, ["dxy", "-x]"], ["axy", "/xy", "dxz"]),
        ("a[/]b[", False, ["a[/]b["], ["a/b["]),
    ],
)
def test_globs(glob, tree, yes, no):
    rx = re.compile(glob_to_regex(glob, tree))
    assert all(rx.match(x) for x in yes)
    assert not any(rx.match(x) for x in no)


def test_roots_are_literal():
    rx = re.compile(glob_to_regex("**/*.o", False, "/r{1,2}*?[x]"))
    assert rx.match("/r{1,2}*?[x]/a/b.o") and not rx.match("/r1/a/b.o")


def test_apply_ignore(spark):
    files = spark.createDataFrame([(r, f"{r}/{f}") for r in ("/a,{b}", "/c") for f in ("x.o", "sub/y.pyc", "keep.txt", "build/z")], "root string, path string")
    lines = spark.createDataFrame([("/a,{b}", "", 0, "*.o"), ("/a,{b}", "", 1, "*.py[cod]"), ("/c", "", 0, "build/")], "root string, dir string, line_no int, line string")
    globs = spark.createDataFrame([("**/keep.txt",), ("**/*.o",)], "glob string")
    capped = scan.cap_ignore(scan.parse_ignore(lines), 1, globs)
    assert {r["root"]: (r["dropped"], r["globs"]) for r in capped.collect()} == {"/a,{b}": (3, ["**/*.o", "**/keep.txt"]), "/c": (1, ["**/*.o", "**/build/", "**/keep.txt"])}
    capped = scan.cap_ignore(scan.parse_ignore(lines), 10, globs)
    assert {r["path"] for r in scan.apply_ignore(files, capped).collect()} == {"/a,{b}/build/z", "/c/sub/y.pyc"}


def test_trimming(spark):
    """Tabs, carriage returns, the no-break space and the byte order mark go, as U+0020 does."""
    rows = ["\tfoo bar\r", "\u00a0 \ufeffx\u2028", "\t\r\n", "\u200bx", "a\u3000", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "query_id long, query string")
    assert [r["p"] for r in df.orderBy("query_id").select(t.preview(F.col("query")).alias("p")).collect()] == ["foo bar", "x", "", "\u200bx", "a", None]
    assert [r["query_id"] for r in scan.skip_blank_queries(df).orderBy("query_id").collect()] == [0, 1, 3, 4]
    spans = spark.createDataFrame([("\t\tab\u00a0cd ab\r", ["ab", "cd"])], "line string, terms array<string>").select(t.highlight_spans(F.col("line"), F.col("terms")).alias("x"))
    assert [(r["start"], r["end"]) for r in spans.first()["x"]] == [(0, 2), (6, 8), (3, 5)]
    split = spark.createDataFrame([("a\u00a0B\u3000c",)], "q string").select(t.query_terms(F.col("q")).alias("x"))
    assert split.first()["x"] == ["a", "b", "c"]


def test_extension_list(spark, tmp_path):
    (tmp_path / "text").write_text("zig\n\ncr\n")
    own = p.extension_list(spark, str(tmp_path / "text"))
    df = spark.createDataFrame([("a.png.zig",), ("b.cr",), ("c.md",)], "path string").select("path", p.classify_ext(F.col("path"), own).alias("k"))
    assert {r["path"]: r["k"] for r in df.collect()} == {"a.png.zig": "text", "b.cr": "text", "c.md": "unknown"}


def test_ignore_files(spark):
    lines = ["# c", "", "*.dat", "/src", "build/", "de/*.md", "!keep", "**/x\r"]
    df = spark.createDataFrame([("/r", "", i, x) for i, x in enumerate(lines)] + [("/r", "sub", 9, "*.o")], "root string, dir string, line_no int, line string")
    got = [(r["line_no"], r["glob"]) for r in scan.parse_ignore(df).orderBy("dir", "line_no", "variant").collect()]
    assert got == [(2, "**/*.dat"), (2, "**/*.dat/**"), (3, "src"), (3, "src/**"), (4, "**/build/"), (4, "**/build/**"), (5, "de/*.md"), (5, "de/*.md/**"), (6, "**/!keep"), (6, "**/!keep/**"), (7, "**/x"), (7, "**/x/**"), (9, "sub/**/*.o"), (9, "sub/**/*.o/**")]
    capped = scan.cap_ignore(scan.parse_ignore(df), 3).first()
    assert capped["dropped"] == 11 and sorted(capped["globs"]) == ["**/*.dat", "**/*.dat/**", "src"]


def test_words_and_terms(spark):
    texts = ["foo_bar a-b x2 ab", "Été É́te", "中文 test", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r[0] for r in df.select(t.words(F.col("text"))).collect()][0] == ["foo_bar", "a", "b", "x2", "ab"]
    docs = df.withColumn("path", F.monotonically_increasing_id().cast("string"))
    terms = {r["term"] for r in build_vocab(build_term_postings(docs)).collect()}
    assert {"foo", "bar", "ete", "中文"} <= terms and "été" not in terms


def test_extension_kinds(spark):
    names = {"a.txt.gz": "text", "a.PNG": "unknown", "Makefile": "text", "x.jpg.bak": "binary", ".gitignore": "text", "plain": "unknown", "d/b.zip": "binary"}
    df = spark.createDataFrame([(x,) for x in names], "path string").select("path", p.classify_ext(F.col("path")).alias("k"), p.file_kind(F.col("path")).alias("f"))
    assert {r["path"]: r["k"] for r in df.collect()} == names
    assert {r["path"]: r["f"] for r in df.collect()}["a.PNG"] == "file-media"


def test_sniff(spark):
    e4, e3, e2 = "\U0001f600".encode(), "中".encode(), "é".encode()
    a = b"a" * 100
    cases = {
        "empty": (b"", False), "ascii": (a, False), "nul first": (b"\0" + a, True), "nul middle": (a[:45] + b"\0" + a[:55], True),
        "nul last": (a + b"\0", True), "nul between": (a[:25] + b"\0" + a[:74], False), "stray": (b"\x80" * 60, True),
        "utf16": (("text" * 20).encode("utf-16-le"), True), "cut 4": (e4 * 40, False), "cut 3": (e3 * 41, False),
        "cut 2": (b"x" + e2 * 41, False), "broken end": (a + e3[:2], True), "tab": (b"\t\n" * 30, False),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "k string, content binary")
    assert {r["k"]: r["b"] for r in df.select("k", scan.sniff_binary(F.col("content")).alias("b")).collect()} == {k: v[1] for k, v in cases.items()}


def test_sizes(spark):
    df = spark.createDataFrame([("a.txt", n) for n in (0, 1, scan.MAX_SIZE - 1, scan.MAX_SIZE)], "path string, size long")
    assert [r["size"] for r in scan.is_indexable(df).orderBy("size").collect()] == [1, scan.MAX_SIZE - 1]


def test_relative_paths(spark):
    f = spark.createDataFrame([("w", "/w"), ("in", "/w/in")], "name string, root string")
    df = spark.createDataFrame([("/w/in/a/b.c",), ("/w/x",), ("/w",), ("http://u/v",), ("/wx/y",)], "path string")
    got = {r["path"]: (r["folder"], r["relative"], r["d"]) for r in p.relativize(df, f).withColumn("d", p.display_path(F.col("folder"), F.col("relative"))).collect()}
    assert got["/w/in/a/b.c"] == ("in", "a/b.c", "b.c • in/a")
    assert got["/w/x"] == ("w", "x", "x • w")
    assert got["/w"][0] is None and got["/wx/y"][0] is None and got["http://u/v"][1] == "http://u/v"


def test_highlights(spark):
    df = spark.createDataFrame([("  aXa abab a.b", ["ab", "a.b", "", "ab"])], "line string, terms array<string>")
    got = [(r["start"], r["end"]) for r in df.select(t.highlight_spans(F.col("line"), F.col("terms")).alias("x")).first()["x"]]
    assert got == [(4, 6), (6, 8), (9, 12)]


CORPUS = {"1": "aaaaa bbb", "2": "aaa xyz xyz", "3": "the quick brown fox", "4": "", "5": "quick Quick aaa", "6": "foo.bar a'b OR c*", "7": "ab foo\nfoo.bar"}


def corpus(spark):
    return spark.createDataFrame(list(CORPUS.items()), "path string, text string")


def test_rank_is_that_of_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, tokenize='trigram')")
    for k, x in CORPUS.items():
        con.execute("insert into f(rowid, text) values (?, ?)", (int(k), x))
    docs = corpus(spark)
    queries = {1: "aaa", 2: "quick", 3: "aaa quick", 4: "foo.bar", 5: "xyz"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    index = build_index(docs.withColumn("mtime", F.lit(1)))
    for found in (s.search_files(q, index), s.search_files_by_scan(q, docs, build_lengths(docs))):
        got = {(r["query_id"], r["path"]): r["rank"] for r in found.collect()}
        want = {}
        for i, x in queries.items():
            match = " ".join(f'"{w}"' for w in x.split())
            want |= {(i, str(r[0])): round(r[1], 6) for r in con.execute("select rowid, rank from f where f match ? order by rank", (match,))}
        assert got == pytest.approx(want, abs=2e-6)


def test_search_cases(spark):
    from tessella.jobs.search import search

    docs = corpus(spark)
    rows = [(1, "ab foo"), (2, "ab c"), (3, "   "), (4, " foo.bar"), (5, "a'b OR"), (6, "c* foo"), (7, "foo bar")]
    q = spark.createDataFrame(rows, "query_id long, query string")
    got = {(r["query_id"], r["path"], r["line_number"]) for r in search(q, build_index(docs.withColumn("mtime", F.lit(1)))).collect()}
    # The short term counts on the line; short terms alone find nothing; terms are plain text.
    assert got == {(1, "7", 1), (4, "6", 1), (4, "7", 2), (5, "6", 1), (6, "6", 1), (7, "6", 1), (7, "7", 2)}


@pytest.mark.parametrize(("limit", "total", "more"), [(4, 4, True), (5, 5, True), (6, 5, False)])
def test_caps(spark, limit, total, more):
    rows = [(1, 1, "a", i, "x") for i in (1, 2, 3)] + [(1, 2, "b", i, "x") for i in (7, 9)]
    df = spark.createDataFrame(rows, "query_id long, file_rank int, path string, line_number int, line_text string")
    r = s.result_summary(s.cap_matches(df, limit), limit).first()
    assert (r["total"], r["has_more"]) == (total, more)


def test_scan_of_many_terms(spark, monkeypatch):
    """More terms than a block holds: the scan answers them all, as the postings do."""
    monkeypatch.setattr(s, "BLOCK_TERMS", 2)
    docs = corpus(spark)
    q = spark.createDataFrame(list(enumerate(["aaa", "bbb", "quick fox", "xyz", "brown the", "foo", "none here"])), "query_id long, query string")
    found = [sorted(map(tuple, x.collect())) for x in (s.search_files(q, build_index(docs.withColumn("mtime", F.lit(1)))), s.search_files_by_scan(q, docs, build_lengths(docs)))]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {0, 1, 2, 3, 4, 5}


def test_few_files_and_paths(spark):
    docs = corpus(spark)
    q = spark.createDataFrame([(1, "aaa")], "query_id long, query string")
    index = build_index(docs.withColumn("mtime", F.lit(1)))
    assert [r["file_rank"] for r in s.search_files(q, index, 2).orderBy("file_rank").collect()] == [1, 2]
