"""The index kept current: upserts, refresh of real folders, the change stream."""

from __future__ import annotations

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions.globs import any_regex, glob_to_regex, literal_key, path_keys
from tessella.jobs import refresh
from tessella.jobs.search import highlights, search
from tessella.operators import index as ix
from tessella.operators import diff, scan
from tessella.sources.files import read_files, to_docs
from tessella.sources import files, store
from tessella.sources.store import read_index, read_meta, update_index, write_index
from tessella.streaming import changes as st


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def same(a, b):
    return all(rows(a[k]) == rows(b[k]) for k in b)


def docs(spark, **texts):
    return spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "path string, mtime long, text string")


def test_upsert_and_delete(spark):
    first = ix.build_index(docs(spark, a="one two two", b="two three", c="Été four"))
    new = docs(spark, b="five", d="two")
    once = ix.upsert_docs(first, new)
    full = ix.build_index(docs(spark, a="one two two", b="five", c="Été four", d="two"))
    assert same(once, full)
    assert same(ix.upsert_docs(once, new), full)
    gone = spark.createDataFrame([("b",), ("nobody",)], "path string")
    assert same(ix.delete_paths(full, gone), ix.build_index(docs(spark, a="one two two", c="Été four", d="two")))


def test_unfolded_stays_unfolded(spark, tmp_path):
    first, new = docs(spark, a="foo_bar café"), docs(spark, b="Foo_bar Été", a="naïve foo_bar")
    want = ix.build_index(docs(spark, a="naïve foo_bar", b="Foo_bar Été"), folded=False)
    assert same(ix.upsert_docs(ix.build_index(first, folded=False), new, folded=False), want)
    write_index(first, str(tmp_path / "i"), folded=False)
    update_index(spark, str(tmp_path / "i"), new, new.filter("false"))
    assert {r["term"] for r in read_index(spark, str(tmp_path / "i"))["vocab"].collect()} == {"naïve", "foo_bar", "été"}


def tree(at):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def none(spark):
    return spark.createDataFrame([], "path string")


def test_updates_are_small_and_merged(spark, tmp_path):
    """An update writes what it changes; the rows are those of a full build after each of many; few segments are left, and a table is two scans at most."""
    at, texts = str(tmp_path / "index"), {f"p{i}": f"text number {i} of many Wörter " * 40 for i in range(200)}
    write_index(docs(spark, **texts), at, parts=4)
    before = tree(at)
    update_index(spark, at, docs(spark, p7="other words"), spark.createDataFrame([("p9",), ("nobody",)], "path string"))
    after = tree(at)
    assert all(after[f] == n for f, n in before.items())
    assert sum(n for f, n in after.items() if f not in before) < 0.25 * sum(before.values())
    texts["p7"] = "other words"
    del texts["p9"]
    assert same(read_index(spark, at), ix.build_index(docs(spark, **texts)))
    for i in range(9):
        texts["p7"], texts[f"new{i % 4}"] = f"again {i}", f"Added {i} text"
        gone = spark.createDataFrame([(f"p{50 + i}",)], "path string")
        del texts[f"p{50 + i}"]
        update_index(spark, at, docs(spark, **{"p7": texts["p7"], f"new{i % 4}": texts[f"new{i % 4}"]}), gone)
        assert len(store.log(spark, at)["segments"]) <= 1 + 2 * (store.FANOUT - 1)
        if i in (3, 8):
            index = read_index(spark, at)
            assert same(index, ix.build_index(docs(spark, **texts)))
            assert all(index[k]._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2 for k in index if k != "term_posting")
    assert update_index(spark, at, docs(spark, x="y").filter("false"), none(spark)) is None
    update_index(spark, at, docs(spark, x="y").filter("false"), docs(spark, **texts))
    assert all(t.count() == 0 for t in read_index(spark, at).values())
    # Folders of segments that no kept entry of the log names are gone.
    kept = {s["id"] for n in store._children(spark, f"{at}/log") for s in store._entry(spark, at, n)["segments"]}
    assert set(os.listdir(f"{at}/segments")) == kept and len(os.listdir(f"{at}/log")) <= 2 * (store.KEPT + 1)


def test_two_writers(spark, tmp_path):
    """Of two updates from one state the second is refused, and nothing of it shows."""
    at = str(tmp_path / "index")
    write_index(docs(spark, a="one", b="two"), at, parts=2)
    entry = store.log(spark, at)
    update_index(spark, at, docs(spark, a="three"), none(spark))
    with pytest.raises(Exception, match="already exists"):
        store._commit(spark, at, entry | {"seq": entry["seq"] + 1})
    assert rows(read_index(spark, at)["text"]) == [("a", "three"), ("b", "two")]


def test_looked_up_parts(spark, tmp_path):
    """Look-ups select parts by their bounds and pages by keys, and find all rows, also of keys that fill several parts."""
    at = str(tmp_path / "index")
    texts = {f"p{i}": " ".join(f"w{(i * 7 + k) % 300:03d}x" for k in range(30)) + f" only{i:04d} Word WORD" for i in range(400)}
    write_index(docs(spark, **texts), at, parts=12)
    update_index(spark, at, docs(spark, p3="word only0001 again", z="Wordy"), spark.createDataFrame([("p5",)], "path string"))
    index = read_index(spark, at)
    texts |= {"p3": "word only0001 again", "z": "Wordy"}
    del texts["p5"]
    full = ix.build_index(docs(spark, **texts))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    files = lambda df: {f for f in df.inputFiles() if "/gone/" not in f}
    for name, key, own in (("word_posting", "word", ("only0001", "Word", "none")), ("trigram_posting", "gram", ("y00", "wor", "zzz")), ("vocab", "term", ("only0001", "w007x")), ("text", "path", ("p3", "p9", "p5"))):
        got = index.pick(name, keys(*own)).filter(F.col(key).isin(*own))
        assert rows(got) == rows(full[name].filter(F.col(key).isin(*own)))
    one = index.pick("word_posting", keys("only0007"))
    assert len(files(one)) <= 3 < len(files(index["word_posting"])) and "EqualTo(word,only0007)" in one._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    many = index.pick("trigram_posting", full["trigram_posting"].select("gram").distinct())  # more than FEW_KEYS
    assert rows(many) == rows(full["trigram_posting"])
    for prefix in ("onl", "w00", "wor", "ÿ", ""):
        for name in ("vocab", "word_form"):
            got = index.starting(name, keys(prefix)).filter(F.startswith("term", F.lit(prefix)))
            assert rows(got) == rows(full[name].filter(F.startswith("term", F.lit(prefix))))
    assert len(files(index.starting("vocab", keys("only00")))) < len(files(index["vocab"]))
    q = spark.createDataFrame([(1, "only0007"), (2, "w007x word"), (3, "ord WORD"), (4, "none")], "query_id long, query string")
    assert rows(search(q, index)) == rows(search(q, full))
    hit = index.pick("trigram_posting", keys("7 w", "y00"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in hit and "text string" not in hit


def test_bounds():
    assert store._bounds([("a", 1), ("b", 1), ("c", 1), ("d", 1)], 2) == ["c"] and store._bounds([], 4) == [] and store._bounds([("a", 5)], 3) == ["a", "a"]
    assert store._bounds([("a", 1), ("b", 98), ("c", 1)], 4) == ["b", "b", "b"]


def write(path, content, mtime):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    os.utime(path, (mtime, mtime))


def test_refresh(spark, tmp_path):
    root, at = str(tmp_path / "ws"), str(tmp_path / "index")
    write(f"{root}/a.txt", b"hello world", 1000.6)
    write(f"{root}/sub/b.md", b"bad \xff byte", 1001)
    write(f"{root}/node_modules/c.js", b"hidden", 1002)
    write(f"{root}/d.dat", b"\0\1\2", 1003)
    write(f"{root}/e.png", b"image", 1004)
    refresh.create(spark, [root], at)
    meta = {os.path.basename(r["path"]): r["mtime"] for r in read_meta(spark, at).collect()}
    assert meta == {"a.txt": 1001, "b.md": 1001, "d.dat": 1003}
    text = {os.path.basename(r["path"]): r["text"] for r in read_index(spark, at)["text"].collect()}
    assert text == {"a.txt": "hello world", "b.md": "", "d.dat": ""}  # a bad byte counts as binary
    write(f"{root}/a.txt", b"hello again", 900)  # an older time is a change too
    os.remove(f"{root}/sub/b.md")
    write(f"{root}/f.txt", b"new", 2000)
    refresh.refresh(spark, [root], at)
    kept = read_index(spark, at)
    fresh = str(tmp_path / "fresh")
    refresh.create(spark, [root], fresh)
    assert same(kept, read_index(spark, fresh))


def test_refresh_with_ignore_files(spark, tmp_path):
    root, other, at = str(tmp_path / "w{s}"), str(tmp_path / "w{s}" / "nested"), str(tmp_path / "index")
    write(f"{root}/.gitignore", b"*.log\r\n# no\n/top.txt\nbuild/\n", 1)
    write(f"{root}/sub/.ignore", b"*.py[cod]\n", 1)
    write(f"{root}/node_modules/.gitignore", b"*\n", 1)  # excluded itself
    for name in ("a.txt", "a.log", "top.txt", "sub/top.txt", "sub/b.pyc", "b.pyc", "build/c.txt", "sub/build/d.txt", "node_modules/e.txt", "kept.tmp", "nested/n.txt", "nested/n.log", "pkg/__init__.py", ".git/config", ".github/w/x.yml"):
        write(f"{root}/{name}", b"words of " + name.encode(), 5)
    settings = spark.createDataFrame([(1, "**/kept.tmp", True), (0, "**/a.txt", True), (3, "**/a.txt", False)], "source_prio int, glob string, enabled boolean")
    refresh.create(spark, [root], at, settings)
    names = lambda: sorted(r["path"].split("w%7Bs%7D/")[-1].split("w{s}/")[-1] for r in read_meta(spark, at).collect())
    assert names() == [".github/w/x.yml", ".gitignore", "a.txt", "b.pyc", "nested/n.txt", "pkg/__init__.py", "sub/.ignore", "sub/top.txt"]
    write(f"{root}/.gitignore", b"*.txt\n", 2)
    assert refresh.refresh(spark, [root], at, settings)
    assert names() == [".github/w/x.yml", ".gitignore", "a.log", "b.pyc", "nested/n.log", "pkg/__init__.py", "sub/.ignore"]
    assert refresh.refresh(spark, [root], at, settings) is None
    # A nested root goes by its own ignore files.
    refresh.refresh(spark, [root, other], at, settings)
    assert names() == [".github/w/x.yml", ".gitignore", "a.log", "b.pyc", "nested/n.log", "nested/n.txt", "pkg/__init__.py", "sub/.ignore"]


def test_only_changed_files_are_opened(spark, tmp_path):
    """By the times of last access: of 50 files the changed one is opened, and none that is too large."""
    root, at = str(tmp_path / "x"), str(tmp_path / "index")
    for i in range(50):
        write(f"{root}/f{i}.txt", b"words %d" % i, 1000)
    refresh.create(spark, [root], at)
    write(f"{root}/f7.txt", b"changed", 2000)
    write(f"{root}/huge.txt", b"x" * (scan.MAX_SIZE + 1), 2000)
    old = lambda: [os.utime(os.path.join(root, n), (500, os.stat(os.path.join(root, n)).st_mtime)) for n in os.listdir(root)]
    opened = lambda: {n for n in os.listdir(root) if os.stat(os.path.join(root, n)).st_atime != 500}
    old()
    with open(f"{root}/f1.txt", "rb") as f:
        f.read()
    if "f1.txt" not in opened():
        pytest.skip("the file system keeps no access times")
    old()
    assert refresh.refresh(spark, [root], at)
    assert opened() == {"f7.txt"}
    assert {r["text"] for r in read_index(spark, at)["text"].collect()} == {f"words {i}" for i in range(50) if i != 7} | {"changed"}


def test_listed_files_of_an_unknown_store(spark, tmp_path, monkeypatch):
    """What pyarrow cannot open is read by name, or, of very many files, from a scan."""
    for i in range(5):
        write(f"{tmp_path}/x/a{{{i}}}.txt", b"abc%d" % i, 5)
    root = files.qualified(spark, str(tmp_path / "x"))
    some = read_files(spark, [root]).select("path", "mtime", "size").filter("path like '%1%' or path like '%3%'")
    monkeypatch.setattr(files, "_store", lambda uri: (_ for _ in ()).throw(NotImplementedError()))
    for most in (10, 1):
        monkeypatch.setattr(files, "NAMED", most)
        assert {bytes(r["content"]) for r in files.read_listed(spark, some, [root]).collect()} == {b"abc1", b"abc3"}


def test_listing_reads_no_content(spark, tmp_path):
    write(f"{tmp_path}/x/a.txt", b"abc", 5)
    meta = read_files(spark, [str(tmp_path / "x")]).select("path", "size")
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and meta.first()["size"] == 3
    write(f"{tmp_path}/x/a.txt", b"a\xffc", 5)
    assert to_docs(read_files(spark, [str(tmp_path / "x")])).first()["text"] == "a�c"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, path string, kind string, ts string, mtime long, size long").withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream(spark, tmp_path):
    at, feed = str(tmp_path / "index"), str(tmp_path / "feed")
    write_index(docs(spark, **{"/w/a.txt": "old a", "/w/b.txt": "old b", "/w/c.txt": "old c"}), at)
    day = "2024-01-01 00:00:0"
    first = [(1, "/w/a.txt", "change", f"{day}1", 5, 9), (2, "/w/b.txt", "delete", f"{day}2", 0, 0), (3, "/w/x.png", "create", f"{day}2", 5, 9), (4, "/w/.gitignore", "change", f"{day}3", 5, 0), (5, "/w/skip/y.txt", "create", f"{day}3", 5, 9), (6, "/w/d.txt", "delete", f"{day}1", 0, 0), (7, "/w/d.txt", "create", f"{day}1", 6, 9)]
    events(spark, first).coalesce(1).write.parquet(feed)
    asked = []
    load = lambda c: c.select("path", "mtime", F.concat(F.lit("new "), "path").alias("text"))
    from tessella.sources.files import read_changes

    run = lambda: st.apply_changes(read_changes(spark, feed), at, load, ["/w/skip/*"], str(tmp_path / "check"), lambda df: asked.append([r["path"] for r in df.collect()])).awaitTermination()
    run()
    text = {r["path"]: r["text"] for r in read_index(spark, at)["text"].collect()}
    assert text == {"/w/a.txt": "new /w/a.txt", "/w/c.txt": "old c", "/w/d.txt": "new /w/d.txt"}
    assert asked == [["/w/.gitignore"]]
    time.sleep(1)
    events(spark, [(8, "/w/a.txt", "delete", f"{day}9", 0, 0)]).coalesce(1).write.mode("append").parquet(feed)
    run()
    assert "/w/a.txt" not in {r["path"] for r in read_meta(spark, at).collect()}


def test_bursts_on_a_stream(spark, tmp_path):
    """Runs come out once they are over, also when events of several batches or out of order make them up; the last one stays open, and an event that is too late is passed over."""
    feed = str(tmp_path / "feed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def run(*seconds):
            rows_ = [(i, f"/w/p{i % 2}", "change", f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", 1, 1) for i, s in enumerate(seconds)]
            events(spark, rows_).coalesce(1).write.mode("append").parquet(feed)
            write_ = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
            from tessella.sources.files import read_changes

            st.follow(st.stream_bursts(read_changes(spark, feed), 5, late="20 seconds"), write_, str(tmp_path / "c")).awaitTermination()
            return sorted((r["began"].second + 60 * r["began"].minute, r["ended"].second + 60 * r["ended"].minute, r["n_events"], r["n_paths"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

        assert run(0, 1, 2, 10, 11, 40) == [(0, 7, 3, 2), (10, 16, 2, 2)]  # the watermark stands at 20
        assert run(33, 37, 90) == [(0, 7, 3, 2), (10, 16, 2, 2), (33, 45, 3, 2)]
        assert run(3, 100) == [(0, 7, 3, 2), (10, 16, 2, 2), (33, 45, 3, 2)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

def test_folders_are_compared_first(spark):
    """Of folders that are the same no file is joined; nulls and files without a folder are compared too."""
    now = spark.createDataFrame([("/a/x", 1), ("/a/y", 2), ("/b/x", 1), ("top", 3), ("/c/d/z", None), ("/e/n", None)], "path string, mtime long")
    old = spark.createDataFrame([("/a/y", 2), ("/a/x", 1), ("/b/x", 2), ("/b/gone", 5), ("top", 3), ("/c/d/z", 4), ("/e/n", None), ("/f/only", 1)], "path string, mtime long")
    assert rows(diff.changed_folders(now, old)) == [("/b",), ("/c/d",), ("/f",)]
    assert rows(diff.diff_changed(now, old)) == [(1, "/b/x"), (None, "/c/d/z")]
    assert rows(diff.diff_deleted(now, old)) == [(1, "/f/only"), (5, "/b/gone")]
    # Exchanged times, and files of one hash sum, do not hide a change.
    assert rows(diff.changed_folders(now, now.withColumn("mtime", F.when(F.col("path") == "/a/x", 2).when(F.col("path") == "/a/y", 1).otherwise(F.col("mtime"))))) == [("/a",)]
    assert diff.changed_folders(now, now).count() == 0 and diff.diff_changed(now, now).count() == 0 and diff.diff_deleted(now.limit(0), now.limit(0)).count() == 0


def test_setting_requests(spark, tmp_path):
    """One request for a real change, none for the same value, across batches and late events."""
    schema = "event_id long, ts timestamp, what string, value string"
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def run(*new):
        spark.createDataFrame(list(new), "event_id long, ts string, what string, value string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(feed)
        write_ = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}")
        st.follow(st.setting_requests(spark.readStream.schema(schema).parquet(feed)), write_, str(tmp_path / "c")).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect())

    day = "2024-01-01 00:00:0"
    assert run((1, f"{day}1", "settings", "a"), (2, f"{day}2", "settings", "a"), (3, f"{day}1", "folders", None), (4, f"{day}3", "settings", "b")) == [1, 3, 4]
    assert run((5, f"{day}4", "settings", "b"), (6, f"{day}4", "folders", "x")) == [1, 3, 4, 6]
    assert run((7, f"{day}2", "settings", "z"), (8, f"{day}5", "settings", "a")) == [1, 3, 4, 6, 8]


def test_globs_by_their_parts(spark):
    """Files meet globs by parts of their paths; the result is that of one alternation for every file."""
    r = random.Random(3)
    names = ["src", "lib", "a.tar.gz", "b.log", "node_modules", ".git", "x", "main.py", "a{b}", "c[d]", "e.f", "déjà", "a+b.log", "xy"]
    paths = sorted({"/r%d/" % r.randint(1, 3) + "/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(400)})
    globs = ["**/node_modules", "**/*.log", "src/*.py", "lib/**", "**/.git/**", "*", "**/x**/y", "**/{src/x,lib}/e.f", "**/[ab].*", "**/a+b.log", "x**/y", "**/*.gz", "e.f/*", "**/déjà/?", "a/**/xy", "!x"]
    capped = spark.createDataFrame([("/r1", globs[:9]), ("/r2", globs[9:]), ("/r9", ["*"])], "root string, globs array<string>")
    rows_ = [(p[:3], p, k) for k, p in enumerate(paths)] + [("/r1", "elsewhere/b.log", -1), ("/r1", "/r1/x/b.log", -2)]
    df = spark.createDataFrame(rows_, "root string, path string, key long")
    for tree_ in (True, False):
        own = {"/r1": re.compile(any_regex(globs[:9], tree_, "/r1")), "/r2": re.compile(any_regex(globs[9:], tree_, "/r2"))}
        want = sorted(k for root, p, k in rows_ if not (root in own and own[root].match(p)))
        assert sorted(x["key"] for x in scan.apply_ignore(df, capped, tree_).collect()) == want
    assert all(k is None or k in path_keys(p) for p in paths for g in globs if (k := literal_key(g)) or True if re.match(glob_to_regex(g, True), p))
    assert literal_key("**/*.py[cod]") is None and literal_key("a/b*/c.txt") == "=c.txt" and literal_key("*.min.js") == ".min.js"


def test_highlights_of_short_queries(spark):
    q = spark.createDataFrame([(1, "lo"), (2, "hello WO"), (3, "zz")], "query_id long, query string")
    got = highlights(q, ix.build_index(docs(spark, a="say hello\nhello world", b="lo")))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, 7, 9), (1, "a", 2, 3, 5), (1, "b", 1, 0, 2), (2, "a", 2, 0, 5), (2, "a", 2, 6, 8)]


def test_changes_that_ignore_files_rule_out(spark, tmp_path):
    """As an option: the longest root's rules count for a changed path; deletes go through."""
    rules = spark.createDataFrame([("/w", ["**/*.log", "**/tmp/**"]), ("/w/in", ["**/x.txt"])], "root string, globs array<string>")
    some = spark.createDataFrame([("/w/a.txt",), ("/w/a.log",), ("/w/tmp/b.txt",), ("/w/in/a.log",), ("/w/in/x.txt",), ("/else/x.log",)], "path string")
    assert rows(scan.not_ignored(some, rules)) == [("/else/x.log",), ("/w/a.txt",), ("/w/in/a.log",)]
    at, feed = str(tmp_path / "index"), str(tmp_path / "feed")
    write_index(docs(spark, **{"/w/old.log": "old", "/w/a.txt": "old"}), at, parts=1)
    day = "2024-01-01 00:00:0"
    events(spark, [(1, "/w/a.txt", "change", f"{day}1", 5, 9), (2, "/w/new.log", "create", f"{day}2", 5, 9), (3, "/w/old.log", "delete", f"{day}3", 0, 0)]).coalesce(1).write.parquet(feed)
    from tessella.sources.files import read_changes

    load = lambda c: c.select("path", "mtime", F.lit("new").alias("text"))
    st.apply_changes(read_changes(spark, feed), at, load, [], str(tmp_path / "c"), ignore=lambda: rules).awaitTermination()
    assert rows(read_index(spark, at)["text"]) == [("/w/a.txt", "new")]
