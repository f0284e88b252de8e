"""Results on the smallest tables and the defined edge cases of every operator."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, language, licences, mixing, neardup, phrases, quality, repeats, urls, vectors
from tessella.llm.oracles import ORACLES
from tessella.llm.queries import QUERIES, URL_RULES, vocabulary_path
from tests.compare import rows_of, sql_rows
from tests.llm import brute

CLASH = ["did", "gone", "size", "__key", "__h", "hub", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, equal ids with different texts."""
    shared, long = passage(1, 60), passage(2, 30_000)
    texts = [
        (1, f"{shared} one"), (2, f"two {shared}"), (2, f"two {shared}"), (3, shared), (3, passage(3, 40)), (4, None), (5, ""), (6, " \n\t "),
        (None, shared), (None, None), (7, long), (8, long + " tail"), (9, "ab " * 200), (10, "x"), (11, "x"), (12, "a b"), (13, "\0 \x1c é 中文 🙂 " * 9),
        (14, "same line here\n" * 30), (15, "### $$$ *** ### %%% " * 12),
    ]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None, *["x"] * len(CLASH)) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs() -> list[tuple]:
    return [r[:2] for r in odd_rows()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = sql_rows(sf_dir, ORACLES[name])
    assert (columns, got) == (want_columns, want)


def test_suffix_dedup(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    some = [tuple(r) for r in docs.collect()]
    assert rows(repeats.dedup_report(docs)) == sorted(brute.op3(some), key=str)
    assert rows(repeats.dedup_report(odd)) == sorted(brute.op3(pairs()), key=str)
    assert rows(repeats.dedup_report(empty)) == []


def test_repeat_groups(spark):
    x, y = passage(8, 40), passage(9, 40)
    texts = {1: f"A {x} B", 2: f"C {x} D {y} E", 3: f"F {y} G {x} H", 4: passage(10, 60)}
    groups: dict = {}
    for r in repeats.repeat_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        groups.setdefault((r["bucket"], r["node"]), []).append((r["doc_id"], r["start"], r["length"]))
    covered = {d: set() for d in texts}
    for g in groups.values():
        assert len({texts[d][s : s + n] for d, s, n in g}) == 1 and g[0][2] >= repeats.LENGTH
        for d, s, n in g:
            covered[d] |= set(range(s, s + n))
    want = lambda d: {p for t in (x, y) if t in texts[d] for p in range(texts[d].index(t), texts[d].index(t) + len(t))}
    assert all(covered[d] >= want(d) and len(covered[d] - want(d)) <= 8 for d in texts)
    assert max(len(g) for g in groups.values()) == 3


def test_substring_dedup(spark, sf_dir, odd, empty):
    def check(df, some):
        cut = brute.op6(some)
        want = []
        for n, (i, t) in enumerate(some):
            kept = [w for w, c in zip((t or "").encode().split(), cut[n], strict=True) if not c]
            want.append((i, len(cut[n]), sum(cut[n]), hashlib.sha256(b" ".join(kept)).hexdigest()))
        assert rows(phrases.dedup_report(df)) == sorted(want, key=str)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(docs, [tuple(r) for r in docs.collect()])
    check(odd, pairs())
    assert rows(phrases.dedup_report(empty)) == []
    out = phrases.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    kept = {r["doc_id"]: r["text"] for r in out.filter("doc_id in (1, 4, 5, 13)").collect()}
    before = {i: t for i, t in pairs()}
    assert all(kept[i] == before[i] for i in kept)
    assert phrases.dedup_documents(empty).count() == 0


def test_windows_in_runs(spark):
    """Windows inside long runs of one word and of a pair of words have no higher symbol, and are found all the same."""
    some = [(1, "a " * 40), (2, "b " + "a " * 13), (3, "x y " * 20), (4, "q " + "y x " * 9), (5, "a " * 12)]
    cut = brute.op6(some)
    got = {r["doc_id"]: r["n_removed"] for r in phrases.dedup_report(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == {i: sum(cut[n]) for n, (i, _) in enumerate(some)}


def test_near_dedup(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    some = [tuple(r) for r in docs.collect()]
    for k, percent in ((3, 85), (5, 80)):
        assert {r["doc_id"]: r["component_id"] for r in neardup.components(docs, k, percent).collect()} == brute.links(some, k, percent)
    got = neardup.components(odd, 3, 85).collect()
    want = brute.links(pairs(), 3, 85)
    assert len(got) == len(pairs())
    assert all(r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)
    kept = neardup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([i for i in want if want[i] == i] + [3] * (want[3] == 3)) and ids.count(None) == 2
    assert neardup.components(empty, 3, 85).count() == 0 and neardup.keep_one(empty).count() == 0


@pytest.mark.parametrize("hot", [1000, 5])
def test_near_copies_without_a_hub(spark, monkeypatch, hot):
    """A group in which the smallest id is similar to few: links lead from copy to copy. hot: from how many rows on a key is dealt in parts."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    base, r = passage(20, 120).split(), random.Random(5)
    some = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 9999)}"
        some.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in neardup.components(spark.createDataFrame(some, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute.links(some, 3, 85)


def test_near_dedup_goes_on_from_components(spark, monkeypatch):
    """A later search for components gets a star for each that is known, not all earlier links again, and what is read once is not written."""
    base, r = passage(20, 120).split(), random.Random(5)
    some = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 9999)}"
        some.append((i, " ".join(w)))
    written, searches, write, search = [], [], neardup.cut, neardup.connect
    monkeypatch.setattr(neardup, "cut", lambda df: written.append(df) or write(df))

    def watched(edges):
        out = search(edges)
        searches.append(({tuple(e) for e in edges.collect()}, {(x["component"], x["node"]) for x in out.collect()}))
        return out

    monkeypatch.setattr(neardup, "connect", watched)
    got = {x["doc_id"]: x["component_id"] for x in neardup.components(spark.createDataFrame(some, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute.links(some, 3, 85)
    for (before, stars), (now, _) in itertools.pairwise(searches):
        assert stars <= now and not (now - stars) & before
    assert len(searches) == 3 and len(written) <= 22


def test_components_take_few_rounds(spark, monkeypatch):
    """Stars are known without another round; what a round writes has no partitioning, which would keep Spark from using its exchanges twice."""
    written, write = [], neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: written.append(df) or write(df))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for rows, rounds in (([], 0), ([(1, 2), (3, 1), (9, 8), (5, 5)], 0), ([(2, 3), (1, 3)], 1), ([(i, i + 1) for i in range(40)] + [(50, 60), (55, 60)], 9)):
        written.clear()
        got = {tuple(r) for r in neardup.connect(edges(rows)).collect()}
        low = {x: x for e in rows for x in e}
        for _ in low:
            for x, y in rows:
                low[x] = low[y] = min(low[x], low[y])
        assert got == {(x, y) for x, y in low.items() if x != y} and len(written) <= rounds + 1
        assert all("Unknown" in df._jdf.queryExecution().executedPlan().outputPartitioning().toString() for df in written)


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://EXAMPLE.com/en/x?y": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.net/es/q#z": ("a.net", "/es/q", "net/es/", "block"),
        "http://com": ("com", "", None, "allow"), "http://xcom/": ("xcom", "/", None, "allow"), "x://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://com?://net/es/": ("com", "", None, "allow"), "http://" + "a." * 3000 + "net/fr/" + "b" * 9000: ("a." * 3000 + "net", "/fr/" + "b" * 9000, "net/fr/", "block"),
    }
    df = spark.createDataFrame([(n, u, "x") for n, u in enumerate(cases)] + [(None, None, "x")], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, URL_RULES).collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values()) and got[None][3] == "allow"
    assert urls.judge(df.limit(0), URL_RULES).count() == 0 and urls.judge(df, []).filter("verdict <> 'allow'").count() == 0


def test_rules_in_several_arrays(spark, monkeypatch):
    """However the rules are cut, and however few candidates are looked up at once, the verdicts are the same."""
    urls_ = ["http://www.example.com/en/a", "http://example.com/en/", "http://a.net/fr/", "http://b.com/", "http://x/", None, "http://" + "a.b." * 15_000 + "net/es/", "http://example.com/en/" + "/" * 9000]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    want = rows(urls.judge(df, URL_RULES))
    monkeypatch.setattr(urls, "MAX_BYTES", 40)
    monkeypatch.setattr(urls, "CANDIDATES", 3)
    assert len(urls.arrays(URL_RULES)) == 5 and rows(urls.judge(df, URL_RULES)) == want
    assert {r[0]: r[3] for r in want} == {0: "www.example.com/en/", 1: "example.com/en/", 2: "net/fr/", 3: "com/", 4: None, 5: None, 6: "net/es/", 7: "example.com/en/"}


def test_long_hosts(tmp_path):
    """Of a host with very many labels only those a rule can have are looked at."""
    (tmp_path / "r").write_bytes(urls.arrays(URL_RULES)[0])
    array = urls.RuleArray(str(tmp_path / "r"))
    assert list(array._suffixes(b"a.b.example.com")) == [b"com", b"example.com", b"b.example.com", b"a.b.example.com"] and list(array._suffixes(b"")) == [] and list(array._suffixes(b"com")) == [b"com"]
    assert len(list(array._suffixes(b"ab." * 30_000 + b"net"))) == 5


def test_colliding_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    (tmp_path / "r").write_bytes(urls.arrays(URL_RULES)[0])
    array = urls.RuleArray(str(tmp_path / "r"))
    assert array.probe([(b"a.example.com", b"/en/1"), (b"b.org", b"/en/")]) == [(b"example.com/en/", False), (None, False)]


def test_mix(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.max(F.col("taken") / F.col("size")).alias("x")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"] and r["x"] <= 3
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert mixing.mixed_documents(docs).count() == sum(copies.values())


def test_quality(spark, odd, empty, sf_dir):
    assert quality.assess(odd).count() == odd.count() and quality.assess(empty).count() == 0
    bad = {r["doc_id"] for r in quality.assess(odd).filter("base_failed").collect()}
    assert {4, 5, 6, 9, 10, 11, 12, 14} <= bad
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet")
    r = quality.assess(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {x["quality"]: x["k"] for x in r}
    assert share[1] > 0.99 and share[0] < 0.2
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns


def test_licences(spark, odd, empty):
    from tessella.llm.licence_texts import TEXTS

    mit = dict(TEXTS)["MIT"]
    texts = [mit, f"Copyright (c) 2020 Some One\n\n{mit.upper()}", mit.replace(" ", "\n"), mit + " more", "x\nReleased under the MIT license!\nLicensed under the  apache licence version 2.0\nReleased under the MIT license", "", None]
    got = licences.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")).collect()
    assert len(got) == 2 * len(texts)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["licence"] for i in range(7)] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert (by[4]["notices"], by[4]["n_notice_lines"]) == ("Apache-2.0 MIT", 3)
    assert licences.scan(odd).count() == odd.count() and licences.scan(empty).count() == 0


def test_language(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    r = language.held_out_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() > 0.98 * r.count()
    model = language.fit(docs)
    got = {x["doc_id"]: x for x in language.predict(odd, model).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[15]["lang_pred"] == "und" and got[15]["score"] == 0
    mixed = "The end of that with these and the for. " * 3 + "Les maisons avec une rue dans la ville pour que. " * 3
    spans = language.spans(spark.createDataFrame([(1, mixed), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x["lang"] for x in spans[0]["spans"]][0] == "en" and [x["lang"] for x in spans[0]["spans"]][-1] == "fr" and spans[1]["spans"] == []
    assert language.held_out_report(empty).count() == 0 and language.held_out_report(odd).count() == odd.count()


def test_bpe(spark, odd, empty, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = [t or "" for _, t in pairs()] + ["<|endoftext|>", "a <|endoftext|> b <|endoftext|><|endoftext|>", "it's I'll", "a  b \n c", "\ud7ff \xa0x", "=" * 700, "Zz" * 400]
    r = random.Random(1)
    texts += ["".join(r.choice("ab C.'!\n\t  é日1½_<|>\0\x1c\u3000😀") for _ in range(r.randint(1, 50))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode(df, vocabulary_path())
    got = {x["doc_id"]: x["ids"] for x in coded.collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {x["doc_id"]: x["text"] for x in bpe.decode(coded, vocabulary_path()).collect()} == dict(enumerate(texts))
    assert bpe.round_trip(empty, vocabulary_path()).count() == 0
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, sha(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in pairs()), key=str)
    assert rows(bpe.round_trip(odd, vocabulary_path()).select("doc_id", "ids_sha256", "decoded_sha256")) == want


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows_ = [(i, r.normal(size=8).round(2).tolist(), "x") for i in range(900)]
    rows_ += [(i, rows_[5][1], "x") for i in range(900, 940)]  # ties
    rows_ += [(2000, None, "x"), (2100, [], "x"), (2200, [1.0, None] * 4, "x"), (2300, [float("nan")] * 8, "x"), (2400, [1.0, 2.0], "x"), (None, [1.0] * 8, "x"), (7, rows_[7][1], "x")]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, score string")
    got = rows(vectors.top_k(df, F.col("id") % 50 == 0, 10))
    ok = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v, _ in rows_ if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)
    assert vectors.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
