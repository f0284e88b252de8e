"""Toxicity, conversation repair and source divergence: against plain versions, whole tables of odd rows, groups that stand in many tasks."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import conversations, divergence, toxicity
from tessella.llm.oracles import ORACLES
from tests.compare import rows_of, sql_rows
from tests.llm import brute

ROWS = "conv_id long, turn long, role string, text string, gaps string, part int, digest string, fault int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], ROWS)


def same_as_sql(spark, tmp_path, table, df, sql, result):
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    out = result(spark.read.parquet(str(tmp_path / f"{table}.parquet")))
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == sql_rows(str(tmp_path), sql)
    return out


def test_repair_by_brute_force(spark):
    """All edits of all short conversations of some kinds of rows."""
    r = random.Random(4)
    kinds = [("user", "a."), ("assistant", "b!"), ("system", "s."), ("user", "open"), ("assistant", "open "), ("user", " \t"), ("tool", "t."), ("system", "no end"), ("", "x?"), ("user", "a.")]
    rows, want = [], {}
    for c in range(60):
        own = [r.choice(kinds) for _ in range(r.randint(0, 3) if c % 3 else 4)]
        own.sort()  # rows of equal turn are ordered by role and digest, so that turns decide here
        r.shuffle(own)
        rows += [(c, t, *x) for t, x in enumerate(own)] or [(c, 0, None, None)]
        want[c] = brute.repair(own, 2 if len(own) < 4 else 1)
    got = conversations.repair(clashing(spark, rows)).collect()
    assert {x["conv_id"]: (x["cost"], x["audit"], x["repaired_sha256"]) for x in got} == {c: (k, a, hashlib.sha256(t.encode()).hexdigest()) for c, (k, a, t) in want.items()}
    text = {}
    for x in conversations.repaired_rows(clashing(spark, rows)).orderBy("conv_id", "part", "at").collect():
        text.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
    assert {c: "\n".join(t) for c, t in text.items()} == {c: t for c, (_, _, t) in want.items() if t}


def test_repair_of_long_and_odd_conversations(spark, tmp_path):
    """One conversation holds most rows and stands in many tasks; nulls in every column, rows of equal turn, repeated rows."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["yes.", "no!", "x", f"text {t}.", f"more {t}", " "])) for t in range(400)]
    rows += [(c, t, *x) for c in (None, 1, 2, 9, 3) for t, x in enumerate([("user", "é 中.\nline"), ("assistant", None), (None, "x."), ("user", "🙂!"), ("assistant", "z." * 2000)])]
    rows += [(4, None, "user", "n."), (4, None, "user", "n."), (4, None, None, None), (4, 3, "assistant", "m."), (4, 3, "assistant", "k."), (4, 3, "assistant", "m."), (4, 8, "user", "n.")]
    out = same_as_sql(spark, tmp_path, "conversations", clashing(spark, rows).repartition(3), ORACLES["op12_conversation_repair"], lambda df: conversations.repair(conversations.damaged(df)))
    assert out.count() == 7
    before = out.filter("conv_id = 7").collect()
    for n in (1, 3, 31):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert conversations.repair(conversations.damaged(clashing(spark, rows))).filter("conv_id = 7").collect() == before
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert conversations.repair(clashing(spark, rows).limit(0)).count() == 0


def test_divergence_of_odd_rows(spark, tmp_path):
    """Few and many groups to a term, null columns, groups without terms, a language without kept terms: as SQL has it, wherever heavy and light part."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "ÀB", "中文", "x-y", "İ"]
    rows = []
    for i in range(700):
        source = min(11, int(r.expovariate(0.4)))
        own = [w for k, w in enumerate(words) if r.random() < (0.9 if k % 12 == source else 0.25 if k % 7 == 0 else 0.05)]
        rows.append((i % 300, r.choice(["en", "en", None]), f"s{source}" if source < 9 else None, " ".join(x.upper() if r.random() < 0.2 else x for x in own * r.randint(1, 3))))
    rows += [(1, "en", "empty", None), (2, "en", "empty", ""), (3, "de", "a", "few words"), (4, "de", "b", None), (None, None, None, None), (5, "fr", "alone", "1 2 3")]
    rows += [(6, "en", "rare", "q" * 70_000)] * 2
    df = spark.createDataFrame([(*x, 1, "z", 2) for x in rows], "doc_id long, lang string, source string, text string, n long, term string, i int").repartition(5)
    first = same_as_sql(spark, tmp_path, "documents", df, ORACLES["op13_source_divergence"], divergence.audit)
    want = sorted(map(tuple, first.collect()))
    for light in (0, 3, 100):
        assert sorted(map(tuple, divergence.audit(df, light_groups=light).collect())) == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_tiles_of_many_sources(spark, monkeypatch):
    """Sources in several blocks: the same distances as in one."""
    r = random.Random(7)
    rows = [(i, "en", f"s{i % 11}", " ".join(f"t{chr(97 + k)}" for k in range(20) if r.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    whole = sorted(map(tuple, divergence.audit(df).collect()))
    monkeypatch.setattr(divergence, "TILE_SOURCES", 4)
    monkeypatch.setattr(divergence, "TILE_TERMS", 5)
    assert sorted(map(tuple, divergence.audit(df).collect())) == whole and sorted(map(tuple, divergence.audit(df, light_groups=0).collect())) == whole
    assert len([x for x in whole if x[2] == "pair"]) == 110


def test_kernel():
    """Kernel values of words with gaps and inserted characters, and the folded table, against sums over all triples."""
    decay = (toxicity.SPAN, toxicity.LETTER_GAP, toxicity.MARK_GAP)
    spell = lambda w: (["^", *[c for c in w if c.isalpha()], "$"], [0, *[len([x for x in g if not x.isalpha()]) for g in _before(w)], 0])
    names = ["idiot", "clown", "thing"]
    marks = toxicity.Landmarks([f"^{n}$" for n in names])
    words = ["idiot", "id-iot", "i.d.i.o.t", "idxiot", "clowns", "the", "a", "bananana"]
    s = toxicity.Strings([" ".join(words)])
    got = s.with_landmarks(marks.rows, marks.matrix)[s.which]
    want = np.array([[brute.kernel(spell(w), spell(n), *decay) for n in names] for w in words])
    assert np.allclose(got, want, atol=1e-5)
    weights = np.array([1.0, -2.0, 0.5])
    assert np.allclose(s.folded(marks.fold(weights))[s.which], want @ weights, atol=1e-5)
    assert got[1, 0] > 0.6 and got[2, 0] > 0.6 and got[3, 0] > 0.5 and got[5, 0] < 0.1
    # Single letters between blanks are one string; a long string is cut, and no triple is lost.
    assert len(toxicity.Strings(["i d i o t "]).first) == 1 and len(toxicity.Strings(["i d i o t, a b"]).first) == 3 and len(toxicity.Strings(["a cat b dog"]).first) == 4
    long = toxicity.Strings(["x" * 23 + "idiot" + "y" * 30])
    table = toxicity.Landmarks(["idiot"])
    assert len(long.first) == 3 and sum(float((table.rows[t][w > 0] > 0).sum()) for t, w in long.triples()) >= 8
    assert len(toxicity.Strings(["", "1 2 3", " "]).first) == 0


def _before(word: str) -> list[str]:
    out, held = [], ""
    for c in word:
        if c.isalpha():
            out.append(held)
            held = ""
        else:
            held += c
    return out


def test_toxicity(spark):
    """Held-out labels, gapped insults, odd rows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    some = docs.join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id").select("doc_id", "text", "toxic")
    flagged = {(r["toxic"], r["p"]): r["count"] for r in toxicity.score(some, model).join(some.select("doc_id", "toxic"), "doc_id").groupBy("toxic", (F.col("score") >= toxicity.THRESHOLD).alias("p")).count().collect()}
    assert flagged[1, True] > 0.85 * (flagged[1, True] + flagged[1, False]) and flagged.get((0, True), 0) < 0.01 * flagged[0, False]
    plain = "The and of thing erthe is on the house with that one and more of them. "
    texts = [plain + "What an idiot, a stupid clown!", plain + "What an i.d.i.o.t, a st-upid cl_own!", plain + "What an i d i o t, a stuppid clxown!", plain + "On the house.", None, "", " 1 2 !", plain * 3000 + "idiot"]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, None, "x", 1.0), (0, texts[0], "x", 1.0)], "doc_id long, text string, spans string, score double")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(rows, model).collect()]
    by = dict(got)
    assert len(got) == 10 and min(by[0], by[1], by[2]) > toxicity.THRESHOLD and max(by[3], by[4], by[5], by[6]) < 0.3 and len({x for i, x in got if i == 0}) == 1
    spans = {r["doc_id"]: r["spans"] for r in toxicity.toxic_spans(rows, model).collect()}
    assert {texts[1][s["start"] : s["end"]] for s in spans[1]} <= {"i.d.i.o.t", "st-upid", "cl_own"} and spans[1] and not spans[5]
    assert toxicity.held_out_report(rows.limit(0), labels).count() == 0
    nothing = toxicity.held_out_report(rows, labels.limit(0)).collect()
    assert len(nothing) == 10 and {r["score"] for r in nothing} == {0.0}
