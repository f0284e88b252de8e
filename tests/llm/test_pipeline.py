"""The pipeline's stages on the smallest table, each against a plain version of what it keeps."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tessella.llm.queries import vocabulary_path
from tests.llm import brute


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids = sorted(r["doc_id"] for r in after.collect())
        if k == 0:
            assert ids == sorted(x[0] for x in brute.quality([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before]) if x[-1])
        elif k == 1:
            low = brute.links([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert ids == sorted(i for i in low if low[i] == i)
        elif k == 2:
            cut = brute.op6([(r["doc_id"], r["text"]) for r in before])
            got = {r["doc_id"]: r["text"] for r in after.collect()}
            for n, r in enumerate(before):
                want = [w for w, c in zip(r["text"].encode().split(), cut[n], strict=True) if not c]
                assert got[r["doc_id"]].encode().split() == want
        elif k == 3:
            copies = brute.mixed([(r["doc_id"], r["text"], r["source"]) for r in before])
            assert ids == sorted(i for i, n in copies.items() for _ in range(n))
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(vocabulary_path())
            text = {r["doc_id"]: r["text"] for r in before}
            for r in after.collect():
                assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert name and (k == len(corpus_pipeline.STAGES) - 1 or sorted(after.columns) == sorted(columns))
        docs = after


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ids with several texts, texts without words: every stage runs on what its predecessor kept, and clean rows go through."""
    w = [f"word{i}" for i in range(40)]
    rows = [(None, " ".join(w), "en", "a", None), (1, " ".join(w), "en", "a", 5), (1, " ".join(w), "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " ".join(w[::-1]), None, None, 7), (4, "x " + " ".join(w[5:30]), "de", None, 7), (5, " \n ", "de", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 1, 4, 4]
        if k == 1:  # the null id is linked with nothing; of equal rows one stays
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 4, 4]
    assert {r["doc_id"] for r in docs.collect()} >= {1, 4}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
