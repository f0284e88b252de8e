"""Licence scans by canonical digest.

A text is made canonical: lower case, lines that only state a copyright dropped,
everything but letters and digits one blank, equivalent spellings joined. The
digest of the entire text is hash-joined to those of known licences, and the
digests of its entire lines to those of known notices. Up to KNOWN_BROADCAST known
texts their digests are broadcast; a longer list is joined by digest like any table.

Cases: null and empty texts, and texts of copyright lines and punctuation only,
have a null digest and no licence; rows equal in doc_id and text are judged
alike, one output row each; a null doc_id is a value like others; an empty table
gives an empty result; texts are taken whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.licence_texts import EQUIVALENT, FORMS, NOTICES, TEXTS

#: Digests of 32 characters and an id: some 10 MB.
KNOWN_BROADCAST = 100_000
COPYRIGHT_LINE = r"(?md)^[ \t*#/;-]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
NEITHER = r"[^\p{L}\p{N}\n]+"
BREAKS = r"[ \n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation; line ends stay."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, ""), NEITHER, " ")
    for spelling, one in EQUIVALENT:
        c = F.replace(c, F.lit(spelling), F.lit(one))
    return c


def digest(canonical: Column) -> Column:
    one = F.trim(F.regexp_replace(canonical, BREAKS, " "))
    return F.when(one != "", F.md5(one))


def known(docs: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """digest, licence."""
    df = docs.sparkSession.createDataFrame(rows, "licence string, text string")
    own = df.select(digest(canonical_lines(F.col("text"))).alias("known"), "licence").groupBy("known").agg(F.min("licence").alias("licence"))
    return F.broadcast(own) if len(rows) <= KNOWN_BROADCAST else own


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS + FORMS, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest, licence (of the entire text, or null), notices (ids of entire lines, sorted, joined by blanks), n_notice_lines."""
    d = docs.select("doc_id", canonical_lines(F.col("text")).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select("doc_id", F.xxhash64("c").alias("version"), digest(F.col("c")).alias("digest"), F.transform(lines, lambda x: F.md5(x)).alias("lines"))
    d = cut(d)
    by_line = known(docs, notices).withColumnRenamed("licence", "notice")
    hits = d.select("doc_id", "version", F.posexplode("lines").alias("line", "known")).join(by_line, "known")
    # The same line of a repeated row is one hit.
    hits = hits.select("doc_id", "version", "line", "notice").distinct()
    per_row = hits.groupBy(F.col("doc_id").alias("i"), F.col("version").alias("v")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("notice"))).alias("notices"), F.count("*").alias("n_notice_lines"))
    whole = known(docs, texts).withColumnRenamed("known", "k")
    out = d.join(whole, F.col("digest") == F.col("k"), "left")
    out = out.join(per_row, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))
