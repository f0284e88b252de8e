"""Mixing sources to target weights by nested hash-threshold histograms.

A source of ``size`` words and target ``t`` is taken ``t // size`` times whole;
the rest of the budget goes to the documents whose hash lies below a threshold.
The threshold is found without sorting: word counts are summed per source and
leading hash bits, the bucket in which the budget ends is looked up, and only
documents of that bucket go to the next, finer histogram. Only DataFrame
functions run.

The tables of targets and thresholds have one row per source. They are broadcast
up to a bound and beyond it joined so that a source's rows are dealt in parts
(``common.group_join``); histograms meet their source and prefix, of which a hot
source has many.

Cases: null text counts 0 words; a null source comes last and has a weight like
others; a null doc_id hashes like an empty string; rows with equal doc_id and
source share a hash and are taken together; a source without words has target
0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import WORD, cut, group_join, guarded

MAX_REPEATS = 3
CYCLE = 3
#: 60 hash bits in levels of 12: a histogram has at most 4096 rows per source.
LEVEL_BITS, LEVELS = 12, 5


def doc_hash(doc_id: Column) -> Column:
    """60 bits of md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """The input's columns with size and __h."""
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__h": doc_hash(F.col("doc_id"))})


def targets(sized: DataFrame) -> DataFrame:
    """source, n (its rows), source_size, weight, target. There is one row per source, so the windows below see a short table.

    The weights share all words; a target stops at MAX_REPEATS times its source,
    and the excess is shared again. The fixed point is min(cap, level * weight)
    with one level for all, found from prefix sums over cap / weight.
    """
    s = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = s.withColumn("weight", ((F.row_number().over(by_name) - 1) % CYCLE + 1).cast("long"))
    s = s.withColumn("cap", MAX_REPEATS * F.col("source_size"))
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, every = fullest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    s = s.withColumn("level", F.when(F.col("cap") * F.col("left_weight") > F.col("left_words") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "left_words", "left_weight")))
    level = F.min("level").over(every)
    s = s.withColumns({"w": level["left_words"], "k": level["left_weight"]})
    share = F.col("w") * F.col("weight").cast("double") / F.col("k")
    target = F.when(F.col("w").isNull() | (F.col("cap") <= share), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "n", "source_size", "weight", target.alias("target"))


def thresholds(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """source, n, source_size, target, whole, until: documents with __h < until are taken once more than ``whole`` times.

    The group of equal hashes in which the budget ends is in if that brings the
    sum nearer to the budget.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = goal.select("source", "n", "source_size", "target", whole.alias("whole"))
    t = cut(t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    at = t.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    rows = slim.select("source", "__h", "size")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        here = at.select(F.col("source").alias("s"), "prefix", "below", "rest")
        if level:
            rows = rows.join(here.select("s", "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("__h", shift + LEVEL_BITS) == F.col("prefix"))).drop("s", "prefix")
        hist = rows.groupBy("source", F.shiftright("__h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("sum", F.sum("words").over(up_to)).join(here, F.col("source").eqNullSafe(F.col("s")))
        # The bucket in which the running sum passes the budget, or the last one.
        hist = hist.withColumn("sum", F.col("sum") + F.col("below"))
        pick = F.min(F.when(F.col("sum") > F.col("rest"), F.struct("bucket", (F.col("sum") - F.col("words")).alias("below"), "words")))
        last = F.max(F.struct("bucket", (F.col("sum") - F.col("words")).alias("below"), "words"))
        at = hist.groupBy("source").agg(F.coalesce(pick, last).alias("x"), F.first("rest").alias("rest"))
        at = cut(at.select("source", "rest", F.col("x.bucket").alias("prefix"), F.col("x.below").alias("below"), F.col("x.words").alias("words")))
    until = F.col("prefix") + F.when(2 * F.col("below") + F.col("words") < 2 * F.col("rest"), 1).otherwise(0)
    end = at.select(F.col("source").alias("s"), until.alias("until"))
    return t.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")


def _with_thresholds(rows: DataFrame, t: DataFrame) -> DataFrame:
    t = cut(t.select(F.struct("source").alias("__source"), *[c for c in t.columns if c != "source"]))
    return group_join(rows.withColumn("__source", F.struct("source")), t, ["__source"], ["__h"]).drop("__source")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies, one row per input row."""
    slim = cut(sizes(docs).select("doc_id", "source", "size", "__h"))
    out = _with_thresholds(slim, thresholds(slim, targets(slim)))
    copies = F.least(F.col("whole") + F.when(F.col("__h") < F.col("until"), 1).otherwise(0), F.lit(MAX_REPEATS))
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns; one that is taken n times gives n equal rows."""

    def stage(docs: DataFrame) -> DataFrame:
        slim = cut(sizes(docs).select("source", "size", "__h"))
        t = thresholds(slim, targets(slim)).select("source", "n", F.col("whole").alias("__whole"), F.col("until").alias("__until"))
        out = _with_thresholds(docs.withColumn("__h", doc_hash(F.col("doc_id"))), t)
        copies = F.least(F.col("__whole") + F.when(F.col("__h") < F.col("__until"), 1).otherwise(0), F.lit(MAX_REPEATS)).cast("int")
        return out.withColumn("__n", F.explode(F.array_repeat(F.lit(1), copies)))

    return guarded(docs, ["doc_id", "source", "text"], stage)
