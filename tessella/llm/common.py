"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more rows than HOT_ROWS is dealt in several parts; at most MANY keys are, whatever the input.
HOT_ROWS, MANY = 1000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    may do without the setting (tests); a cluster's executors could not read a
    folder of one machine, so there it is an error.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def guarded(docs: DataFrame, needed: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on docs with all but the needed columns renamed, so that none can clash with its own; it returns the columns it got."""
    plain = docs.toDF(*[c if c in needed else f"__{k}" for k, c in enumerate(docs.columns)])
    return stage(plain).select(*plain.columns).toDF(*docs.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def hot_keys(counts: DataFrame, key: list[str]) -> DataFrame | None:
    """The key columns and __of, the number of parts in which a key's rows are dealt, for the keys with very many rows; None if there are none.

    counts: the key columns and n, its rows. The bound rises with the input: no
    more than MANY keys can have more than a MANY-th of all rows, so this table may
    always be broadcast.
    """
    rows, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = max(HOT_ROWS, rows // MANY)
    return F.broadcast(counts.filter(F.col("n") > hot).select(*key, (F.floor(F.col("n") / hot) + 1).cast("int").alias("__of"))) if top > hot else None


def dealt(rows: DataFrame, hot: DataFrame | None, key: list[str], by: list[str]) -> DataFrame:
    """The rows with __part: 0, or for a hot key one of its parts, by the hash of the columns ``by``."""
    if hot is None:
        return rows.withColumn("__part", F.lit(0))
    part = F.pmod(F.xxhash64(*by), F.coalesce("__of", F.lit(1)).cast("long")).cast("int")
    return rows.join(hot, key, "left").withColumn("__part", part).drop("__of")


def copied(rows: DataFrame, hot: DataFrame | None, key: list[str]) -> DataFrame:
    """The rows with __part, once for each part of their key (see ``dealt``)."""
    if hot is None:
        return rows.withColumn("__part", F.lit(0))
    return rows.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__of", F.lit(1)) - 1))).drop("__of")


def spread_join(rows: DataFrame, per_key: DataFrame, key: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per key, its number of rows in n, and is written (``cut``).

    A hot key's row is copied to each of the key's parts, and its rows are dealt over
    them by ``by``: no task gets all rows of one key.
    """
    hot = hot_keys(per_key, key)
    if hot is None:
        return rows.join(per_key.drop("n"), key, how)
    return dealt(rows, hot, key, by).join(copied(per_key.drop("n"), hot, key), [*key, "__part"], how).drop("__part")


def group_join(rows: DataFrame, per_key: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Every row with what ``per_key`` says of its key: up to MANY keys by broadcast, so that the rows stay where they are; beyond by ``spread_join``."""
    if per_key.count() <= MANY:
        return rows.join(F.broadcast(per_key.drop("n")), key, "left")
    return spread_join(rows, per_key, key, by, "left")


def settle(asked: DataFrame, decide, name: str, kind=None) -> DataFrame:
    """did and ``name``, one row for each document that gets an answer. kind: of a key, if it is no 64-bit number.

    asked: blocks of questions (see ``blocks``); ``decide`` answers a target's
    blocks. Rows with target -1 need no other block and are dealt by chance.
    Answers travel in blocks too, so that their rows do not follow the
    number of keys.
    """
    from tessella.llm.blocks import ANSWER, deliver

    n = shuffle_partitions(asked.sparkSession)
    spread = asked.repartition(n, F.when(F.col("target") < 0, F.xxhash64("owners")).otherwise(F.col("target").cast("long")))
    return spread.mapInArrow(decide, ANSWER).repartition(n, "target").mapInArrow(deliver(name, kind) if kind else deliver(name), f"did long, {name} binary")
