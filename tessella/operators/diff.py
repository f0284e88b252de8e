"""The current listing against the stored one, by path; texts take no part.

Folders are compared first, by sums of hashes of their files: of a corpus that did not change no
file is joined. A folder that differs is compared file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_prints(files: DataFrame) -> DataFrame:
    """folder, n, a, b: how many files stand in each folder, and two sums of hashes of path and mtime, which do not depend on the order of rows. A table of its own for a listing that is compared often."""
    own = files.select(_folder().alias("folder"), F.xxhash64("path", "mtime").alias("h"), F.xxhash64("mtime", "path").alias("g"))
    # Sums of halves: they never overflow.
    half = lambda c, k: F.sum(F.shiftrightunsigned(c, k).bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = F.array(half("h", 0), half("h", 32), half("g", 0), half("g", 32))
    return own.groupBy("folder").agg(F.count("*").alias("n"), sums.alias("sums"))


def _folder() -> Column:
    return F.regexp_replace("path", "/?[^/]*$", "")


def changed_folders(current: DataFrame, stored: DataFrame) -> DataFrame:
    """folder: those whose files are not the same on both sides."""
    old = folder_prints(stored).select("folder", F.struct("n", "sums").alias("old"))
    both = folder_prints(current).select("folder", F.struct("n", "sums").alias("now")).join(old, "folder", "full")
    return both.filter(~F.col("now").eqNullSafe(F.col("old"))).select("folder")


def _in(files: DataFrame, folders: DataFrame) -> DataFrame:
    return files.join(folders, _folder().eqNullSafe(F.col("folder")), "left_semi")


def diff_changed(current: DataFrame, stored: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Files without a stored row, or with another mtime, older ones too. folders: ``changed_folders``, if they are known; only their files are compared."""
    folders = changed_folders(current, stored) if folders is None else folders
    old = _in(stored, folders).select("path", F.col("mtime").alias("__stored"))
    return _in(current, folders).join(old, "path", "left").filter(~F.col("mtime").eqNullSafe(F.col("__stored"))).drop("__stored")


def diff_deleted(current: DataFrame, stored: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    folders = changed_folders(current.select("path", "mtime"), stored) if folders is None else folders
    return _in(stored, folders).join(_in(current.select("path"), folders), "path", "left_anti")


def current_paths_except(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.select("path").subtract(current.select("path"))


def scan_report(current: DataFrame, stored: DataFrame) -> DataFrame:
    """listed, to_index, deleted: one row from one full outer join."""
    both = current.select("path", F.col("mtime").alias("now"), F.lit(True).alias("here")).join(stored.select("path", F.col("mtime").alias("old"), F.lit(True).alias("there")), "path", "full")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return both.agg(count(F.col("here")).alias("listed"), count(F.col("here") & ~F.col("now").eqNullSafe(F.col("old"))).alias("to_index"), count(F.col("here").isNull()).alias("deleted"))
