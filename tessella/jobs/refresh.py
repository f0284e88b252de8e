"""Refresh: scan, compare with the stored listing, index what changed, take out what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.globs import any_regex
from tessella.operators import scan
from tessella.operators.diff import changed_folders, diff_changed, diff_deleted
from tessella.sources.files import folders_of, hidden_files, list_roots, qualified, read_files, read_hidden, read_listed
from tessella.sources.store import materialized, read_meta, update_index, write_index


def create(spark: SparkSession, roots: list[str], index_dir: str, settings: DataFrame | None = None, folded: bool = True) -> str:
    """settings: source_prio, glob, enabled of the exclude settings, over the defaults."""
    return write_index(_docs(spark, roots, listing(spark, roots, settings)), index_dir, folded)


def refresh(spark: SparkSession, roots: list[str], index_dir: str, settings: DataFrame | None = None) -> str | None:
    """The version written, or None if nothing changed."""
    listed, stored = listing(spark, roots, settings), read_meta(spark, index_dir)
    folders = materialized(changed_folders(listed, stored))
    changed = materialized(diff_changed(listed, stored, folders))  # only these files are opened
    return update_index(spark, index_dir, _docs(spark, roots, changed), diff_deleted(listed, stored, folders))


def excludes(spark: SparkSession, settings: DataFrame | None = None) -> DataFrame:
    """glob: the defaults, as the setting that any other overrides, merged with the settings."""
    rows = spark.createDataFrame([(-1, g, True) for g in scan.DEFAULT_EXCLUDES], "source_prio int, glob string, enabled boolean")
    return scan.merge_excludes(rows if settings is None else rows.unionByName(settings.select("source_prio", "glob", "enabled")))


def scan_files(files: DataFrame, ignore_lines: DataFrame, globs: DataFrame, limit: int = scan.MAX_IGNORE) -> DataFrame:
    """The files (root, path, size, ...) that neither the exclude globs nor the ignore lines of their root rule out and that may be indexed."""
    capped = scan.cap_ignore(scan.parse_ignore(ignore_lines), limit, globs)
    # A root without ignore files has the excludes alone.
    bare = files.select("root").distinct().join(capped, "root", "left_anti").join(F.broadcast(globs.agg(F.collect_set("glob").alias("globs"))), F.lit(True))
    return scan.is_indexable(scan.apply_ignore(files, capped.select("root", "globs").unionByName(bare.select("root", "globs"))))


def listing(spark: SparkSession, roots: list[str], settings: DataFrame | None = None) -> DataFrame:
    """root, path, mtime, size of the files to index, written once since the comparison reads it twice. Of nested roots the longest counts."""
    globs, own = materialized(excludes(spark, settings)), sorted((qualified(spark, r) for r in roots), key=len, reverse=True)
    found = list_roots([read_files(spark, [r]).select("path", "mtime", "size") for r in own])
    in_root = lambda r: F.when(F.startswith("path", F.lit(r + "/")), F.lit(r))
    plain = materialized(found.withColumn("root", F.coalesce(*[in_root(r) for r in own])))
    top = spark.createDataFrame([(r, r) for r in own], "root string, path string")
    names = [r["glob"] for r in globs.collect()]  # settings: some hundred
    skip = "|".join(any_regex(names, True, r) for r in own)
    hidden = hidden_files(folders_of(plain).union(top).distinct(), skip).groupBy("path").agg(F.max_by(F.struct("root", "mtime", "size"), F.length("root")).alias("x")).select("path", "x.*")
    files = materialized(plain.unionByName(hidden))
    return materialized(scan_files(files, ignore_lines(files), globs))


def ignore_lines(files: DataFrame) -> DataFrame:
    """root, dir (relative to the root), line_no, line of the ignore files among the files."""
    some = files.filter(scan.is_ignore_file(F.col("path")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    held = read_hidden(some).join(some.select("path", "root"), "path")
    folder = F.regexp_replace(_below_root(), "/?[^/]*$", "")
    return held.select("root", folder.alias("dir"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _below_root() -> Column:
    return F.substring("path", F.length("root") + 2, F.length("path"))


def _docs(spark: SparkSession, roots: list[str], files: DataFrame) -> DataFrame:
    """path, mtime, text of the listed files, of which alone the content is read: decoded and tried for binary bytes in the same step."""
    content = read_listed(spark, files.select("path", "mtime", "size"), [qualified(spark, r) for r in roots])
    text = F.make_valid_utf8(F.col("content").cast("string"))
    docs = content.select("path", "mtime", text.alias("text"), scan.sniff_binary(F.col("content")).alias("binary"))
    return scan.blank_binary(docs, F.col("binary")).select("path", "mtime", "text")
