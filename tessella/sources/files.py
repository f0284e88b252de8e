"""Files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "event_id long, path string, kind string, ts timestamp, mtime long, size long"


def qualified(spark: SparkSession, root: str) -> str:
    """The root as listings show it, with its scheme and without a slash at the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def read_files(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    """path, mtime (seconds, rounded), size, content. Without content only the listing is read. Vanished files are skipped.

    Spark's readers pass over names that begin with a dot or an underscore; see ``hidden_files``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r) for r in roots]  # a root is a folder, whatever its name
    return reader.load(literal).select("path", mtime_seconds(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"), "content")


def mtime_seconds(ts):
    return F.round(F.unix_millis(ts.cast("timestamp")) / 1000).cast("long")


def is_hidden(relative: Column) -> Column:
    """Whether a part of the path begins with a dot or an underscore."""
    return relative.rlike("(^|/)[._]")


def folders_of(files: DataFrame) -> DataFrame:
    """root, path of every folder between a root and its files."""
    depth = F.size(F.split("root", "/"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(depth, F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select("root", F.explode(up).alias("path")).distinct()


def _store(uri: str):
    """A file system and the uri's path in it, and what stands before that path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file:"
    base = re.match(r"[^:/]+://[^/]*", uri)[0]
    store, at = fs.FileSystem.from_uri(base + "/")
    return store, at.rstrip("/") + uri[len(base) :], base[: len(base) - len(at.rstrip("/"))] if at.rstrip("/") else base


_FOUND = "root string, path string, mtime long, size long, folder boolean"


def _walk(skip: str, deep: bool):
    """For mapInPandas over folders (root, path): the files below them, and, if not deep, only hidden ones, and the visible folders as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        out_of = re.compile(skip)
        for df in batches:
            rows = []
            for root, folder in zip(df["root"], df["path"], strict=True):
                store, path, before = _store(folder)
                todo, visible = [path], not deep
                while todo:
                    for x in store.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                        if out_of.match(before + x.path):
                            continue
                        if x.type == fs.FileType.Directory:
                            if visible and x.base_name[0] not in "._":
                                rows.append((root, before + x.path, 0, 0, True))
                            else:
                                todo.append(x.path)
                        elif x.type == fs.FileType.File and not (visible and x.base_name[0] not in "._"):
                            rows.append((root, before + x.path, (x.mtime_ns // 1_000_000 + 500) // 1000, x.size, False))
                    visible = False  # what lies below a hidden folder is hidden
            yield pd.DataFrame(rows, columns=["root", "path", "mtime", "size", "folder"])

    return run


def hidden_files(folders: DataFrame, skip: str) -> DataFrame:
    """root, path, mtime, size of the files that Spark's listing passes over: those with a part that begins with a dot or an underscore.

    folders: root, path of all folders between the roots and the listed files.
    Folders and files that match the regular expression ``skip`` are left out and
    not entered. A folder that the listing does not show holds hidden files only.
    """
    found = folders.select("root", "path").mapInPandas(_walk(skip, False), _FOUND)
    unseen = found.filter("folder").select("root", "path").join(folders.select("path"), "path", "left_anti")
    rest = unseen.select("root", "path").mapInPandas(_walk(skip, True), _FOUND)
    return found.filter("not folder").unionByName(rest).drop("folder")


#: Bytes of files that one task opens, about; and paths that may be named to Spark's own reader.
TASK_BYTES, NAMED = 32 << 20, 10_000


def read_listed(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """path, mtime, size, content of the listed files (path, mtime, size) and no others: each is opened by a task.

    A store that pyarrow does not know is read by Spark's reader: up to NAMED files by their names, of more the
    roots' folders are scanned.
    """
    size, count = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    try:
        for r in roots:
            _store(r)
    except (OSError, ValueError, NotImplementedError):
        if count <= NAMED:
            names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in files.select("path").collect()]
            held = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(names) if names else read_files(spark, roots).limit(0)
            return held.select("path", mtime_seconds(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"), "content") if names else held
        return read_files(spark, roots).join(files.select("path", "size"), ["path", "size"], "left_semi")
    return read_hidden(files.repartition(int(size // TASK_BYTES + min(count, spark.sparkContext.defaultParallelism) + 1)))


def read_hidden(files: DataFrame) -> DataFrame:
    """path, mtime, size, content of listed files, each opened by its task; vanished files are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, mtime, size in zip(df["path"], df["mtime"], df["size"], strict=True):
                store, at, _ = _store(path)
                try:
                    with store.open_input_stream(at) as f:
                        yield pd.DataFrame({"path": [path], "mtime": [mtime], "size": [size], "content": [f.read()]})
                except FileNotFoundError:
                    continue

    return files.select("path", "mtime", "size").mapInPandas(run, "path string, mtime long, size long, content binary")


def to_docs(files: DataFrame) -> DataFrame:
    """path, mtime, size, text: UTF-8, with bad bytes replaced."""
    return files.select("path", "mtime", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_changes(spark: SparkSession, path: str, schema: str = CHANGES) -> DataFrame:
    """A streaming table of changes from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def list_roots(listings: list[DataFrame]) -> DataFrame:
    """The union of listings; a path under several roots stays once, with its latest mtime."""
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out.groupBy("path").agg(F.max_by(F.struct("mtime", "size"), F.struct("mtime", "size")).alias("x")).select("path", "x.*")
