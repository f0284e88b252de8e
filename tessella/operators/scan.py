"""Which files are listed, read and indexed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from tessella.functions.globs import any_regex, glob_to_regex, literal_key
from tessella.functions.paths import classify_ext, relativize
from tessella.functions.text import trimmed
from tessella.sources.store import materialized

#: Excluded by default, and names of ignore files.
DEFAULT_EXCLUDES = [
    "**/.DS_Store", "**/.git", "**/.git/objects/**", "**/.git/subtree-cache/**", "**/.hg", "**/.hg/store/**", "**/.svn", "**/*.code-search",
    "**/bower_components", "**/CVS", "**/node_modules", "**/node_modules/*/**", "**/Thumbs.db", "**/.git/**",
]
IGNORE_FILES = [".gitignore", ".ignore", ".rignore"]
MAX_SIZE = 20 * 1024 * 1024
MAX_IGNORE = 1000
PROBE = 24


def merge_excludes(settings: DataFrame) -> DataFrame:
    """glob: of each glob the value of the highest source_prio counts; those that are enabled stay. settings: source_prio, glob, enabled (one value per source and glob; of several true wins)."""
    merged = settings.groupBy("glob").agg(F.max_by("enabled", F.struct("source_prio", "enabled")).alias("enabled"))
    return merged.filter(F.coalesce("enabled", F.lit(False))).select("glob")


def exclude_globs(files: DataFrame, globs: list[str], tree: bool = True) -> DataFrame:
    """The files that no glob matches. tree: a matched directory takes its content along, as in a listing; without it the exact path counts, as for a change."""
    return files.filter(~F.col("path").rlike(any_regex(globs, tree)))


def parse_ignore(lines: DataFrame) -> DataFrame:
    """root, dir, line_no, variant (0 the entry, 1 all below it), glob. lines: root, dir (relative to root, may be empty), line_no, line.

    A negated line is not special: it becomes a glob of its literal text.
    """
    line = F.regexp_replace("line", r"\r$", "")
    rows = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    slash = F.locate("/", F.col("line"))
    anywhere = (slash == 0) | (slash == F.length("line"))
    own = F.when(anywhere & ~F.col("line").startswith("**/"), F.concat(F.lit("**/"), F.col("line"))).when(~anywhere & F.col("line").startswith("/"), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    joined = lambda *parts: F.regexp_replace(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), *parts), "/+", "/")
    both = F.array(joined(own), joined(own, F.lit("**")))
    return rows.select("root", "dir", "line_no", F.posexplode(both).alias("variant", "glob"))


def cap_ignore(patterns: DataFrame, n: int = MAX_IGNORE, excludes: DataFrame | None = None) -> DataFrame:
    """root, dropped, globs: the first n globs of a root with the excludes (glob), each once, and how many were left out."""
    first = Window.partitionBy("root").orderBy("dir", "line_no", "variant")
    numbered = patterns.select("root", "glob", F.row_number().over(first).alias("k"))
    rows = numbered.select("root", F.when(F.col("k") <= n, F.col("glob")).alias("glob"), (F.col("k") > n).cast("long").alias("over"))
    if excludes is not None:
        shared = excludes.select("glob").distinct()
        rows = rows.unionByName(patterns.select("root").distinct().join(F.broadcast(shared), F.lit(True)).select("root", "glob", F.lit(0).cast("long").alias("over")))
    return rows.groupBy("root").agg(F.sum("over").alias("dropped"), F.array_sort(F.collect_set("glob")).alias("globs"))


def _rules(tree: bool):
    """For mapInPandas over (root, globs): root, key, rx: of each glob with a literal key; and with a null key one alternation of a root's others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for root, globs in zip(df["root"], df["globs"], strict=True):
                keys = [(g, literal_key(g)) for g in globs]
                rows += [(root, k, glob_to_regex(g, tree, root)) for g, k in keys if k]
                rest = [g for g, k in keys if not k]
                rows += [(root, None, any_regex(rest, tree, root))] if rest else []
            yield pd.DataFrame(rows, columns=["root", "key", "rx"])

    return run


def _keys(path: Column) -> Column:
    """``path_keys``, natively."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.transform(F.slice(F.split(p, r"\."), 2, 1 << 20), lambda _, i: F.concat(F.lit("."), F.array_join(F.slice(F.split(p, r"\."), i + 2, 1 << 20), "."))))
    return F.array_distinct(F.concat(F.transform(parts, lambda p: F.concat(F.lit("="), p)), F.flatten(ends)))


#: Rules that go to every task.
BROADCAST_RULES = 200_000


def apply_ignore(files: DataFrame, capped: DataFrame, tree: bool = True) -> DataFrame:
    """The files (root, path) that no glob of their own root matches.

    Most globs name a part of the path or an end of one (``node_modules``, ``*.log``): they meet
    the files by equality on the parts below the root, and only such pairs are tried by
    their expression. Of the few others each root has one alternation.
    """
    rules = materialized(capped.select("root", "globs").mapInPandas(_rules(tree), "root string, key string, rx string"))
    keyed, rest = rules.filter("key is not null"), rules.filter("key is null").select("root", "rx")
    small = rules.count() <= BROADCAST_RULES
    below = F.when(F.startswith("path", F.concat("root", F.lit("/"))), F.substring("path", F.length("root") + 2, F.length("path"))).otherwise(F.col("path"))
    parts = files.select("root", "path", F.explode(_keys(below)).alias("key"))
    pairs = parts.join(F.broadcast(keyed) if small else keyed, ["root", "key"]).sortWithinPartitions("rx")  # an expression is compiled once and not once a file
    hits = pairs.filter(F.regexp_like("path", F.col("rx"))).select("root", "path").distinct()
    both = files.join(F.broadcast(rest) if small else rest, "root", "left").sortWithinPartitions("root")
    left = both.filter(~F.coalesce(F.regexp_like("path", F.col("rx")), F.lit(False))).select(*files.columns)
    return left.join(hits, ["root", "path"], "left_anti").select(*files.columns)


def not_ignored(changes: DataFrame, capped: DataFrame) -> DataFrame:
    """The changes whose path no ignore glob of its root matches; the longest root (root, globs) above a path counts, and a path below none stays."""
    roots = relativize(changes.select("path"), capped.select(F.col("root").alias("name"), "root")).select("path", F.coalesce("folder", F.lit("")).alias("root"))
    left = apply_ignore(roots.distinct(), capped)
    return changes.join(left.select("path"), "path", "left_semi")


def _edges(b: bytes, begin: int) -> bool:
    """Whether the window at begin is text."""

    def width(i: int) -> int:
        """Bytes of the character that begins at i by its first byte; 1 for others."""
        x = b[i]
        return 4 if x >> 3 == 0b11110 else 3 if x >> 4 == 0b1110 else 2 if x >> 5 == 0b110 else 1

    if begin and b[begin] >> 6 == 0b10:
        # A window that begins inside a character begins with that character.
        back = next((k for k in (3, 2, 1) if begin >= k and width(begin - k) > k), None)
        if back is None:
            return False
        begin -= back
    end = min(len(b), begin + PROBE)
    if end < len(b):
        over = next((width(end - k) - k for k in (3, 2, 1) if end >= k and width(end - k) > k), 0)
        end += over
        if end > len(b):
            return False
    text = b[begin:end].decode("utf-8", "replace")
    return not any(c == "�" or ord(c) <= 8 for c in text)


@F.pandas_udf(BooleanType())
def _sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for df in batches:
        yield pd.Series([any(not _edges(bytes(p), int(a)) for p, a in zip(parts, at, strict=True)) for parts, at in zip(df["parts"], df["at"], strict=True)], dtype=bool)


def sniff_binary(content: Column) -> Column:
    """Whether bytes look binary: windows at the start, the middle and the end are tried.

    Only the windows and a few bytes around them go to the helper. Null is not binary.
    """
    n = F.length(content)
    begins = [F.lit(0), F.greatest(F.floor(n / 2).cast("int") - PROBE, F.lit(0)), F.greatest(n - PROBE, F.lit(0))]
    lo = [F.greatest(b - 3, F.lit(0)) for b in begins]
    # Where a part stops before the content does, the window ends at least three bytes earlier.
    parts = F.array(*[F.substring(content, a + 1, F.lit(PROBE + 9)) for a in lo])
    at = F.array(*[(b - a).cast("int") for a, b in zip(lo, begins, strict=True)])
    return F.when(content.isNull(), F.lit(False)).otherwise(_sniff(F.struct(parts.alias("parts"), at.alias("at"))))


def is_indexable(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Not known as binary by name, not empty, not too large."""
    return files.filter((classify_ext(F.col("path")) != "binary") & (F.col("size") > 0) & (F.col("size") < max_size))


def blank_binary(docs: DataFrame, binary: Column) -> DataFrame:
    """Binary documents keep their row, with an empty text."""
    return docs.withColumn("text", F.when(binary, "").otherwise(F.col("text")))


def skip_blank_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(trimmed(F.col("query")) != "")


def is_ignore_file(path: Column) -> Column:
    """Changes of such files ask for a full scan."""
    return F.coalesce(F.element_at(F.split(path, "/"), -1).isin(IGNORE_FILES) & path.contains("/"), F.lit(False))


def ignore_file_events(changes: DataFrame) -> DataFrame:
    return changes.filter(is_ignore_file(F.col("path")))
