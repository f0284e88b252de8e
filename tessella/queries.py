"""The registered queries: each operator over the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as v
from tessella.fixtures import sql_trim, with_views
from tessella.functions import paths as p
from tessella.functions import text as t
from tessella.jobs import refresh
from tessella.jobs import search as jobs
from tessella.operators import diff, index, lookup, scan
from tessella.operators import search as s
from tessella.sources.files import CHANGES, list_roots, mtime_seconds, read_changes, read_files, to_docs
from tessella.sources.store import Index, read_index, read_meta, shared_dir, signature, update_index, write_index
from tessella.streaming import changes as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIMIT, FEW = s.MAX_MATCHES, lookup.MAX_PATHS


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_INDEXES: dict[tuple, str] = {}


def persisted(spark: SparkSession, d: str) -> Index:
    """The index of the files, written when first asked for in a session: it is made once and searched many times. A table that is written anew is another one."""
    key = (spark.sparkContext.applicationId, d, *signature(spark, f"{d}/documents.parquet"))
    at = _INDEXES.get(key)
    if at is None:
        at = _INDEXES[key] = shared_dir(spark)
        write_index(v.files(spark, d).select("path", "mtime", "text"), at)
    return read_index(spark, at)


# Filters


@query(with_views("settings") + "SELECT \"glob\" FROM (SELECT \"glob\", arg_max(enabled, source_prio * 2 + enabled::INT) AS enabled FROM settings GROUP BY \"glob\") WHERE enabled")
def merge_excludes(spark, d):
    return scan.merge_excludes(v.settings(spark, d))


@query(with_views("files") + r"SELECT path FROM files WHERE NOT regexp_matches(path, '^/ws/src2(/.*)?$|\.png$|/src1[^/]/fr/|^/ws/(src4|src5)/de(/.*)?$')")
def exclude_globs(spark, d):
    return scan.exclude_globs(v.files(spark, d).select("path"), v.GLOBS)


_PARSED = r"""own AS (SELECT root, dir, line_no, CASE WHEN instr(l, '/') IN (0, length(l)) AND NOT starts_with(l, '**/') THEN '**/'||l WHEN instr(l, '/') NOT IN (0, length(l)) AND starts_with(l, '/') THEN substr(l, 2) ELSE l END AS g
  FROM (SELECT *, regexp_replace(line, '\r$', '') AS l FROM ignore_lines) WHERE l <> '' AND NOT starts_with(l, '#')),
parsed AS (SELECT root, dir, line_no, variant, regexp_replace(CASE WHEN dir = '' THEN '' ELSE dir||'/' END || g || CASE WHEN variant = 1 THEN '/**' ELSE '' END, '/+', '/', 'g') AS "glob" FROM own, (VALUES (0), (1)) x(variant))"""


@query(with_views("ignore_lines") + f", {_PARSED} SELECT * FROM parsed")
def parse_ignore(spark, d):
    return scan.parse_ignore(v.ignore_lines(spark, d))


_CAPPED = f"{_PARSED}, capped AS (SELECT root, (count(*) FILTER (k > {scan.MAX_IGNORE}))::BIGINT AS dropped, list_sort(list(DISTINCT \"glob\") FILTER (k <= {scan.MAX_IGNORE})) AS globs FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY dir, line_no, variant) AS k FROM parsed) GROUP BY root)"


@query(
    with_views("ignore_lines", "settings")
    + f""", {_CAPPED}, merged AS (SELECT "glob" FROM (SELECT "glob", arg_max(enabled, source_prio * 2 + enabled::INT) AS enabled FROM settings GROUP BY "glob") WHERE enabled)
SELECT root, dropped, array_to_string(list_sort(list_distinct(list_concat(globs, (SELECT list("glob") FROM merged)))), ' ') AS globs FROM capped"""
)
def cap_ignore(spark, d):
    """The capped ignore globs of each root with the merged excludes."""
    return scan.cap_ignore(scan.parse_ignore(v.ignore_lines(spark, d)), excludes=scan.merge_excludes(v.settings(spark, d))).withColumn("globs", F.array_join("globs", " "))


# Of the lines in the view only *.dat and de/*.md can meet a file; the cap is above the lines of a root.
@query(
    with_views("files", "ignore_lines")
    + r""", on_files AS (SELECT path, '/ws/'||source AS root FROM files),
rules AS (SELECT DISTINCT root, root||'/'||CASE WHEN dir = '' THEN '' ELSE dir||'/' END AS below, line FROM ignore_lines)
SELECT root, path FROM on_files f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.root = f.root
  AND ((line = '*.dat' AND starts_with(path, below) AND ends_with(path, '.dat')) OR (line = 'de/*.md' AND starts_with(path, below||'de/') AND ends_with(path, '.md'))))"""
)
def apply_ignore(spark, d):
    files = v.files(spark, d).select(F.concat(F.lit("/ws/"), "source").alias("root"), "path")
    capped = scan.cap_ignore(scan.parse_ignore(v.ignore_lines(spark, d)), 10_000)
    return scan.apply_ignore(files, capped)


_NAME = "list_reverse(string_split(list_last(string_split(path, '/')), '.'))"
_sql_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_KIND = f"coalesce(CASE WHEN list_filter({_NAME}, lambda x: x IN ({_sql_list(p.TEXT + p.BINARY)}))[1] IN ({_sql_list(p.BINARY)}) THEN 'binary' WHEN list_filter({_NAME}, lambda x: x IN ({_sql_list(p.TEXT + p.BINARY)}))[1] IS NOT NULL THEN 'text' END, 'unknown')"


@query(with_views("files") + f"SELECT path, {_KIND} AS kind FROM files")
def classify_ext(spark, d):
    return v.files(spark, d).select("path", p.classify_ext(F.col("path")).alias("kind"))


@query(with_views("files") + "SELECT path, doc_id % 4 IN (1, 3) AS binary FROM files")
def sniff_binary(spark, d):
    """A null byte at the start, one behind the first window of a text that is long enough, and a byte that is no UTF-8."""
    plain, k = F.col("text").cast("binary"), F.col("doc_id") % 4
    between = (k == 2) & (F.octet_length("text") > 300)
    behind = F.concat(F.repeat(F.lit("x"), F.lit(30)), F.lit("\0"), F.repeat(F.lit("y"), F.lit(60)), F.lit(" "), "text").cast("binary")
    content = F.when(k == 1, F.concat(F.lit("\0"), "text").cast("binary")).when(k == 3, F.concat(F.unhex(F.lit("FF")), plain)).when(between, behind).otherwise(plain)
    return v.files(spark, d).select("path", content.alias("content")).select("path", scan.sniff_binary(F.col("content")).alias("binary"))


@query(with_views("files") + f"SELECT path, size FROM files WHERE {_KIND} <> 'binary' AND size > 0 AND size < {scan.MAX_SIZE}")
def is_indexable(spark, d):
    return scan.is_indexable(v.files(spark, d).select("path", "size"))


@query(
    with_views("files", "settings", "ignore_lines")
    + """, below AS (SELECT '/ws' AS root, substr(root, 5)||CASE WHEN dir = '' THEN '' ELSE '/'||dir END AS dir, line_no, line FROM ignore_lines), """
    + _PARSED.replace("FROM ignore_lines", "FROM below")
    + f""", capped AS (SELECT DISTINCT dir, "glob" FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY dir, line_no, variant) AS k FROM parsed) WHERE k <= {scan.MAX_IGNORE}),
merged AS (SELECT "glob" FROM (SELECT "glob", arg_max(enabled, source_prio * 2 + enabled::INT) AS enabled FROM settings GROUP BY "glob") WHERE enabled)
SELECT path, size FROM files WHERE NOT EXISTS (SELECT 1 FROM capped WHERE ("glob" = dir||'/**/*.dat' AND starts_with(path, '/ws/'||dir||'/') AND ends_with(path, '.dat'))
    OR ("glob" = dir||'/de/*.md' AND starts_with(path, '/ws/'||dir||'/de/') AND ends_with(path, '.md')))
  AND NOT EXISTS (SELECT 1 FROM merged WHERE "glob" = '**/'||source||'/'||lang||'/'||doc_id//10||'?.txt' AND doc_id >= 10 AND ends_with(path, '.txt')) AND size > 0 AND size < {scan.MAX_SIZE} AND {_KIND} <> 'binary'"""
)
def scan_with_ignore(spark, d):
    """What a full scan of the root /ws lists: excludes from the settings, capped ignore lines, and files that may be indexed."""
    files = v.files(spark, d).select(F.lit("/ws").alias("root"), "path", "size")
    lines = v.ignore_lines(spark, d)
    lines = lines.select(F.lit("/ws").alias("root"), F.concat_ws("/", F.substring("root", 5, 1 << 30), F.when(F.col("dir") != "", F.col("dir"))).alias("dir"), "line_no", "line")
    return refresh.scan_files(files, lines, refresh.excludes(spark, v.settings(spark, d))).select("path", "size")


@query(with_views("files") + f"SELECT path, md5(CASE WHEN {_KIND} = 'binary' THEN '' ELSE text END) AS text_md5 FROM files")
def blank_binary(spark, d):
    docs = scan.blank_binary(v.files(spark, d), p.classify_ext(F.col("path")) == "binary")
    return docs.select("path", F.md5("text").alias("text_md5"))


@query("SELECT event_id, round((epoch_us(ts) // 1000) / 1000)::BIGINT AS mtime FROM events")
def mtime_of_events(spark, d):
    return v.table(spark, d, "events").select("event_id", mtime_seconds(F.col("ts")).alias("mtime"))


@query(f"SELECT doc_id, k::INT AS line_number FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {sql_trim('l[k]')} <> ''")
def skip_blank_queries(spark, d):
    """Every line of every document as a query."""
    lines = v.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "query"))
    return scan.skip_blank_queries(lines).select("doc_id", (F.col("at") + 1).alias("line_number"))


@query(with_views("changes") + "SELECT event_id, path FROM changes WHERE ends_with(path, '/.gitignore')")
def ignore_file_events(spark, d):
    return scan.ignore_file_events(v.changes(spark, d)).select("event_id", "path")


@query(with_views("files", "stored") + "SELECT path, max(mtime) AS mtime FROM (SELECT path, mtime FROM files UNION ALL SELECT path, mtime FROM stored) GROUP BY path")
def list_two_roots(spark, d):
    size = F.lit(0).cast("long").alias("size")
    return list_roots([v.files(spark, d).select("path", "mtime", size), v.stored(spark, d).select("path", "mtime", size)]).select("path", "mtime")


# Snapshot diff


@query(with_views("files", "stored") + "SELECT f.path, f.mtime FROM files f LEFT JOIN stored s USING (path) WHERE s.mtime IS DISTINCT FROM f.mtime")
def diff_changed(spark, d):
    return diff.diff_changed(v.files(spark, d).select("path", "mtime"), v.stored(spark, d))


@query(
    with_views("files", "stored")
    + """, pairs AS (SELECT coalesce(f.path, s.path) AS path, f.mtime AS now, s.mtime AS old FROM files f FULL JOIN stored s ON f.path = s.path)
SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM pairs WHERE now IS DISTINCT FROM old"""
)
def changed_folders(spark, d):
    return diff.changed_folders(v.files(spark, d).select("path", "mtime"), v.stored(spark, d))


@query(with_views("files", "stored") + "SELECT path, mtime FROM stored WHERE path NOT IN (SELECT path FROM files)")
def diff_deleted(spark, d):
    return diff.diff_deleted(v.files(spark, d), v.stored(spark, d))


@query(with_views("files", "stored") + "SELECT path FROM stored EXCEPT SELECT path FROM files")
def current_paths_except(spark, d):
    return diff.current_paths_except(v.stored(spark, d), v.files(spark, d))


@query(with_views("files", "stored") + "SELECT count(f.path)::BIGINT AS listed, (count(f.path) FILTER (s.mtime IS DISTINCT FROM f.mtime))::BIGINT AS to_index, (count(*) FILTER (f.path IS NULL))::BIGINT AS deleted FROM files f FULL JOIN stored s USING (path)")
def scan_report(spark, d):
    return diff.scan_report(v.files(spark, d), v.stored(spark, d))


# Index tables


@query(with_views("files", "word_posting") + "SELECT * FROM word_posting")
def build_postings(spark, d):
    return index.build_postings(v.files(spark, d))


@query(with_views("files", "term_posting") + "SELECT * FROM term_posting")
def term_postings(spark, d):
    return index.build_term_postings(v.files(spark, d))


@query(with_views("files", "term_posting", "vocab") + "SELECT * FROM vocab")
def build_vocab(spark, d):
    return index.count_terms(v.files(spark, d))


@query(with_views("files", "lower_posting", "lower_vocab") + "SELECT * FROM lower_vocab")
def build_vocab_unfolded(spark, d):
    return index.count_terms(v.files(spark, d), folded=False)


_GRAMS = """, grams AS (SELECT path, a||b||c AS gram FROM (SELECT path, unnest(x) AS a, unnest(list_concat(x[2:], [NULL])) AS b, unnest(list_concat(x[3:], [NULL, NULL])) AS c FROM (SELECT path, regexp_extract_all(lower(text), '(?s).') AS x FROM files)))"""


@query(with_views("files") + _GRAMS + " SELECT DISTINCT gram, path FROM grams WHERE gram IS NOT NULL")
def build_trigrams(spark, d):
    return index.build_trigrams(v.files(spark, d))


@query(with_views("files") + _GRAMS + " SELECT gram, count(DISTINCT path)::BIGINT AS df, count(*)::BIGINT AS cnt FROM grams WHERE gram IS NOT NULL GROUP BY gram")
def trigram_counts(spark, d):
    per = v.files(spark, d).select("path", F.explode(t.trigrams(F.col("text"))).alias("gram")).groupBy("gram", "path").agg(F.count("*").alias("n"))
    return per.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").cast("long").alias("cnt"))


@query(with_views("files", "doc_len") + "SELECT * FROM doc_len")
def doc_lengths(spark, d):
    return index.build_lengths(v.files(spark, d))


@query(with_views("files", "word_posting") + "SELECT * FROM word_posting WHERE path NOT IN (SELECT path FROM files WHERE doc_id % 3 = 0)")
def delete_paths(spark, d):
    f = v.files(spark, d)
    return index.delete_paths({"word_posting": index.build_postings(f)}, f.filter("doc_id % 3 = 0"))["word_posting"]


@query(with_views("files", "term_posting", "vocab").replace("FROM files) GROUP BY ALL", "FROM (SELECT path, CASE WHEN doc_id % 3 = 0 THEN text||' Neu neu' ELSE text END AS text FROM files)) GROUP BY ALL") + "SELECT * FROM vocab")
def upsert_docs(spark, d):
    f = v.files(spark, d).select("path", "mtime", "text", "doc_id")
    new = f.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" Neu neu")))
    first = index.upsert_docs(index.build_index(f.drop("doc_id")), new.drop("doc_id"))
    return first["vocab"]


@query(with_views("files", "term_posting", "vocab") + "SELECT * FROM vocab")
def persisted_index(spark, d):
    """The vocabulary of the written index."""
    return persisted(spark, d)["vocab"]


@query(with_views("files") + "SELECT path, mtime FROM files")
def persisted_meta(spark, d):
    at = shared_dir(spark)
    write_index(v.files(spark, d).select("path", "mtime", "text"), at)
    return read_meta(spark, at)


@query(with_views("files", "term_posting", "vocab").replace("FROM files) GROUP BY ALL", "FROM (SELECT path, CASE WHEN doc_id % 3 = 0 THEN text||' Neu neu' ELSE text END AS text FROM files WHERE doc_id % 5 <> 0)) GROUP BY ALL") + "SELECT * FROM vocab")
def updated_index(spark, d):
    """The vocabulary of a written index after an update in place: some texts are replaced, some paths are gone."""
    at, f = shared_dir(spark), v.files(spark, d)
    write_index(f.select("path", "mtime", "text"), at)
    new = f.filter("doc_id % 3 = 0 AND doc_id % 5 <> 0").select("path", "mtime", F.concat("text", F.lit(" Neu neu")).alias("text"))
    update_index(spark, at, new, f.filter("doc_id % 5 = 0").select("path"))
    return read_index(spark, at)["vocab"]


def _as_files(spark, d) -> str:
    """The documents as text files, one for each source and language."""
    at = shared_dir(spark)
    docs = v.table(spark, d, "documents").select("source", "lang", "doc_id", "text").repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id")
    docs.drop("doc_id").write.partitionBy("source", "lang").text(at)
    return at


@query("SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY ALL")
def read_files_listing(spark, d):
    """Sizes in a listing of written files; no content is read."""
    files = read_files(spark, [_as_files(spark, d)], "*.txt")
    return files.select(*_in_path(), "size").groupBy("source", "lang").agg(F.sum("size").alias("size"))


@query("SELECT source, lang, md5(string_agg(text||chr(10), '' ORDER BY doc_id)) AS text_md5 FROM documents GROUP BY ALL")
def files_to_docs(spark, d):
    """Decoded content of written files."""
    return to_docs(read_files(spark, [_as_files(spark, d)], "*.txt")).select(*_in_path(), F.md5("text").alias("text_md5"))


def _in_path():
    return [F.regexp_extract("path", rf"/{c}=([^/]*)/", 1).alias(c) for c in ("source", "lang")]


# Look-ups


@query(with_views("files", "word_posting", "lookup_words") + f"SELECT word, path FROM word_posting JOIN lookup_words USING (word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY path) <= {FEW}")
def paths_by_word(spark, d):
    return jobs.paths_by_word(v.lookup_words(spark, d), persisted(spark, d))


@query(with_views("files", "word_posting", "lookup_words") + f"SELECT word, least(count(DISTINCT path), {FEW})::BIGINT AS n_files, count(DISTINCT path) >= {FEW} AS or_more FROM word_posting JOIN lookup_words USING (word) GROUP BY word")
def word_file_count(spark, d):
    return jobs.word_file_count(v.lookup_words(spark, d), persisted(spark, d))


_COMPLETE = "SELECT prefix, word, max(cnt)::BIGINT AS cnt, row_number() OVER (PARTITION BY prefix ORDER BY max(cnt) DESC, word)::INT AS k FROM prefixes JOIN {} ON starts_with(term, lower(prefix)) JOIN (SELECT DISTINCT word, word_lower FROM word_posting) ON word_lower = term GROUP BY prefix, word QUALIFY k <= 2000"


@query(with_views("files", "word_posting", "term_posting", "vocab", "prefixes") + _COMPLETE.format("vocab"))
def complete(spark, d):
    return jobs.complete(v.prefixes(spark, d), persisted(spark, d))


@query(with_views("files", "word_posting", "lower_posting", "lower_vocab", "prefixes") + _COMPLETE.format("lower_vocab"))
def complete_unfolded(spark, d):
    f = v.files(spark, d)
    return lookup.complete(v.prefixes(spark, d), index.build_vocab(index.build_term_postings(f, folded=False)), index.build_forms(index.build_postings(f)))


@query(
    with_views("files", "word_posting", "lookup_words")
    + """, l AS (SELECT path, unnest(range(1, len(x)+1))::INT AS line_number, unnest(x) AS line FROM (SELECT path, string_split(text, chr(10)) AS x FROM files))
SELECT word, path, line_number, """ + sql_trim("left(line, 100)") + f""" AS line_text FROM (SELECT word, path FROM word_posting JOIN lookup_words USING (word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY path) <= {FEW}) JOIN l USING (path) WHERE contains(lower(line), lower(word))"""
)
def definitions(spark, d):
    return jobs.definitions(v.lookup_words(spark, d), persisted(spark, d))


# Search

_SEARCH = ("files", "queries", "split", "long_terms", "doc_len", "term_files", "stats", "ranked")


@query(with_views(*_SEARCH, limit=LIMIT) + "SELECT query_id, path, rank, file_rank FROM ranked")
def search_files(spark, d):
    return s.search_files(v.queries(spark, d), persisted(spark, d))


@query(ORACLES["search_files"])
def search_files_by_scan(spark, d):
    f = v.files(spark, d)
    return s.search_files_by_scan(v.queries(spark, d), f, index.build_lengths(f))


@query(with_views(*_SEARCH[:-1]) + "SELECT term, df, n, round(average, 6) AS average FROM stats")
def rank_stats(spark, d):
    return s.rank_stats(term_freq(spark, d), persisted(spark, d)["doc_len"]).withColumn("average", F.round("average", 6))


@query(with_views(*_SEARCH, "lines", limit=LIMIT) + "SELECT query_id, file_rank, path, line_number, line_text FROM capped")
def search_lines(spark, d):
    """The flagship: rank, cap files, match lines, cap lines."""
    return jobs.search(v.queries(spark, d), persisted(spark, d))


@query(with_views(*_SEARCH, "lines", limit=LIMIT) + "SELECT query_id, file_rank, path, count(*)::BIGINT AS n, array_to_string(list(line_number::VARCHAR ORDER BY line_number), ' ') AS numbers FROM capped GROUP BY ALL")
def group_matches(spark, d):
    g = s.group_matches(search_lines(spark, d))
    return g.select("query_id", "file_rank", "path", F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda m: m["line_number"].cast("string")), " ").alias("numbers"))


@query(with_views(*_SEARCH, "lines", limit=LIMIT) + f"SELECT query_id, count(*)::BIGINT AS total, count(DISTINCT path)::BIGINT AS n_files, count(*) >= {LIMIT} AS has_more FROM capped GROUP BY query_id")
def result_summary(spark, d):
    return s.result_summary(search_lines(spark, d))


@query(with_views("files") + "SELECT path, k::INT AS line_number, md5(l[k]) AS line_md5 FROM (SELECT path, l, unnest(range(1, len(l)+1)) AS k FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)) WHERE l[k] <> ''")
def number_lines(spark, d):
    return s.number_lines(v.files(spark, d)).select("path", "line_number", F.md5("line").alias("line_md5"))


@query(
    with_views("files", "queries", "split")
    + f""", line AS (SELECT path, k::INT AS line_number, {sql_trim('l[k]')} AS line FROM (SELECT path, l, unnest(range(1, len(l)+1)) AS k FROM (SELECT path, string_split(text, chr(10)) AS l FROM files))),
hit AS (SELECT query_id, path, line_number, lower(line) AS low, unnest(list_distinct(terms)) AS term FROM line JOIN split ON len(list_filter(terms, lambda t: contains(lower(line), t))) = len(terms)),
o(query_id, path, line_number, term, low, pos) AS (SELECT query_id, path, line_number, term, low, instr(low, term) - 1 FROM hit WHERE term <> ''
  UNION ALL SELECT query_id, path, line_number, term, low, pos + length(term) + instr(substr(low, pos + length(term) + 1), term) - 1 FROM o WHERE instr(substr(low, pos + length(term) + 1), term) > 0)
SELECT query_id, path, line_number, pos::INT AS "start", (pos + length(term))::INT AS "end" FROM o"""
)
def highlight_spans(spark, d):
    """In every line of every document, the terms of every query that the line holds as a whole."""
    return jobs.highlights(v.queries(spark, d), persisted(spark, d))


# Functions


@query(r"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\d_]+')) AS word FROM documents) GROUP BY word")
def word_counts(spark, d):
    return v.table(spark, d, "documents").select(F.explode(t.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_extract(text, '[\p{L}\d_]+') AS word FROM documents")
def first_word(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.first_word(F.col("text")).alias("word"))


@query(with_views("queries", "split") + "SELECT query_id, array_to_string(terms, '|') AS terms FROM split")
def query_terms(spark, d):
    return s.split_queries(v.queries(spark, d)).select("query_id", F.array_join("terms", "|").alias("terms"))


@query(f"SELECT doc_id, {sql_trim('left(text, 100)')} AS preview FROM documents")
def preview(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query(with_views(*_SEARCH[:-2]) + "SELECT term, path, tf FROM term_files")
def term_freq(spark, d):
    return s.term_files_by_postings(s.long_terms(s.split_queries(v.queries(spark, d))), persisted(spark, d)).select("term", "path", "tf")


@query(
    with_views("files", "folders")
    + """, pages2 AS (SELECT path FROM files UNION ALL SELECT url AS path FROM pages)
SELECT path, name AS folder, coalesce(substr(path, length(root) + 2), path) AS relative FROM pages2 LEFT JOIN folders ON starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC NULLS LAST) = 1"""
)
def relativize(spark, d):
    return p.relativize(_paths(spark, d), v.folders(spark))


def _paths(spark, d):
    return v.files(spark, d).select("path").union(v.table(spark, d, "pages").select("url")).distinct()


@query(
    with_views("files", "folders")
    + """, r AS (SELECT path, name, coalesce(substr(path, length(root) + 2), path) AS rel FROM (SELECT path FROM files UNION SELECT url FROM pages) x(path) LEFT JOIN folders ON starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC NULLS LAST) = 1),
x AS (SELECT path, list_last(string_split(rel, '/')) AS file, nullif(concat_ws('/', name, nullif(regexp_replace(rel, '/?[^/]*$', ''), '')), '') AS place FROM r)
SELECT path, concat_ws(' • ', file, coalesce(place, '')) AS display FROM x"""
)
def display_path(spark, d):
    r = p.relativize(_paths(spark, d), v.folders(spark))
    return r.select("path", p.display_path(F.col("folder"), F.col("relative")).alias("display"))


_KINDS = "map_from_entries([" + ", ".join(f"('{k}', '{x}')" for k, x in p.KINDS.items()) + "])"


@query(with_views("files") + f"SELECT path, coalesce({_KINDS}[lower(list_last(string_split(path, '.')))], 'file') AS kind FROM files")
def file_kind(spark, d):
    return v.files(spark, d).select("path", p.file_kind(F.col("path")).alias("kind"))


# Changes


@query(with_views("changes") + "SELECT path, kind, ts, event_id, mtime, size FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_path(spark, d):
    return st.latest_per_path(v.changes(spark, d))


@query(
    with_views("changes")
    + """, m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM changes),
r AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS run FROM m)
SELECT min(ts) AS began, max(ts) + INTERVAL 10 MINUTE AS ended, count(*)::BIGINT AS n_events, count(DISTINCT path)::BIGINT AS n_paths FROM r GROUP BY run"""
)
def coalesce_bursts(spark, d):
    return st.coalesce_bursts(v.changes(spark, d), 600).drop("root")


def _feed(spark, d) -> DataFrame:
    """The changes as a stream over the folder of the events table."""
    return v.as_changes(spark.readStream.schema(v.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]"))


@query(ORACLES["latest_per_path"])
def stream_latest(spark, d):
    """The end state of the running table over a stream of the same events. Each batch writes the rows that changed; the last of a path counts."""
    at = shared_dir(spark)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/n={n}")
    sink = st.latest_per_path(_feed(spark, d)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out").drop("n")
    return rows.groupBy("path").agg(F.max_by(F.struct(*st.STATE), "batch").alias("x")).select("path", "x.*")


@query(with_views("changes") + "SELECT event_id, path, kind, ts, mtime, size FROM changes")
def read_change_feed(spark, d):
    """What arrives from a written feed of changes."""
    at = shared_dir(spark)
    v.changes(spark, d).select(*[c.split()[0] for c in CHANGES.split(", ")]).write.parquet(f"{at}/feed")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/n={n}")
    st.follow(read_changes(spark, f"{at}/feed"), write, f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("n")


def _followed(spark, d) -> tuple[str, str]:
    """Folders of an index of the files that followed the changes, and of the scans that were asked for. A changed path holds the text of the document of its number."""
    key = (spark.sparkContext.applicationId, d, "followed", *signature(spark, f"{d}/documents.parquet"), *signature(spark, f"{d}/events.parquet"))
    if at := _INDEXES.get(key):
        return f"{at}/index", f"{at}/asked"
    at = _INDEXES[key] = shared_dir(spark)
    texts = v.table(spark, d, "documents").select(F.concat(F.lit("/ws/u/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    write_index(v.files(spark, d).select("path", "mtime", "text").unionByName(texts.select("path", F.lit(0).cast("long").alias("mtime"), F.lit("old").alias("text"))), f"{at}/index")
    load = lambda c: c.select("path", "mtime").join(texts, "path", "left").select("path", "mtime", F.coalesce("text", F.lit("")).alias("text"))
    rescan = lambda asked: asked.write.mode("append").parquet(f"{at}/asked")
    st.apply_changes(_feed(spark, d), f"{at}/index", load, ["**/.gitignore"], f"{at}/state", rescan).awaitTermination()
    return f"{at}/index", f"{at}/asked"


_LAST = """, last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1),
begun AS (SELECT path, mtime, text FROM files UNION ALL SELECT '/ws/u/'||doc_id||'.txt', 0, 'old' FROM documents),
fresh AS (SELECT l.path, l.mtime, coalesce(d.text, '') AS text FROM last l LEFT JOIN documents d ON l.path = '/ws/u/'||d.doc_id||'.txt' WHERE kind <> 'delete' AND size > 0 AND NOT ends_with(l.path, '/.gitignore'))"""


@query(with_views("files", "changes") + _LAST + " SELECT path, mtime, md5(text) AS text_md5 FROM fresh")
def stream_upsert(spark, d):
    """The changed documents as they stand in the index after the stream."""
    at, _ = _followed(spark, d)
    kept = read_index(spark, at)
    last = st.latest_per_path(v.changes(spark, d)).filter("kind <> 'delete' AND size > 0").select("path")
    return kept["file"].join(kept["text"], "path").join(last, "path", "left_semi").select("path", "mtime", F.md5("text").alias("text_md5"))


@query(with_views("files", "changes") + _LAST + " SELECT path, mtime FROM (SELECT path, mtime FROM begun WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT path, mtime FROM fresh) WHERE path NOT IN (SELECT path FROM last WHERE kind = 'delete')")
def stream_delete(spark, d):
    """All files of the index after the stream: deleted ones are gone."""
    return read_meta(spark, _followed(spark, d)[0])


@query(with_views("files", "changes") + _LAST + " SELECT path, event_id, ts, kind FROM last WHERE ends_with(path, '/.gitignore')")
def stream_rescan_flag(spark, d):
    """The scans that changes of ignore files ask for."""
    return spark.read.parquet(_followed(spark, d)[1])


@query(with_views("controls") + "SELECT what, event_id, ts, value FROM controls QUALIFY value IS DISTINCT FROM lag(value) OVER (PARTITION BY what ORDER BY ts, event_id)")
def stream_setting_requests(spark, d):
    """The scans that real changes of the settings and of the folder list ask for, over a stream of what was saved."""
    at = shared_dir(spark)
    feed = v.controls(spark.readStream.schema(v.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/n={n}")
    st.follow(st.setting_requests(feed), write, f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("n")


@query(ORACLES["coalesce_bursts"].rstrip() + " HAVING max(ts) + INTERVAL 10 MINUTE < (SELECT max(ts) FROM changes) - INTERVAL 1 HOUR")
def stream_bursts(spark, d):
    """The runs that are over when the stream has ended: those a gap before its watermark, which is an hour behind the last event."""
    at, key = shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/n={n}")
        st.follow(st.stream_bursts(_feed(spark, d), 600, "1 hour"), write, f"{at}/state").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{at}/out").drop("n", "root")
