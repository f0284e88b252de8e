"""Views of the given tables in the shapes that the operators read; ``SQL`` holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import SPACE, words

EPOCH = 1704067200
EXTENSIONS = ["txt", "md", "py", "png", "dat", "txt.gz", "TXT", "pdf", "json", "jpg.bak"]
FOLDERS = [("ws", "/ws"), ("src1", "/ws/src1"), ("en1", "/ws/src1/en")]
IGNORED = ["# comment", "", "*.dat", "/src3", "build/", "de/*.md", "!keep.txt", "**/tmp\r", "logs/*.txt\r"]
GLOBS = ["**/src2", "**/*.png", "**/src1?/fr/**", "/ws/{src4,src5}/de"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mtime, size, text."""
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(path.alias("path"), (EPOCH + F.col("doc_id")).alias("mtime"), F.octet_length("text").cast("long").alias("size"), "text", "doc_id", "source", "lang")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mtime of an earlier state: some files are missing, some older, some since deleted."""
    f = files(spark, sf_dir)
    kept = f.filter("doc_id % 10 <> 0").select("path", (F.col("mtime") - (F.col("doc_id") % 7 == 0).cast("long")).alias("mtime"))
    gone = f.filter("doc_id % 13 = 0").select(F.concat(F.lit("/ws/gone/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "mtime")
    return kept.unionByName(gone)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first two longer words of each benchmark text."""
    two = F.slice(F.filter(words(F.col("text")), lambda w: F.length(w) >= 3), 1, 2)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(two, " ").alias("query"))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("w")).filter(F.length("w") >= 5)
    return w.select(F.substring(F.lower("w"), 1, 3).alias("prefix")).distinct()


def lookup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.get(F.filter(words(F.col("text")), lambda w: F.length(w) >= 6), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(long.alias("word")).filter("word is not null").distinct()


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_prio, glob, enabled."""
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") % 4).cast("int").alias("source_prio"), F.concat(F.lit("**/"), "source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 1000).cast("string"), F.lit("?.txt")).alias("glob"), (F.col("doc_id") % 3 != 0).alias("enabled"))


def ignore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, dir, line_no, line."""
    n = len(IGNORED)
    line = F.element_at(F.array(*[F.lit(x) for x in IGNORED]), (F.col("doc_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/ws/"), "source").alias("root"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("dir"), F.col("doc_id").alias("line_no"), line.alias("line"))


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDERS, "name string, root string")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    """event_id, path, kind, ts, mtime, size; a change of an ignore file now and then."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("change")
    name = F.when(F.col("event_id") % 97 == 0, ".gitignore").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".txt")))
    return events.select("event_id", F.concat(F.lit("/ws/u/"), name).alias("path"), kind.alias("kind"), "ts", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("mtime"), (F.col("event_id") % 1000).alias("size"))


def controls(events: DataFrame) -> DataFrame:
    """event_id, ts, what, value: now and then the settings or the folders are saved, mostly as they were."""
    what = F.when(F.col("event_id") % 2 == 0, "settings").otherwise("folders")
    return events.filter("event_id % 5 = 0").select("event_id", "ts", what.alias("what"), F.when(F.col("user_id") % 4 == 0, F.col("event_type")).otherwise("usual").alias("value"))


#: What ``trimmed`` does.
sql_trim = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_list = lambda xs: "[" + ", ".join("'" + x.replace("\r", "' || chr(13) || '") + "'" for x in xs) + "]"
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\d_]+')"
#: Common table expressions by view.
SQL = {
    "files": f"files AS (SELECT '/ws/'||source||'/'||lang||'/'||doc_id||'.'||{_list(EXTENSIONS)}[doc_id%10+1] AS path, {EPOCH} + doc_id AS mtime, strlen(text)::BIGINT AS size, text, doc_id, source, lang FROM documents)",
    "stored": "stored AS (SELECT path, mtime - (CASE WHEN doc_id%7=0 THEN 1 ELSE 0 END) AS mtime FROM files WHERE doc_id%10<>0 UNION ALL SELECT '/ws/gone/'||doc_id||'.txt', mtime FROM files WHERE doc_id%13=0)",
    "queries": f"queries AS (SELECT item_id AS query_id, array_to_string(list_slice(list_filter({_WORDS.format('text')}, lambda x: length(x)>=3),1,2),' ') AS query FROM benchmark)",
    "prefixes": f"prefixes AS (SELECT DISTINCT left(lower(w),3) AS prefix FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM benchmark) WHERE length(w)>=5)",
    "lookup_words": f"lookup_words AS (SELECT DISTINCT word FROM (SELECT (list_filter({_WORDS.format('text')}, lambda x: length(x)>=6))[1] AS word FROM benchmark) WHERE word IS NOT NULL)",
    "settings": "settings AS (SELECT (doc_id%4)::INT AS source_prio, '**/'||source||'/'||lang||'/'||doc_id%1000||'?.txt' AS \"glob\", doc_id%3<>0 AS enabled FROM documents)",
    "ignore_lines": f"ignore_lines AS (SELECT '/ws/'||source AS root, CASE WHEN lang='en' THEN '' ELSE lang END AS dir, doc_id AS line_no, {_list(IGNORED)}[doc_id%{len(IGNORED)}+1] AS line FROM documents)",
    "folders": "folders(name, root) AS (VALUES " + ", ".join(f"('{n}', '{r}')" for n, r in FOLDERS) + ")",
    "changes": "changes AS (SELECT event_id, '/ws/u/'||CASE WHEN event_id%97=0 THEN '.gitignore' ELSE user_id||'.txt' END AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS kind, ts, round(epoch_us(ts)/1e6)::BIGINT AS mtime, event_id%1000 AS size FROM events)",
    "controls": "controls AS (SELECT event_id, ts, CASE WHEN event_id%2=0 THEN 'settings' ELSE 'folders' END AS what, CASE WHEN user_id%4=0 THEN event_type ELSE 'usual' END AS value FROM events WHERE event_id%5=0)",
    "word_posting": f"word_posting AS (SELECT DISTINCT path, word, lower(word) AS word_lower FROM (SELECT path, unnest({_WORDS.format('text')}) AS word FROM files) WHERE length(word)>=3)",
    "term_posting": r"term_posting AS (SELECT path, term, count(*)::BIGINT AS n FROM (SELECT path, strip_accents(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}\p{M}]+'))) AS term FROM files) GROUP BY ALL)",
    "lower_posting": f"lower_posting AS (SELECT path, term, count(*)::BIGINT AS n FROM (SELECT path, lower(unnest({_WORDS.format('text')})) AS term FROM files) WHERE length(term)>=3 GROUP BY ALL)",
    "vocab": "vocab AS (SELECT term, count(*)::BIGINT AS doc_cnt, sum(n)::BIGINT AS cnt FROM term_posting GROUP BY term)",
    "lower_vocab": "lower_vocab AS (SELECT term, count(*)::BIGINT AS doc_cnt, sum(n)::BIGINT AS cnt FROM lower_posting GROUP BY term)",
    "doc_len": "doc_len AS (SELECT path, greatest(length(lower(text))-2, 0)::BIGINT AS n_grams FROM files)",
    "split": f"split AS (SELECT query_id, list_transform(regexp_split_to_array(query, '[{SPACE}]+'), lambda t: lower(t)) AS terms FROM queries WHERE {sql_trim('query')} <> '')",
    "long_terms": "long_terms AS (SELECT query_id, term, count(*)::BIGINT AS times FROM (SELECT query_id, unnest(terms) AS term FROM split) WHERE length(term)>=3 GROUP BY ALL)",
    # Overlapping occurrences: step to one character behind the last one found.
    "term_files": """held AS MATERIALIZED (SELECT t.term, f.path, lower(f.text) AS low FROM (SELECT DISTINCT term FROM long_terms) t JOIN files f ON contains(lower(f.text), t.term)),
occ(term, path, rest, k) AS (SELECT term, path, substr(low, instr(low, term)+1), 1 FROM held UNION ALL SELECT term, path, substr(rest, instr(rest, term)+1), k+1 FROM occ WHERE contains(rest, term)),
term_files AS MATERIALIZED (SELECT term, path, max(k)::BIGINT AS tf FROM occ GROUP BY ALL)""",
    "stats": "stats AS (SELECT term, df, n, average FROM (SELECT term, count(*)::BIGINT AS df FROM term_files GROUP BY term), (SELECT count(*)::BIGINT AS n, avg(n_grams) AS average FROM doc_len))",
    "ranked": """shares AS (SELECT query_id, path, -times * (CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END) * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*n_grams/average)) AS share
  FROM term_files JOIN stats USING (term) JOIN doc_len USING (path) JOIN long_terms USING (term)),
ranked AS MATERIALIZED (SELECT query_id, path, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, path)::INT AS file_rank FROM
  (SELECT query_id, path, round(sum(share), 6) AS rank, count(*) AS found FROM shares GROUP BY ALL) JOIN (SELECT query_id, count(*) AS wanted FROM long_terms GROUP BY ALL) USING (query_id) WHERE found = wanted
  QUALIFY file_rank <= {limit})""",
    "lines": """all_lines AS (SELECT path, unnest(range(1, len(l)+1))::INT AS line_number, unnest(l) AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)),
lines AS (SELECT r.query_id, r.file_rank, r.path, a.line_number, """ + sql_trim("left(a.line, 100)") + """ AS line_text FROM ranked r JOIN split s USING (query_id) JOIN all_lines a ON a.path = r.path
  WHERE a.line <> '' AND len(list_filter(s.terms, lambda t: contains(lower(a.line), t))) = len(s.terms)),
capped AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY file_rank, line_number) <= {limit})""",
}


def with_views(*names: str, limit: int = 0) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n].replace("{limit}", str(limit)) for n in names) + "\n"
