"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and kind.
KINDS = {
    "js": "symbol-method",
    "ts": "symbol-method",
    "json": "symbol-namespace",
    "md": "markdown",
    "html": "symbol-keyword",
    "css": "symbol-color",
    "py": "symbol-method",
    "java": "symbol-method",
    "cpp": "symbol-method",
    "c": "symbol-method",
    "h": "symbol-method",
    "rs": "symbol-method",
    "go": "symbol-method",
    "rb": "symbol-method",
    "php": "symbol-method",
    "sh": "terminal",
    "yml": "symbol-namespace",
    "yaml": "symbol-namespace",
    "xml": "symbol-keyword",
    "svg": "file-media",
    "png": "file-media",
    "jpg": "file-media",
    "jpeg": "file-media",
    "gif": "file-media",
}
#: Extensions of binary files, and the usual ones of text files. A longer text list is a parameter (``extension_list``).
BINARY = ["dds", "eot", "gif", "ico", "jar", "jpeg", "jpg", "pdf", "png", "swf", "tga", "ttf", "zip"]
TEXT = [
    "Dockerfile", "Makefile", "Rakefile", "ada", "adb", "ads", "applescript", "as", "asm", "asp", "aspx", "bas", "bash", "bashrc", "bat", "bib",
    "c", "cc", "cfg", "cgi", "clj", "cls", "cmake", "cmd", "cnf", "coffee", "conf", "cpp", "crt", "cs", "csh", "csr", "css", "csv", "cxx",
    "dart", "diff", "dockerignore", "dtd", "editorconfig", "ejs", "el", "eml", "erb", "erl", "eslintignore", "eslintrc", "ex", "exs",
    "f", "f77", "f90", "f95", "fish", "for", "gemrc", "gitattributes", "gitconfig", "gitignore", "gitkeep", "gitmodules", "go", "gradle", "groovy",
    "h", "haml", "hbs", "hgignore", "hh", "hpp", "hs", "htaccess", "htm", "html", "hxx", "inc", "ini", "ino", "jade", "java", "js", "json", "json5",
    "jsonld", "jsp", "jsx", "ksh", "less", "lhs", "lisp", "log", "lua", "m", "mak", "map", "markdown", "md", "mdx", "mjs", "mk", "ml", "mli", "mm",
    "nfo", "njk", "npmignore", "npmrc", "nvmrc", "pas", "patch", "pbxproj", "pch", "pem", "php", "pl", "pm", "pod", "pot", "properties", "props",
    "pug", "py", "r", "rake", "rb", "rdoc", "resx", "rhtml", "rmd", "ron", "rs", "rss", "rst", "rtf", "s", "sass", "scala", "scm", "scss", "sh",
    "shtml", "spec", "sql", "strings", "sty", "styl", "svg", "tcl", "tex", "text", "textile", "tmLanguage", "tmpl", "toml", "tpl", "ts", "tsv", "tsx",
    "txt", "v", "vb", "vbs", "vhd", "vhdl", "vim", "vimrc", "vue", "xaml", "xhtml", "xml", "xsd", "xsl", "xslt", "yaml", "yml", "zsh", "zshrc",
]


def extension_list(spark: SparkSession, path: str) -> list[str]:
    """The lines of a text file, one extension each, for ``classify_ext``; blank lines are left out."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_path(path: Column) -> Column:
    """The path without its last part; empty if it has one part."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_kind(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, ext), F.lit("file"))


def classify_ext(path: Column, text: list[str] = TEXT, binary: list[str] = BINARY) -> Column:
    """text, binary or unknown: the last dot-separated part of the name that is in either list decides. Case counts."""
    known = F.get(F.filter(F.reverse(F.split(file_name(path), r"\.")), lambda x: x.isin(*text, *binary)), F.lit(0))
    return F.when(known.isNull(), "unknown").when(known.isin(*binary), "binary").otherwise("text")


def relativize(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """The paths with folder (the longest whose root is a proper prefix, or null) and relative (to its root, else the path itself).

    A path's prefixes are looked up by equality, so folders may be many.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))
    near = paths.select("path").distinct().select("path", F.explode(up).alias("root")).join(folders, "root")
    best = near.groupBy("path").agg(F.max_by(F.struct("name", "root"), F.length("root")).alias("f"))
    out = paths.join(best, "path", "left")
    relative = F.when(F.col("f").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(f.root) + 2)"))
    return out.select(*paths.columns, F.col("f.name").alias("folder"), relative.alias("relative"))


def display_path(folder: Column, relative: Column) -> Column:
    """name • folder/dir; name • folder at the folder's root; the directory alone if there is no folder."""
    where = F.concat_ws("/", folder, F.when(dir_path(relative) != "", dir_path(relative)))
    return F.concat_ws(" • ", file_name(relative), where)
