"""Text functions: words, terms, trigrams, ranking, highlights."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\d_]+"
TERM = r"[\p{L}\p{N}\p{Co}\p{M}]+"
#: The characters that count as white space, for splitting and trimming.
SPACE = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: BM25 constants.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
GRAM = 3


def exploded(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """The columns ``keep`` and ``name``, a row for each element.

    By the outer explode: before a plain one Spark puts a filter on the array's
    size, which evaluates it a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def words(text: Column) -> Column:
    """All runs of letters, ASCII digits and underscores, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(0))


def first_word(text: Column) -> Column:
    """The first word, or an empty string."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), WORD, 0)


def raw_terms(text: Column) -> Column:
    """Lower-case runs of letters, numbers and marks; an underscore splits. Diacritics stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(0))


def folded_term(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold_diacritics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Letters without their marks. Meant for distinct terms, not for every occurrence."""
    for s in batches:
        yield s.map(folded_term, na_action="ignore")


def fold(df: DataFrame, term: str) -> DataFrame:
    """``term`` without diacritics. Each distinct term is folded once; ASCII terms skip the helper."""
    ascii_only = F.col(term).rlike(r"^\p{ASCII}*$")
    other = df.filter(~ascii_only).select(term).distinct().withColumn("__folded", fold_diacritics(F.col(term)))
    changed = df.filter(~ascii_only).join(other, term).drop(term).withColumnRenamed("__folded", term).select(*df.columns)
    return df.filter(ascii_only).unionByName(changed)


def trigrams(text: Column) -> Column:
    """Every lower-case string of three characters, by look-ahead; texts under three give none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=(...))"), F.lit(1))


def gram_count(text: Column) -> Column:
    return F.greatest(F.length(F.lower(F.coalesce(text, F.lit("")))) - (GRAM - 1), F.lit(0)).cast("long")


def query_terms(query: Column) -> Column:
    """Lower-case terms between white space; a leading blank gives an empty term, which every line contains."""
    return F.transform(F.split(query, f"[{SPACE}]+"), lambda t: F.lower(t))


def trimmed(text: Column) -> Column:
    """Without white space at both ends: all Unicode spaces, tabs, line ends and the byte order mark."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def preview(line: Column, n: int = 100) -> Column:
    return trimmed(F.substring(line, 1, n))


def quoted(term: Column) -> Column:
    """The term as a regular expression that matches it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def ends_as_it_begins(term: Column) -> Column:
    """Whether occurrences of the term can overlap."""
    n = F.length(term)
    return F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.substring(term, F.lit(1), i) == F.substring(term, n - i + 1, i)))


def term_freq(low: Column, term: Column, overlaps: Column | None = None) -> Column:
    """Occurrences of a term in a text, both in lower case, overlapping ones too.

    Where they cannot overlap they are counted by taking them out, which is much
    faster than a look-ahead. overlaps: ``ends_as_it_begins``, if it is known.
    """
    apart = F.floor((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term))
    ahead = F.regexp_count(low, F.concat(F.lit("(?="), quoted(term), F.lit(")")))
    return F.when(ends_as_it_begins(term) if overlaps is None else overlaps, ahead).otherwise(apart).cast("long")


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's share of the rank; better is less."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def highlight_spans(line: Column, terms: Column) -> Column:
    """[start, end] of every term in the trimmed line, from 0; those of one term do not overlap."""
    lower = F.lower(trimmed(line))

    def of(term: Column) -> Column:
        size = F.length(term)
        parts = F.split(lower, quoted(term))
        ends = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * size)
        return F.transform(ends, lambda e: F.struct(e.alias("start"), (e + size).alias("end")))

    return F.flatten(F.transform(F.filter(F.array_distinct(terms), lambda t: t != ""), of))
