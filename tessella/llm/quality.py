"""Quality rules with thresholds that follow each language and source.

Every document gets a few integer signals from its whole text: rates of symbols,
of repeated lines and of words equal to the next one, and the mean word length.
Quantile sketches of the signals (``percentile_approx``, which Spark merges from
partial sketches) are kept per (lang, source), per lang and over all documents.
A fence lies SPREAD times the distance from the median to the quartile beyond the
quartile, for word lengths on both sides. Where a rate's quartile and median
coincide, as they do for what most documents do not have at all, the distance
is one occurrence in a document of the group's median length; for word lengths it is
at least the chance error of such a document's mean, words varying by half their
length. So a group full of copies does not shut out all else. A group's fence is
blended with that of its language, and this one with that of all documents, as if
the wider one stood for PRIOR documents; so no group size switches anything. Only
DataFrame functions run.

Cases: null text has no words and fails the base rules; null lang or source is
a group of its own; repeated rows are judged alike, one output row each; a
table without a document that passes the base rules has no fences and keeps
nothing; an empty table gives an empty result; further columns of the input are
ignored by ``signals`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, cut, group_join, guarded, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Rates are per 100,000 of a base: (count, base). Word length is in hundredths of a character.
SCALE = 100_000
RATES = {"symbol": ("n_symbols", "word_chars"), "dup_line": ("n_dup_lines", "n_words"), "echo": ("n_echoes", "n_words")}
FENCES = [*(f"{c}_hi" for c in RATES), "word_len_hi", "word_len_lo"]
SPREAD, PRIOR = 8, 100
ACCURACY = 10_000


def _repeat_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
        return F.transform(F.array(F.array_sort(F.transform(twice, lambda x: x["i"]))), covered)[0]

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    found = F.transform(F.array(pairs), of_sorted)[0]
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), found).otherwise(0)


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the rates and word_len."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "source", "text", words(F.col("text")).alias("words"))
    d = d.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    h = F.col("h")
    gram = lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    d = d.select(
        *[c for c in d.columns if c not in ("lines", "h")],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(h, lambda w, i: F.get(h, i + 1) == w)).cast("long").alias("n_echoes"),
        F.when(F.size(h) >= WINDOW, F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), gram)).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    d = d.withColumn("n_repeat_words", _repeat_words(F.col("grams")).cast("long")).drop("grams")
    part = lambda a, b, k: F.when(F.col(b) > 0, F.floor(k * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        *[part(count, base, SCALE).alias(c) for c, (count, base) in RATES.items()],
        part("word_chars", "n_words", 100).alias("word_len"),
    )


def raw_fences(sig: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value of ``keys``: n, the row count, and the fences of that group alone."""
    sketched = [*RATES, "word_len", *{base for _, base in RATES.values()}]
    q = sig.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], ACCURACY).alias(c) for c in sketched])
    low, mid, high = (lambda c, i=i: F.col(c)[i].cast("double") for i in range(3))
    rates = [(high(c) + SPREAD * F.greatest(high(c) - mid(c), SCALE / mid(base))).alias(f"{c}_hi") for c, (_, base) in RATES.items()]
    error = mid("word_len") / (2 * F.sqrt(mid("n_words")))
    length = [(high("word_len") + SPREAD * F.greatest(high("word_len") - mid("word_len"), error)).alias("word_len_hi"), (low("word_len") - SPREAD * F.greatest(mid("word_len") - low("word_len"), error)).alias("word_len_lo")]
    return q.select(*keys, "n", *rates, *length)


def fences(sig: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, n and the blended fences of every group. sig: the documents that pass the base rules."""

    def blend(own: DataFrame, wider: DataFrame, on) -> DataFrame:
        w = wider.select(*[F.col(c).alias(f"__{c}") for c in wider.columns])
        mixed = [((F.col("n") * F.col(c) + prior * F.col(f"__{c}")) / (F.col("n") + prior)).alias(c) for c in FENCES]
        return own.join(w, on).select(*[c for c in own.columns if c not in FENCES], *mixed)

    # Without keys there is one row, an aggregate over everything.
    by_lang = blend(raw_fences(sig, ["lang"]), F.broadcast(raw_fences(sig, [])), F.lit(True))
    return blend(raw_fences(sig, ["lang", "source"]), by_lang, F.col("lang").eqNullSafe(F.col("__lang")))


def judge(sig: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Adds ``kept`` to the signals. Thresholds come from documents that pass the base rules."""
    group = F.struct("lang", "source").alias("__group")  # equal also where fields are null
    t = cut(fences(sig.filter(~F.col("base_failed")), prior).select(group, "n", *FENCES))
    ok = F.col("word_len").between(F.col("word_len_lo"), F.col("word_len_hi"))
    for c in RATES:
        ok = ok & (F.col(c) <= F.col(f"{c}_hi"))
    out = group_join(sig.select("*", group), t, ["__group"], ["doc_id"])
    return out.select(*sig.columns, (~F.col("base_failed") & F.coalesce(ok, F.lit(False))).alias("kept"))


def assess(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Signals and verdict of every document. The signals are written once, since three sketches and the verdict read them."""
    return judge(cut(signals(docs)), prior)


def filter_documents(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents that pass, with their columns. Rows equal in doc_id, lang, source and text share a verdict; a null doc_id is a value like others."""

    def stage(docs: DataFrame) -> DataFrame:
        key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("a"), F.xxhash64("doc_id", "lang", "source", "text").alias("b"))
        keyed = docs.withColumn("__key", key)
        sig = cut(signals(keyed.withColumn("doc_id", F.col("__key"))))
        good = judge(sig, prior).filter("kept").select(F.col("doc_id").alias("__key")).distinct()
        return keyed.join(good, "__key", "left_semi")

    return guarded(docs, ["doc_id", "lang", "source", "text"], stage)
