"""Statistics of whole texts as built-in expressions, one scan and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import SPACE, let

#: Inputs of the learned models: ratios, so that they mean the same at any length.
FEATURES = (
    "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share",
    "pipe_share", "digit_share", "distinct_share", "line_words", "log_words",
)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(word: Column) -> Column:
    """Words inside three-word windows that the text has twice or more, first ones included."""

    def windows(w: Column) -> Column:
        at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)).otherwise(F.array().cast("array<bigint>"))

    def starts(s: Column) -> Column:
        twice = lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])
        return F.array_sort(F.filter(F.transform(s, twice), lambda i: i.isNotNull()))

    def covered(start: Column) -> Column:
        seed = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(start, seed, step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, starts), covered))

    return let(let(word, windows), count)


def text_stats(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with counts and FEATURES of every whole text.

    Null and empty texts count nothing: all counts and shares are 0.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"))
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    drop = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).cast("long").alias("n_distinct"),
        )

    out = base.select(
        *keep,
        let(words(t), of_words).alias("__w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("__l"),
        drop("#*$%&|<>").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("__upper"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("__bang"),
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).alias("__pipe"),
        F.regexp_count(t, F.lit("[0-9]")).alias("__digit"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    n, chars = F.col("__w.n_words"), F.col("__w.word_chars")
    return out.select(
        *keep,
        n.alias("n_words"), chars.alias("word_chars"), "n_symbols", F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        share(chars, n).alias("word_len"), share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("__l.n_dup_lines"), F.col("__l.n_lines")).alias("dup_line_share"), share(F.col("__w.n_repeat_words"), n).alias("repeat_share"),
        share(F.col("__upper"), chars).alias("upper_share"), share(F.col("__bang"), chars).alias("bang_share"),
        share(F.col("__pipe"), chars).alias("pipe_share"), share(F.col("__digit"), chars).alias("digit_share"),
        share(F.col("__w.n_distinct"), n).alias("distinct_share"), share(n, F.col("__l.n_lines")).alias("line_words"),
        F.log1p(n).alias("log_words"),
    )


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def sampled_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, label), about ``most`` rows at most, taken by a hash of their ids; labels that are null or in conflict are left out."""
    clean = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("high"))
    clean = clean.filter("label = high").select("doc_id", F.col("label").cast("int").alias("label"))
    rows = clean.count()
    if rows > most:
        clean = clean.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1e6 * most / rows))
    return clean


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Rows of stats with a label, about ``most`` at most if ids are unique."""
    return stats.join(sampled_labels(labels, most), "doc_id")
