"""Quality rules: repeated content within a text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake.llm.common import let, words

WINDOW = 8


def _repeated_words(found: Column) -> Column:
    """Words that lie in a window of eight words that the text holds at least twice.

    Windows are compared by 64-bit hash within one text. Only texts with a repeated hash sort
    their windows; equal hashes are then neighbours, and their positions mark the words.
    """
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")

        def positions(s: Column) -> Column:
            both = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(
                a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
            return F.sort_array(F.array_distinct(F.flatten(both)))

        def length(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                               lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return let(let(placed, positions), length)

    def scan(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(w) > WINDOW, repeats).otherwise(0)

    return scan(found)


def text_measures(text: Column) -> Column:
    """A struct of counts over one text; all are zero for null and for empty texts.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with
    a word that equal an earlier line) and ``n_repeat_words``.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), counts)


def host_lines(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """One row per line of a document: its place, the hash of its normalised form, and its words.

    A line is lower-cased and its words are joined by one space; lines without words are left out.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: words(F.lower(x))),
                     lambda w: F.size(w) > 0)
    keyed = F.transform(lines, lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).alias("words")))
    return (
        docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("text_key"),
                    F.xxhash64(id_col, host, text).alias("row_key"), F.posexplode(keyed).alias("place", "x"))
        .select("host", "text_key", "row_key", "place", "x.line", "x.words")
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, text: str, host: str, share: float, least: int) -> DataFrame:
    """Lines of a host that more distinct documents hold than ``share`` of its documents, and than ``least``.

    Documents with the same text count once, so exact copies do not make a line frequent.
    """
    counted = (
        lines.groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    )
    sizes = (
        docs.groupBy(F.col(host).alias("h"), F.xxhash64(text).alias("text_key")).agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.count("*").alias("host_docs"))
    )
    return (
        counted.join(sizes, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("n_docs") > share * F.col("host_docs")).select("host", "line", "n_docs")
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
                 share: float = 0.05, least: int = 10, depleted: float = 0.7) -> DataFrame:
    """Measures every document and judges it by the lines that many documents of its host share.

    Returns ``id_col``, the measures, ``n_line_words`` (words in frequent lines, which the rule
    takes away), ``base_failed`` and ``kept``. A document fails the base rules with fewer than 20
    words or with more than 30 % of its words in repeated windows; it is depleted when more than
    ``depleted`` of its words stand in frequent lines. Null texts count as empty and fail. A null
    host is a host of its own. Repeated rows each get the same result. Further columns of ``docs``
    are ignored. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"))
    lines = host_lines(own, "id", "text", "host")
    often = frequent_lines(lines, own, "text", "host", share, least)
    hit = lines.join(
        often.select(F.col("host").alias("h"), F.col("line").alias("l")),
        F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi")
    taken = (  # repeated rows share their key, so each place counts once
        hit.groupBy("row_key", "place").agg(F.first("words").alias("words"))
        .groupBy("row_key").agg(F.sum("words").alias("n_line_words"))
    )
    rows = own.select("id", F.xxhash64("id", "host", "text").alias("row_key"), text_measures(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    gone = F.coalesce(F.col("n_line_words"), F.lit(0)).cast("long")
    return rows.join(taken, "row_key", "left").select(
        F.col("id").alias(id_col), "m.*", gone.alias("n_line_words"), failed.alias("base_failed"),
        (~failed & (gone <= depleted * F.col("m.n_words"))).alias("kept"))


def remove_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
                          share: float = 0.05, least: int = 10) -> DataFrame:
    """``docs`` with ``kept_text``: the text's lines without those that many documents of its host share, in order.

    Lines are frequent as in ``line_quality``. Lines without words stay. Every row stays; a null text stays null.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"))
    lines = host_lines(own, "id", "text", "host")
    often = frequent_lines(lines, own, "text", "host", share, least)
    hit = lines.join(
        often.select(F.col("host").alias("h"), F.col("line").alias("l")),
        F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi")
    gone = hit.groupBy(F.col("row_key").alias("_key")).agg(F.collect_set("line").alias("_gone"))
    joined = docs.join(gone, F.xxhash64(id_col, host, text) == F.col("_key"), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x: let(words(F.lower(x)), lambda w: (F.size(w) == 0) | ~F.array_contains(
        "_gone", F.xxhash64(F.array_join(w, " ")))))
    return joined.select(*[docs[c] for c in docs.columns],
                         F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias("kept_text"))
