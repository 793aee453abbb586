"""Source divergence audit: run-length columns of term counts, compared pair by pair over shared runs."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlake.llm.common import settle

#: ASCII bytes that are no letter become blanks and A-Z becomes a-z; the bytes of all other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: Different terms a task counts before it hands them on, and terms whose columns are compared together.
HELD, SLICE = 1 << 18, 1 << 13


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and other characters beyond ASCII; only A-Z is lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def rows() -> pd.DataFrame:
        out = [(*key, term.decode(), n, docs[key][term]) for key, own in counts.items() for term, n in own.items()]
        return pd.DataFrame(out, columns=["lang", "source", "term", "n", "n_docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            found = terms(text)
            counts[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, counts.values())) > HELD:
            yield rows()
            counts.clear()
            docs.clear()
    yield rows()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, source, term, n, n_docs)``: occurrences and documents; summed in each task before the shuffle."""
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = own.mapInPandas(_count_rows, "lang string, source string, term string, n long, n_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 vocabulary))``, exact at any size."""
    above = (F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)")
    below = (total + 2 * vocabulary).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", above, below)


def term_divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _runs(batches: Iterator[pd.DataFrame], size: int = SLICE) -> Iterator[pd.DataFrame]:
    """Numbers the ordered vocabulary in slices of one language and encodes each group's column by its runs."""
    part, cut, lang, held = TaskContext.get().partitionId(), 0, None, []

    def encoded() -> pd.DataFrame:
        group = np.concatenate([np.asarray(g) for g, _ in held])
        share_ = np.concatenate([np.asarray(p, np.int64) for _, p in held])
        place = np.repeat(np.arange(len(held)), [len(g) for g, _ in held])
        order = np.lexsort((place, group))
        group, share_, place = group[order], share_[order], place[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (share_[1:] != share_[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        return pd.DataFrame({"lang": lang, "slice": (part << 32) + cut, "width": len(held), "source": group[at],
                             "start": place[at], "length": np.diff(at, append=len(group)), "p": share_[at]})

    for batch in batches:
        for own, sources, shares in zip(batch["lang"], batch["sources"], batch["shares"]):
            if held and (own != lang or len(held) == size):
                yield encoded()
                held, cut = [], cut + 1
            lang = own
            held.append((sources, shares))
    if held:
        yield encoded()


def column_runs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, slice, width, source, start, length, p)``: stretches of the reordered vocabulary on which a group's share is one value.

    Terms are ordered by language and by their counts in the language's groups, so terms with equal counts stand together. The order
    is a range sort; terms with the same counts may be cut anywhere, since runs end at slices anyway. Places that no run of a group
    covers hold its share of no occurrence.
    """
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    vectors = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p"))).alias("x"))
    vectors = vectors.select("lang", "term", F.col("x.source").alias("sources"), F.col("x.n").alias("ns"), F.col("x.p").alias("shares"))
    ordered = vectors.repartitionByRange("lang", "sources", "ns", "term").sortWithinPartitions("lang", "sources", "ns", "term")
    return ordered.select("lang", "sources", "shares").mapInPandas(
        _runs, "lang string, slice long, width int, source string, start int, length int, p long")


def _pair_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over one slice for every pair of groups: run boundaries meet, f is taken once a run."""
    lang, width = key[0], int(rows["width"].max())
    empty = rows[rows["start"] < 0].drop_duplicates("source").sort_values("source")
    columns = []
    runs = rows[rows["start"] >= 0].sort_values(["source", "start"])
    own = dict(iter(runs.groupby("source")[["start", "length", "p"]]))
    for source, rest in zip(empty["source"], empty["p"]):
        if source not in own:
            columns.append((np.zeros(1, np.int64), np.array([rest], np.int64)))
            continue
        start, length, p = own[source].to_numpy(np.int64).T
        edge = np.concatenate([start, start + length])
        value = np.concatenate([p, np.full(len(p), rest, np.int64)])
        first = np.ones(len(edge), bool)
        first[len(start):] = ~np.isin(start + length, start) & (start + length < width)  # a gap follows the run
        edge, value = edge[first], value[first]
        if not (edge == 0).any():
            edge, value = np.append(edge, 0), np.append(value, rest)
        order = np.argsort(edge)
        columns.append((edge[order], value[order]))
    names, out = empty["source"].tolist(), []
    for i, (a, p) in enumerate(columns):
        for j in range(i):
            b, q = columns[j]
            edges = np.union1d(a, b)
            x, y = p[np.searchsorted(a, edges, side="right") - 1], q[np.searchsorted(b, edges, side="right") - 1]
            f = (x - y) ** 2 // (x + y)
            out.append((lang, names[j], names[i], int((f * np.diff(edges, append=width)).sum())))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least: int = 10, top: int = 10) -> DataFrame:
    """How the word use of each ``(lang, source)`` group differs from that of the other sources and of its language.

    Returns ``lang, source, part, item, value, rank``. Part ``pair`` has a row for every other source of the
    language with the divergence over all kept terms (those in at least ``least`` documents of the language);
    part ``term`` has the ``top`` kept terms that the group uses more than its language does. Ranks count from
    1 by value, then item.

    Counts are joined in the tasks that read, so a source with a third of all rows costs one row per term and task. The vocabulary is
    ordered by count vectors; each group's column is run-length encoded in slices of terms, and pairs meet slice by slice: f is
    taken once per shared run and multiplied by its length. The result has a row per pair of a language's sources, and so has each slice
    before its sums are added up.

    Null text, language and source are empty strings. Groups without terms take part with value 0 or with the
    shares of no occurrence. Documents without letters count nothing. Repeated rows are documents of their own. Further columns
    of ``docs`` are ignored. An empty table gives no rows.
    """
    names = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    every = settle(names.groupBy("lang", "source").agg(F.count("*").alias("n_rows")).select("lang", "source"), "divergence-groups")
    counts = settle(term_counts(docs, text, lang, source), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("n_docs").alias("all_docs")).where(F.col("all_docs") >= least)
    kept = settle(kept.select("lang", "term", "all_n"), "divergence-vocabulary")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    counts = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "divergence-kept")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", "all_total", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = settle(groups, "divergence-totals")

    runs = settle(column_runs(counts.select("lang", "source", "term", "n"), groups.where("v > 0")), "divergence-runs")
    slices = runs.groupBy("lang", "slice").agg(F.max("width").alias("width"))
    nothing = groups.where("v > 0").select("lang", "source", share(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    rest = slices.join(nothing, "lang").select("lang", "slice", "width", "source", F.lit(-1).alias("start"), F.lit(0).alias("length"), "p")
    sums = runs.unionByName(rest).groupBy("lang", "slice").applyInPandas(_pair_sums, "lang string, a string, b string, value long")
    sums = settle(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = every.select("lang", F.col("source").alias("a")).join(every.select("lang", F.col("source").alias("b")), "lang").where("a <> b")
    pairs = others.join(both, ["lang", "a", "b"], "left").select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
        F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    used = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q")).where("p > q")
    words = used.select("lang", "source", F.lit("term").alias("part"), "item", term_divergence(F.col("p"), F.col("q")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
