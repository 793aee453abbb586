"""Mixing sources to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlake.llm.common import settle, words

SLICES = 4096


def pattern_weights(docs: DataFrame, source: str, pattern: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """Sources by code point, null last, with weights that repeat ``pattern``."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weights = F.array(*[F.lit(w) for w in pattern])
    return docs.groupBy(F.col(source).alias("source")).agg(F.lit(1).alias("one")).select(
        "source", F.get(weights, place % len(pattern)).cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float, epochs: int) -> DataFrame:
    """Adds to ``(source, source_size)`` the words each source gives, ``target``, and the time ``level`` it ends.

    Sources share ``share`` of all sizes by weight; one that would give more than ``epochs``
    times its size stops there, and what is left is shared anew. Sources in the order in which
    they run dry (``epochs * size / weight``) need a single pass: a source stops exactly when
    the level that the rest would reach is above its own. The table has one row per source,
    so the ordered passes over it are small.
    """
    full = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"])).select(sizes["source"], "source_size", "weight")
    full = full.where(F.col("weight") > 0).withColumn("most", F.col("source_size") * epochs)
    dry = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = dry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    level = full.select(
        "*", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"))
    # weight * left_words / left_weight is what a source gets if all drier ones stop at their most
    level = level.withColumn("dry", F.col("weight") * F.col("left_words") >= F.col("most") * F.col("left_weight"))
    level = level.withColumn("place", F.row_number().over(dry))
    first = F.min(F.when(~F.col("dry"), F.struct("place", "left_words", "left_weight"))).over(everything)
    last = F.max(F.col("most") / F.col("weight")).over(everything)
    return level.withColumn("first", first).withColumn("last", last).select(
        "source", "source_size", "weight",
        F.when(F.col("dry"), F.col("most").cast("double"))
        .otherwise(F.col("weight") * F.col("first.left_words") / F.col("first.left_weight")).alias("target"),
        F.coalesce(F.col("first.left_words") / F.col("first.left_weight"), F.col("last")).alias("level"))


def _before(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Adds ``before``: sum of ``size`` over rows of the same keys that come earlier by ``ticket``.

    Tickets are uniform hashes, so their leading digits cut every key, a hot one too, into
    slices of about equal length; slice totals combine before their shuffle.
    """
    sliced = df.withColumn("slice", F.conv(F.substring("ticket", 1, 3), 16, 10).cast("int")).withColumn("n", size)
    totals = sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "slice", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("slice_before"))
    inside = Window.partitionBy(*keys, "slice").orderBy("ticket", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [joined[k].eqNullSafe(offsets[k]) for k in [*keys, "slice"]]
    return joined.join(offsets, same).select(
        *[joined[c] for c in df.columns], (F.col("inside") + F.col("slice_before")).cast("long").alias("before"))


def queue(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
          source: str = "source", share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Every copy of every document in the order of service, and the words the mix takes of it.

    Every source shuffles its documents by a seeded hash and repeats that order ``epochs`` times.
    A document's virtual finish time is the count of its source's words up to its end divided by
    the source's weight. Copies are range-sorted by it over all sources, and the mix ends when
    ``share`` of all words are given: at one virtual time for all sources that have not run dry.
    A document in service at that time is cut there.

    Returns ``id_col``, ``source``, ``size`` (words), ``source_size``, ``target`` (words its source
    gives), ``epoch``, ``before`` (words of the source ahead of the document), ``taken``,
    ``finish`` and ``position`` (words of the mix ahead of it). Null texts have size 0; null
    sources form one source. Repeated rows are documents of their own. Documents without words
    are never taken. ``weights`` has ``(source, weight)``; a source that it leaves out, or gives 0, is left out.
    Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    sized = settle(_sized(docs, id_col, text, source, seed), "mix-sizes")
    return _served(sized, weights, share, epochs).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "epoch",
                                                         "before", "taken", "finish", "position")


def _sized(docs: DataFrame, id_col: str, text: str, source: str, seed: str, *more: Column) -> DataFrame:
    """Ids, sources and sizes with a ticket for the shuffle: a hash of the id, or of the text where there is no id."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.sha2(F.col(text), 256)))
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"),
                       F.xxhash64(text).alias("text_hash"), F.md5(F.concat_ws("|", F.lit(seed), own)).alias("ticket"), *more)


def _served(sized: DataFrame, weights: DataFrame | None, share: float, epochs: int) -> DataFrame:
    """The queue over rows of :func:`_sized`, with all their columns."""
    weights = pattern_weights(sized, "source") if weights is None else weights
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, weights, share, epochs).withColumnRenamed("source", "goal_source")
    queued = _before(sized, ["source"], F.col("size")).join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    copies = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    taken = F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target") - start)).cast("long")
    return _positions(copies.withColumn("taken", taken).withColumn("finish", (start + F.col("size")) / F.col("weight")))


def _positions(served: DataFrame) -> DataFrame:
    """Adds ``position`` in the order of finish times: totals of time ranges, then sums inside each range."""
    share = F.coalesce(F.try_divide(F.least("finish", "level"), F.col("level")), F.lit(0.0))
    behind = F.lit(SLICES) + F.pmod(F.xxhash64("ticket"), F.lit(SLICES))  # after the end of the mix, in no order
    ranged = served.withColumn("stretch", F.when(F.col("finish") > F.col("level"), behind).otherwise(F.floor(share * SLICES)).cast("int"))
    totals = ranged.groupBy("stretch").agg(F.sum("taken").alias("total"))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * SLICES rows
    offsets = totals.select("stretch", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("stretch_before"))
    order = Window.partitionBy("stretch").orderBy("finish", F.col("source").isNull(), "source", "epoch", "ticket", "id", "text_hash")
    inside = F.sum("taken").over(order.rowsBetween(Window.unboundedPreceding, -1))
    counted = ranged.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return counted.join(offsets, "stretch").withColumn("position", (F.col("inside") + F.col("stretch_before")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None,
        share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: rows of ``docs``, a row twice if it is taken twice, with ``epoch``, ``taken`` and ``position``.

    Columns of these names are replaced. Takes the options of :func:`queue`. A document that the end of the mix cuts keeps its first
    ``taken`` words, joined by one blank. Rows are told apart by a key that is written with them, so rows that share an id, or
    have none, are documents of their own; those without an id are shuffled by a hash of their text.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.monotonically_increasing_id())
    keyed = settle(keyed, "mix-rows")  # written once, so a lost executor cannot change a key
    sized = settle(_sized(keyed.select("key", F.col(f"row.{id_col}").alias("i"), F.col(f"row.{text}").alias("t"), F.col(f"row.{source}").alias("s")),
                          "i", "t", "s", seed, F.col("key")), "mix-sizes")
    served = _served(sized, weights, share, epochs).where("taken > 0").select(F.col("key").alias("k"), "size", "epoch", "taken", "position")
    found = words(F.col(f"row.{text}"))
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(found, 1, F.col("taken").cast("int")), " "))
    joined = keyed.join(served, F.col("key") == F.col("k"))
    added = ["epoch", "taken", "position"]
    return joined.select(*[F.coalesce(cut, F.col(f"row.{c}")).alias(c) if c == text else F.col(f"row.{c}")
                           for c in docs.columns if c not in added], *added)
