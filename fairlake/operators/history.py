"""Versioned record history: commits, diffs, validity, tags and restore.

History rows have ``record_key``, ``version`` (0, 1, 2… per record), ``content_hash``,
``author``, ``commit_ts``, ``message`` and a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlake.functions import variants as V


def commit(history: DataFrame, snapshot: DataFrame, message: str, author: str, commit_ts) -> DataFrame:
    """History plus one new version of every record whose content changed; none when nothing did."""
    latest = history.groupBy("record_key").agg(
        F.max("version").alias("_version"), F.max_by("content_hash", "version").alias("_hash"))
    changed = snapshot.join(latest, "record_key", "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash")))
    added = changed.withColumn("version", F.coalesce(F.col("_version") + 1, F.lit(0))).drop("_version", "_hash")
    added = (
        added.withColumn("message", F.lit(message)).withColumn("author", F.lit(author))
        .withColumn("commit_ts", commit_ts if isinstance(commit_ts, Column) else F.lit(commit_ts))
    )
    return history.unionByName(added.select(*[c for c in history.columns if c in added.columns]), allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "record_key", content: str = "content_hash") -> DataFrame:
    """Records that were added, removed or changed between two snapshots."""
    a = before.select(key, F.col(content).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(key, F.col(content).alias("_b"), F.lit(True).alias("_in_b"))
    change = (
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def record_history(history: DataFrame, record_key) -> DataFrame:
    """Versions of one record, newest first."""
    return history.where(F.col("record_key") == record_key).orderBy(F.desc("version"))


def with_validity(history: DataFrame, versions: int = 4096) -> DataFrame:
    """Adds ``valid_from`` and ``valid_to`` (NULL for the current version).

    Versions are cut into ranges of ``versions`` numbers, so a record with very many of them is spread
    over tasks; the first commit of the next range closes the last version of a range.
    """
    df = history.withColumn("valid_from", F.col("commit_ts"))
    cut = df.withColumn("_slice", F.coalesce(F.floor(F.col("version") / versions), F.lit(-1)))
    starts = cut.groupBy("record_key", "_slice").agg(F.min_by("commit_ts", F.struct("version")).alias("_start"))
    next_start = starts.select(
        F.col("record_key").alias("_key"), F.col("_slice").alias("_range"),
        F.lead("_start").over(Window.partitionBy("record_key").orderBy("_slice")).alias("_next"))
    inside = Window.partitionBy("record_key", "_slice").orderBy("version")
    return (
        cut.withColumn("_lead", F.lead("commit_ts").over(inside))
        .join(next_start, F.col("record_key").eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_range")))
        .withColumn("valid_to", F.coalesce("_lead", "_next"))
        .drop("_slice", "_lead", "_next", "_key", "_range")
    )


def as_of(history: DataFrame, at) -> DataFrame:
    """The version of every record that was valid at a moment."""
    valid = with_validity(history)
    return valid.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def tag(history: DataFrame, name: str, message: str) -> DataFrame:
    """One row that names the present state of the history."""
    return history.agg(F.max("commit_ts").alias("commit_ts")).select(
        F.lit(name).alias("tag"), F.lit(message).alias("message"), "commit_ts")


def restore(history: DataFrame, at_version=None, at_ts=None) -> DataFrame:
    """Every record as it was at a version or at a moment."""
    kept = history
    if at_version is not None:
        kept = kept.where(F.col("version") <= at_version)
    if at_ts is not None:
        kept = kept.where(F.col("commit_ts") <= at_ts)
    rest = [c for c in history.columns if c != "record_key"]
    return kept.groupBy("record_key").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(
        "record_key", *[F.col(f"_r.{c}").alias(c) for c in rest])


def untracked(files: DataFrame, tracked: DataFrame, key: list[str]) -> DataFrame:
    """Data files that are not tracked yet."""
    return files.join(tracked, key, "left_anti")


def consecutive_versions(history: DataFrame, body: str = "body") -> DataFrame:
    """Every version next to its predecessor (NULL for the first); matched by equality on
    record and version number, so records with many versions spread over tasks."""
    before = history.select("record_key", (F.col("version") + 1).alias("version"), F.col(body).alias("old_body"))
    return history.withColumnRenamed(body, "new_body").join(before, ["record_key", "version"], "left")


def field_diff(pairs: DataFrame, required: list[str] | None = None, system: list[str] | None = None,
               errors: str | None = None, keys: tuple[str, ...] = ("record_key", "version")) -> DataFrame:
    """Field status of ``new_body`` against ``old_body``, one row per field of either.

    ``errors`` names an array<string> column with the fields that have an error.
    """
    old, new = F.col("_old"), F.col("_new")
    none = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys(old), none), F.coalesce(F.map_keys(new), none))
    # The maps are built below the explode, once per pair and not once per field.
    maps = pairs.select(*keys, *([errors] if errors else []), V.members("old_body").alias("_old"), V.members("new_body").alias("_new"))
    fields = maps.select("*", F.explode(names).alias("field"))
    before, after = F.try_element_at("_old", F.col("field")), F.try_element_at("_new", F.col("field"))
    complete = V.form_complete(after, trim=True)
    has_error = F.array_contains(errors, F.col("field")) if errors else F.lit(False)
    return fields.select(
        *keys, "field",
        (~F.to_json(before).eqNullSafe(F.to_json(after))).alias("is_modified"),
        complete.alias("is_completed"), has_error.alias("has_error"),
        F.col("field").isin(required or []).alias("is_required"),
        (~complete).alias("is_empty"),
        F.col("field").isin(system or []).alias("is_system"),
    )


def diff_stats(diff: DataFrame, keys: tuple[str, ...] = ("record_key", "version")) -> DataFrame:
    """Totals of a field diff; system fields do not count as modified."""
    return diff.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_modified") & ~F.col("is_system")).alias("modified"),
        F.count_if("is_completed").alias("completed"), F.count_if("has_error").alias("errors"),
        F.count_if("is_required").alias("required"),
        F.count_if(F.col("is_required") & F.col("is_completed")).alias("required_completed"),
        F.count_if("is_system").alias("system"))


def primary_status() -> Column:
    """The one status shown for a field."""
    return (
        F.when(F.col("is_system"), "system").when(F.col("has_error"), "error").when(F.col("is_completed"), "completed")
        .when(F.col("is_required") & F.col("is_empty"), "required").when(F.col("is_modified"), "modified")
        .otherwise("empty")
    )
