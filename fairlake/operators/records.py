"""Record updates: merge, audit stamps, protected identifiers, migration, lookup.

Records have ``record_key``, ``metadata_type`` and a VARIANT ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake import schemas as S
from fairlake.functions import paths as P
from fairlake.functions import variants as V
from fairlake.functions.ids import mint_id
from fairlake.operators.registry import dispatch, effective
from fairlake.operators.validation import validate


def truthy(value: Column) -> Column:
    """Present and not null, '', 0, false or an empty container."""
    j = F.to_json(value)
    return F.coalesce(~(j.isin("null", '""', "false", "[]", "{}") | j.rlike(f"^{V.ZERO}$")), F.lit(False))


def with_members(body: Column, members: dict[str, Column]) -> Column:
    """The object with some members set; a member whose new value is SQL NULL keeps its old one."""
    new = F.map_filter(F.create_map(*[x for n, c in members.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    return F.to_variant_object(F.map_zip_with(V.members(body), new, lambda _, a, b: F.coalesce(b, a)))


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("variant")


def last_updates(updates: DataFrame, order: list[str]) -> DataFrame:
    """One update per record: of each member the value of the last update in ``order`` that has it.

    Members combine before the shuffle, so a record with very many updates stays small.
    """
    rest = [c for c in updates.columns if c not in ("record_key", "body", *order)]
    at = F.struct(*order)
    members = updates.select("record_key", *order, F.explode(V.members("body")).alias("name", "value"))
    latest = members.groupBy("record_key", "name").agg(F.max_by("value", at).alias("value"))
    bodies = latest.groupBy("record_key").agg(F.to_variant_object(
        F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("body"))
    others = updates.groupBy("record_key").agg(*[F.max_by(c, at).alias(c) for c in rest])
    return others.join(bodies, "record_key")


def merge_records(current: DataFrame, updates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Shallow merge: members of an update replace those of the record; adds ``old_body``.

    ``order`` names the columns that order several updates of one record; without it records have one update.
    """
    updates = last_updates(updates, order) if order else updates
    cur = current.withColumnRenamed("body", "old_body")
    new = updates.select("record_key", F.col("metadata_type").alias("_type"), F.col("body").alias("_update"))
    none = F.create_map().cast("map<string,variant>")
    merged = F.to_variant_object(F.map_zip_with(
        F.coalesce(V.members("old_body"), none), F.coalesce(V.members("_update"), none), lambda _, a, b: F.coalesce(b, a)))
    return cur.join(new, "record_key", "full").withColumn("body", merged).withColumn(
        "metadata_type", F.coalesce("metadata_type", "_type")).drop("_type", "_update")


def stamp_audit(merged: DataFrame, run_ts: str, actor: str = "system") -> DataFrame:
    """Sets audit members of project and contextual records; expects ``old_body`` beside ``body``."""
    def created(name: str, default: str) -> Column:
        kept = F.coalesce(V.field("old_body", name), _text(default))
        return F.when(~truthy(V.field("body", name)) | V.field("body", name).isNull(), kept)

    stamped = with_members(F.col("body"), {
        "created_date": created("created_date", run_ts), "created_by": created("created_by", actor),
        "last_modified_date": _text(run_ts), "last_modified_by": _text(actor)})
    return merged.withColumn("body", F.when(F.col("metadata_type").isin(C.AUDITED_TYPES), stamped).otherwise(F.col("body")))


def protect_ids(merged: DataFrame) -> DataFrame:
    """Restores protected identifiers that the existing record has."""
    names = F.create_map(*[x for k, v in C.PROTECTED_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    mine = F.coalesce(F.try_element_at(names, F.col("metadata_type")), F.array().cast("array<string>"))
    kept = F.map_filter(V.members("old_body"), lambda k, _: F.array_contains(mine, k))
    restored = F.to_variant_object(F.map_zip_with(V.members("body"), kept, lambda _, a, b: F.coalesce(b, a)))
    return merged.withColumn("body", F.coalesce(restored, "body"))


def migrate_contextual(records: DataFrame, legacy: bool = True) -> DataFrame:
    """Fills what older contextual records lack: template, ``experiment_name`` and a UUID run id.

    ``legacy`` reads the template from ids of the form ``exp_a_b_<template>``.
    """
    run_id = F.when(V.kind(V.field("body", "experiment_identifier_run_id")) == "string",
                    V.text("body", "experiment_identifier_run_id"))
    parts = F.split(run_id, "_")
    derived = F.when(
        F.lit(legacy) & run_id.startswith("exp_") & (F.size(parts) >= 4)
        & ~truthy(V.field("body", "experiment_template_type")),
        F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(1))), "_"))
    return records.withColumn("body", with_members(F.col("body"), {
        "experiment_template_type": derived.cast("variant"),
        "experiment_name": F.when(V.field("body", "experiment_name").isNull(), _text("")),
        "experiment_identifier_run_id": F.when(~P.is_uuid_like(run_id), mint_id("record_key").cast("variant")),
    }))


def records_with_schema(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds id, title (default: the id), description and source of the schema that applies.

    Layers are resolved first: a record with a ``data_root`` follows the schemas of its root, others the winning
    one over all roots. Every record has one row.
    """
    by_root = "data_root" in records.columns
    chosen = effective(registry, by_root)
    return dispatch(records, chosen, ["title", "description", "source"], "data_root" if by_root else None).select(
        *records.columns, "schema_id", F.coalesce("title", "schema_id").alias("schema_title"),
        F.col("description").alias("schema_description"), F.col("source").alias("schema_source"))


def get_record(records: DataFrame, owner_key: str, metadata_type: str) -> DataFrame:
    """The record of one project or dataset; an unknown type is an error."""
    if metadata_type not in S.BY_TYPE:
        raise ValueError(f"unknown metadata type: {metadata_type}")
    owner = "project_key" if metadata_type.startswith("project_") else "dataset_key"
    return records.where((F.col("metadata_type") == metadata_type) & (F.col(owner) == owner_key))


def judge_updates(current: DataFrame, updates: DataFrame, run_ts: str, registry: DataFrame | None = None,
                  actor: str = "system", order: list[str] | None = None) -> DataFrame:
    """Merges and stamps updates and adds ``violations`` and ``valid``; one row per updated record.

    ``order`` names the columns that order several updates of one record: of each member the last value counts. Without
    it the order is that of a hash of the body, so that a record has one row in any case.
    Protected identifiers are restored after validation: an update is judged on its own values.
    """
    if order is None:
        updates, order = updates.withColumn("_order", F.xxhash64(F.to_json("body"))), ["_order"]
    updates = last_updates(updates, order)
    touched = merge_records(current.join(updates.select("record_key"), "record_key", "left_semi"), updates)
    return protect_ids(validate(stamp_audit(touched, run_ts, actor), registry))


def apply_updates(current: DataFrame, updates: DataFrame, run_ts: str, registry: DataFrame | None = None,
                  actor: str = "system", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Judged updates as (accepted records, rejected records with their violations); one row per updated record."""
    judged = judge_updates(current, updates, run_ts, registry, actor, order).drop("old_body")
    return judged.where("valid").drop("violations", "valid"), judged.where("NOT valid")
