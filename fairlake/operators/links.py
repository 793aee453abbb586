"""Links between records: which point nowhere, and which records hang below a broken one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlake.constants import PLACEHOLDER
from fairlake.functions import variants as V
from fairlake.session import shared_dir

# Metadata type, link field, kind of what it names.
LINK_FIELDS = (
    ("dataset_structural", "associated_project_identifier", "project"),
    ("project_administrative", "project_identifier_link", "project"),
    ("dataset_administrative", "dataset_identifier_link", "dataset"),
    ("experiment_contextual", "dataset_identifier_link", "dataset"),
    ("experiment_contextual", "instrument_used_link", "instrument"),
)
# Metadata type, identifier field, kind that it names.
ID_FIELDS = (
    ("project_descriptive", "project_identifier", "project"),
    ("dataset_structural", "dataset_identifier", "dataset"),
)


def _settled(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _named(value):
    """A value that names something: neither null, blank nor the placeholder."""
    return value.isNotNull() & ~V.is_blank(value) & (value != PLACEHOLDER)


def record_links(records: DataFrame) -> DataFrame:
    """``(record_key, field, kind, target)`` for every link that a record's body holds; a list gives one row per item."""
    def of(metadata_type: str, field: str, kind: str):
        value = V.field("body", field)
        texts = F.coalesce(F.transform(V.items(value), lambda x: F.when(~V.is_container(x), x.cast("string"))), F.array(V.text("body", field)))
        return F.when(F.col("metadata_type") == metadata_type, F.transform(
            texts, lambda t: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), t.alias("target"))))

    found = [of(*named) for named in LINK_FIELDS]
    none = F.array().cast("array<struct<field:string,kind:string,target:string>>")
    links = records.select("record_key", F.explode(F.flatten(F.array(*[F.coalesce(x, none) for x in found]))).alias("x"))
    return links.select("record_key", "x.*").where(_named(F.col("target"))).distinct()


def record_ids(records: DataFrame) -> DataFrame:
    """``(record_key, kind, target)`` for every identifier by which a record can be linked to."""
    found = [F.when(F.col("metadata_type") == metadata_type, F.struct(F.lit(kind).alias("kind"), V.text("body", field).alias("target")))
             for metadata_type, field, kind in ID_FIELDS]
    return records.select("record_key", F.coalesce(*found).alias("x")).select("record_key", "x.*").where(_named(F.col("target")))


def broken_links(records: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """Links that lead nowhere, and links to records that such a link breaks: ``record_key, field, target, depth``.

    Depth 1 is a link whose target no record (or row of ``instruments``, column ``instrument_id``) has as its identifier.
    A link to an identifier of a record with a broken link has the next depth, and so on: an experiment of a
    dataset whose project is missing has depth 2. Each link is reported once, at its least depth.

    Targets and links of all kinds meet in one aggregation that keeps one row per identifier, so a target with a
    third of all links costs a row per task. Rounds follow the depth of the hierarchy: an identifier
    enters a round once only, so loops end too. Each round is written, and only its own new identifiers are joined.
    Blank and placeholder values are no links. Without ``instruments`` every instrument is missing.
    """
    links = _settled(record_links(records), "links")
    ids = _settled(record_ids(records), "link-ids")
    targets = ids.select("kind", "target")
    if instruments is not None:
        targets = targets.unionByName(instruments.select(F.lit("instrument").alias("kind"), F.col("instrument_id").alias("target")))
    both = targets.withColumn("there", F.lit(True)).unionByName(links.select("kind", "target", F.lit(False).alias("there")))
    missing = both.groupBy("kind", "target").agg(F.bool_or("there").alias("there")).where(~F.col("there")).select("kind", "target")
    frontier, seen, found, depth = _settled(missing, "links-missing"), None, [], 1
    while not frontier.isEmpty():
        level = _settled(links.join(frontier, ["kind", "target"], "left_semi").withColumn("depth", F.lit(depth)), "links-level")
        found.append(level)
        seen = frontier if seen is None else _settled(seen.unionByName(frontier), "links-seen")
        above = ids.join(level.select("record_key").distinct(), "record_key", "left_semi").select("kind", "target").distinct()
        frontier, depth = _settled(above.join(seen, ["kind", "target"], "left_anti"), "links-frontier"), depth + 1
    out = found[0] if found else links.where("false").withColumn("depth", F.lit(1))
    for level in found[1:]:
        out = out.unionByName(level)
    return out.select("record_key", "field", "target", "depth")
