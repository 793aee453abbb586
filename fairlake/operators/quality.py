"""Completion gate, scores, complete records and form progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake.functions import variants as V
from fairlake.operators.records import with_members
from fairlake.operators.registry import unescaped, with_rules
from fairlake.operators.templates import linked_body


def completion_gate(contextual: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Adds ``complete`` and ``experiment_id``: every required field but audit and template fields is filled."""
    matched, _ = with_rules(contextual, registry, top_only=True)
    ignored = F.array(*[F.lit(f) for f in C.GATE_IGNORED_FIELDS])
    gated = F.array_except(F.coalesce(F.col("rules")[""]["required"], F.array().cast("array<string>")), ignored)
    passing = F.map_keys(F.map_filter(V.members("body"), lambda _, v: V.passes_gate(v)))
    complete = F.size(F.array_except(gated, passing)) == 0
    return matched.withColumn("complete", F.coalesce(complete, F.lit(False))).withColumn(
        "experiment_id", F.when(F.col("complete"), V.text("body", "experiment_identifier_run_id"))).drop("rules")


def completeness(records: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``total_fields`` and ``filled_fields``, counted inside the row at any depth.

    Each object member counts; of array items only scalars do. A scalar is filled when it is
    truthy and not the placeholder. Members are the colons of the value's shape, scalar items the
    marks between brackets or commas.
    """
    shape = F.col("_shape")
    members = F.length(shape) - F.length(F.replace(shape, F.lit(":")))
    items = F.regexp_count(shape, F.lit(r"(?<=[\[,])[es](?=[,\]])"))
    filled = F.regexp_count(shape, F.lit(r"(?<=[\[,:])s(?=[,\]}])"))
    return records.withColumn("_shape", V.scalar_marks(body)).select(
        *records.columns, F.coalesce(members + items, F.lit(0)).alias("total_fields"), F.coalesce(filled, F.lit(0)).alias("filled_fields"))


def completeness_score() -> Column:
    return F.when(F.col("total_fields") > 0, F.col("filled_fields") / F.col("total_fields")).otherwise(0.0)


def quality(score: Column, compliant: Column) -> Column:
    return F.when(compliant, score * 0.8 + 0.2).otherwise(score * 0.6)


# What the wrapping of a complete record adds to its scores.
ENVELOPE_FIELDS = 20
ENVELOPE_FILLED = 9


def finalize(records: DataFrame, run_ts: str, registry: DataFrame | None = None, generated_by: str = "fairlake") -> DataFrame:
    """Complete records of all datasets that pass the gate and have all five components.

    An empty dataset link of a contextual record is filled with the structural record's id
    first. Published is what the complete-record schema allows: components that are objects and
    a run id that is a string. The other components are scored where they are; those of a dataset, and those of a
    project, then meet in one aggregation each, and the two results are joined on the project.
    """
    kinds = {"dataset": ("dataset_administrative", "dataset_structural", "experiment_contextual"),
             "project": ("project_descriptive", "project_administrative")}
    contextual = completion_gate(records.where("metadata_type = 'experiment_contextual'"), registry)
    text_id = V.kind(V.field("body", "experiment_identifier_run_id")) == "string"
    ready = contextual.where(F.col("complete") & text_id & (F.coalesce("experiment_id", F.lit("")) != "")).select(
        "project_key", "dataset_key", "metadata_type", "body", "experiment_id",
        F.lit(0).alias("total_fields"), F.lit(0).alias("filled_fields"))
    others = completeness(records.where("metadata_type <> 'experiment_contextual'")).select(
        "project_key", "dataset_key", "metadata_type", "body", F.lit(None).cast("string").alias("experiment_id"), "total_fields", "filled_fields")

    def together(rows: DataFrame, keys: list[str], owner: str) -> DataFrame:
        objects = rows.where(F.col("metadata_type").isin(*kinds[owner]) & (V.kind("body") == "object"))
        mine = objects.groupBy(*keys).agg(
            *[F.first(F.when(F.col("metadata_type") == k, F.struct("body", "experiment_id", "total_fields", "filled_fields")),
                      ignorenulls=True).alias(f"_{k}") for k in kinds[owner]])
        have = [F.col(f"_{k}").isNotNull() for k in kinds[owner]]
        return mine.where(have[0] & have[1] & have[-1])

    datasets = together(ready.unionByName(others), ["project_key", "dataset_key"], "dataset")
    projects = together(others.drop("dataset_key"), ["project_key"], "project")
    whole = datasets.join(projects, "project_key").select(
        "project_key", "dataset_key", F.col("_experiment_contextual.experiment_id").alias("experiment_id"),
        linked_body(F.col("_experiment_contextual.body"), V.field("_dataset_structural.body", "dataset_identifier")).alias("experiment_contextual"),
        *[F.col(f"_{k}.body").alias(k) for k in C.COMPONENT_TYPES if k != "experiment_contextual"],
        sum((F.col(f"_{k}.total_fields") for k in C.COMPONENT_TYPES), F.lit(0)).alias("_total"),
        sum((F.col(f"_{k}.filled_fields") for k in C.COMPONENT_TYPES), F.lit(0)).alias("_filled"))
    scored = completeness(whole, "experiment_contextual").withColumn("_all", F.to_variant_object(F.struct(*C.COMPONENT_TYPES)))
    score = (F.col("filled_fields") + F.col("_filled") + ENVELOPE_FILLED) / (F.col("total_fields") + F.col("_total") + ENVELOPE_FIELDS)
    document = F.to_json(F.struct(
        F.lit("2.0").alias("version"), F.col("experiment_id").alias("experiment_identifier"),
        F.col("_all").alias("metadata_components"),
        F.struct(*[F.lit(v).alias(k) for k, v in C.RELATIONSHIPS.items()]).alias("metadata_relationships"),
        F.struct(F.lit(True).alias("schema_compliance"), F.col("completeness_score"), F.col("quality_score")).alias("metadata_validation"),
        F.struct(F.lit(generated_by).alias("generated_by"), F.lit(run_ts).alias("generation_date"),
                 F.lit(run_ts).alias("last_validation_date")).alias("metadata_provenance")))
    return scored.withColumn("completeness_score", score).withColumn(
        "quality_score", quality(F.col("completeness_score"), F.lit(True))).select(
        "project_key", "dataset_key", "experiment_id", "completeness_score", "quality_score", document.alias("document"))


def with_instruments(complete: DataFrame, contextual: DataFrame, instruments: DataFrame) -> DataFrame:
    """Complete records with the instruments that their experiment names: in the document, beside the other components.

    ``contextual`` has ``project_key``, ``dataset_key`` and ``body`` with ``instrument_used_link``, a list or one text; ``instruments``
    has ``instrument_id`` (unique) and ``body``. The document gets ``metadata_components.instruments``, in the order of the links
    and each once; ``unknown_instruments`` lists the links that no instrument has. Records without links get an empty list. The
    document's members are in alphabetical order. Links are exploded, joined and collected again per dataset, so only links and instruments
    are shuffled, never whole records twice.
    """
    key = ["project_key", "dataset_key"]
    value = V.field("body", "instrument_used_link")
    listed = F.coalesce(F.transform(V.items(value), lambda x: F.when(~V.is_container(x), x.cast("string"))), F.array(V.text("body", "instrument_used_link")))
    links = contextual.select(*key, F.posexplode(listed).alias("at", "link")).where(F.col("link").isNotNull() & ~V.is_blank(F.col("link")))
    links = links.groupBy(*key, "link").agg(F.min("at").alias("at"))
    known = instruments.select(F.col("instrument_id").alias("_id"), F.to_json("body").alias("_text"))
    per = links.join(known, F.col("link") == F.col("_id"), "left").groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("at", "link", "_text"))).alias("_links"))
    none = F.array().cast("array<struct<at:int,link:string,_text:string>>")
    joined = complete.join(per, key, "left").withColumn("_links", F.coalesce("_links", none))
    texts = F.transform(F.filter("_links", lambda x: x["_text"].isNotNull()), lambda x: x["_text"])
    unknown = F.transform(F.filter("_links", lambda x: x["_text"].isNull()), lambda x: x["link"])
    document = F.parse_json("document")
    part = with_members(V.field(document, "metadata_components"), {"instruments": F.parse_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))})
    return joined.withColumns({"document": F.to_json(with_members(document, {"metadata_components": part})), "unknown_instruments": unknown}).drop("_links")


def _sections() -> Column:
    def words(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    general = F.array(F.struct(F.lit("general").alias("id"), F.array(F.lit("")).alias("words"), words([]).alias("names")))
    out = general
    for kind, sections in C.FORM_SECTIONS.items():
        mine = F.array(*[F.struct(F.lit(i).alias("id"), words(w).alias("words"), words(n).alias("names")) for i, (w, n) in sections.items()])
        out = F.when(F.col("metadata_type") == kind, mine).otherwise(out)
    return out


def section_progress(records: DataFrame, registry: DataFrame | None = None, errors: str | None = None,
                     keys: tuple[str, ...] = ("record_key", "metadata_type")) -> DataFrame:
    """Progress of every form section: fields, completed, required, errors, percentages and state.

    A field belongs to each section whose words occur in its name. Row-local but for the
    lookup of the schema. ``errors`` names an array<string> column of fields with errors.
    """
    none = F.array().cast("array<string>")
    df = with_rules(records, registry, top_only=True)[0].where("rules IS NOT NULL").select(
        *keys, *([] if "metadata_type" in keys else ["metadata_type"]),
        F.transform(F.filter(F.map_keys("rules"), lambda k: ~k.isin("", "[]")), unescaped).alias("_names"),
        F.coalesce(F.col("rules")[""]["required"], none).alias("_needed"),
        F.map_keys(F.map_filter(V.members("body"), lambda _, v: V.form_complete(v))).alias("_done"),
        (F.col(errors) if errors else none).alias("_wrong"))
    rows = df.select("*", F.explode(_sections()).alias("_s")).withColumn(
        "_in", F.filter("_names", lambda n: F.exists(F.col("_s.words"), lambda w: F.contains(n, w)) | F.array_contains("_s.names", n)))
    needed = F.array_intersect("_in", "_needed")
    counted = rows.where(F.size("_in") > 0).select(
        *keys, F.col("_s.id").alias("section"), F.size("_in").alias("fields"),
        F.size(F.array_intersect("_in", "_done")).alias("completed"), F.size(needed).alias("required"),
        F.size(F.array_intersect(needed, F.col("_done"))).alias("required_completed"),
        F.size(F.array_intersect("_in", "_wrong")).alias("errors"))
    return counted.select("*", *_percentages(), section_state().alias("state"))


def _percentages() -> tuple[Column, Column]:
    overall = F.when(F.col("fields") > 0, F.col("completed") / F.col("fields") * 100).otherwise(0.0)
    required = F.when(F.col("required") > 0, F.col("required_completed") / F.col("required") * 100).otherwise(100.0)
    return overall.alias("progress"), required.alias("required_progress")


def section_state() -> Column:
    """error, required fields empty, else complete: a section without open required fields is complete."""
    return (
        F.when(F.col("errors") > 0, "error").when(F.col("required_completed") < F.col("required"), "required_empty")
        .otherwise("complete")
    )


def progress(sections: DataFrame, keys: tuple[str, ...] = ("record_key", "metadata_type")) -> DataFrame:
    """Overall progress and message; a field that is in several sections counts in each."""
    sums = sections.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (
        "fields", "completed", "required", "required_completed", "errors")])
    left = F.col("required") - F.col("required_completed")

    def counted(number: Column, text: str, tail: str) -> Column:
        return F.concat(number.cast("string"), F.lit(text), F.when(number > 1, "s").otherwise(""), F.lit(tail))

    message = (
        F.when(F.col("errors") > 0, counted(F.col("errors"), " field", " have errors"))
        .when(left == 0, "All required fields completed").otherwise(counted(left, " required field", " remaining")))
    return sums.select("*", *_percentages(), message.alias("message"))
