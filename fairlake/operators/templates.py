"""Default records from schemas, initial records of new projects and datasets, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake.functions import paths as P
from fairlake.functions import variants as V
from fairlake.functions.ids import mint_id
from fairlake.operators.records import truthy, with_members
from fairlake.operators.registry import BASE_CONTEXTUAL, effective, packaged_registry


def _default(name: Column, node: Column, nested: bool) -> Column:
    kind = V.text(node, "type")
    const, enum = V.field(node, "const"), F.get(V.items(V.field(node, "enum")), F.lit(0))
    shaped = V.field(node, "pattern").isNotNull() | V.field(node, "format").isNotNull()
    specials = F.create_map(*[F.lit(x) for kv in C.PLACEHOLDER_BY_NAME.items() for x in kv])
    text = F.coalesce(const, enum, F.when(shaped, F.try_element_at(specials, name)).cast("variant"),
                      F.lit(C.PLACEHOLDER).cast("variant"))
    out = (
        F.when(kind == "string", text).when(kind == "integer", F.parse_json(F.lit("0")))
        .when(kind == "number", F.lit(0.0).cast("double").cast("variant")).when(kind == "boolean", F.lit(False).cast("variant"))
        .when(kind == "array", F.parse_json(F.lit("[]")))
    )
    if nested:
        out = out.when(kind == "object", F.coalesce(_default_object(node, False), F.parse_json(F.lit("{}"))))
    return out.otherwise(F.lit(C.PLACEHOLDER).cast("variant"))


def _default_object(node: Column, nested: bool) -> Column:
    entries = F.map_entries(V.members(V.field(node, "properties")))
    return F.to_variant_object(F.map_from_entries(F.transform(entries, lambda e: F.struct(
        e["key"].alias("key"), _default(e["key"], e["value"], nested).alias("value")))))


def default_records(registry: DataFrame) -> DataFrame:
    """One row per schema: its default record and, if fixed, its template name.

    Objects are filled one level deep; an object inside an object becomes the placeholder. A schema
    without properties has an empty record.
    """
    schema = V.parse_strict("body")
    template = V.field(V.field("_schema", "properties"), "experiment_template_type")
    return registry.withColumn("_schema", schema).select(
        "data_root", "schema_id", F.coalesce(_default_object(F.col("_schema"), True), F.parse_json(F.lit("{}"))).alias("defaults"),
        V.text(template, "const").alias("template_const"))


def fill(defaults: Column, auto: Column) -> Column:
    """Default record with automatic values; fields that the schema lacks are left out."""
    return _fill_members(V.members(defaults), auto)


def _fill_members(defaults: Column, auto: Column) -> Column:
    both = F.map_zip_with(defaults, auto, lambda _, value, new: F.when(value.isNotNull(), F.coalesce(new, value)))
    return F.to_variant_object(F.map_filter(both, lambda _, v: v.isNotNull()))


def _auto(values: dict[str, Column | str]) -> Column:
    pairs = []
    for name, value in values.items():
        pairs += [F.lit(name), (value if isinstance(value, Column) else F.lit(value)).cast("variant")]
    return F.create_map(*pairs)


def _audit(run_ts: str) -> dict:
    return {"created_by": "system", "created_date": run_ts, "last_modified_by": "system", "last_modified_date": run_ts}


def _registry_of(rows: DataFrame, registry: DataFrame | None) -> DataFrame:
    """The winning schemas: of each data root if ``rows`` have a ``data_root``, else over all roots."""
    return packaged_registry(rows.sparkSession) if registry is None else effective(registry, "data_root" in rows.columns)


def _with_defaults(rows: DataFrame, registry: DataFrame | None, schema_id: str, out: str) -> DataFrame:
    """Adds the members of a schema's default record, NULL where a row's data root has none.

    They are spread into a map once per schema, not for every row.
    """
    found = default_records(_registry_of(rows, registry).where(F.col("schema_id") == schema_id))
    members = V.members("defaults").alias(out)
    if registry is None or "data_root" not in rows.columns:
        return rows.withColumn(out, found.select(members).scalar())
    return rows.join(found.select("data_root", members), "data_root", "left")


def init_projects(dirs: DataFrame, run_ts: str, registry: DataFrame | None = None) -> DataFrame:
    """A descriptive record for every project directory."""
    auto = _auto({"project_identifier": mint_id("project_key"),
                  "project_title": P.strip_prefix("project_key", C.PROJECT_PREFIX)} | _audit(run_ts))
    return _with_defaults(dirs, registry, "project_descriptive", "_defaults").select(
        "project_key", F.lit("project_descriptive").alias("metadata_type"), mint_id("project_key").alias("project_identifier"),
        _fill_members(F.col("_defaults"), auto).alias("body"))


def init_project_admin(projects: DataFrame, run_ts: str, registry: DataFrame | None = None) -> DataFrame:
    """The administrative record that goes with each project record."""
    auto = _auto({"project_identifier_link": F.col("project_identifier")} | _audit(run_ts))
    return _with_defaults(projects, registry, "project_administrative_schema", "_defaults").select(
        "project_key", F.lit("project_administrative").alias("metadata_type"), "project_identifier",
        _fill_members(F.col("_defaults"), auto).alias("body"))


def project_admin_for(datasets: DataFrame, projects: DataFrame, admins: DataFrame) -> DataFrame:
    """Adds ``admin``: the administrative body of the first project folder with the dataset's project id.

    Adds ``admin_inherited`` too: what datasets inherit of it, taken once per project.
    """
    first = projects.where("project_identifier IS NOT NULL").groupBy("project_identifier").agg(
        F.min("project_key").alias("_folder"))
    bodies = admins.select(F.col("project_key").alias("_folder"), F.col("body").alias("admin"),
                           inherited(F.col("body")).alias("admin_inherited"))
    known = first.join(bodies, "_folder", "left").drop("_folder")
    return datasets.join(known.withColumnRenamed("project_identifier", "project_id"), "project_id", "left")


def inherited(admin: Column) -> Column:
    """Dataset fields that a project's administrative record fills; nulls fill nothing."""
    names = F.create_map(*[F.lit(x) for kv in C.INHERITED_FIELDS.items() for x in kv])
    given = F.map_filter(V.members(admin), lambda k, v: k.isin(*C.INHERITED_FIELDS) & ~F.is_variant_null(v))
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.transform_keys(given, lambda k, _: F.element_at(names, k)), none)


def init_datasets(datasets: DataFrame, run_ts: str, registry: DataFrame | None = None) -> DataFrame:
    """Administrative and structural records sharing one id; expects ``project_id`` and ``admin`` (or NULL).

    ``admin_inherited`` spares the reading of ``admin`` for every dataset. A body is made after the explode, so that a
    filter by ``metadata_type`` spares the other one.
    """
    base = datasets.withColumn("dataset_id", mint_id("project_key", "dataset_key"))
    base = _with_defaults(base, registry, "dataset_administrative_schema", "_admin_defaults")
    base = _with_defaults(base, registry, "dataset_structural_schema", "_struct_defaults")
    none = F.create_map().cast("map<string,variant>")
    taken = F.coalesce("admin_inherited", none) if "admin_inherited" in datasets.columns else inherited(F.col("admin"))
    admin_auto = F.map_concat(_auto({"dataset_identifier_link": F.col("dataset_id")} | _audit(run_ts)), taken)
    struct_auto = _auto({
        "dataset_identifier": F.col("dataset_id"), "dataset_title": P.strip_prefix("dataset_key", C.DATASET_PREFIX),
        "associated_project_identifier": F.col("project_id")} | _audit(run_ts))
    body = F.when(F.col("metadata_type") == "dataset_administrative", _fill_members(F.col("_admin_defaults"), admin_auto)).otherwise(
        _fill_members(F.col("_struct_defaults"), struct_auto))
    types = F.array(F.lit("dataset_administrative"), F.lit("dataset_structural"))
    return base.withColumn("metadata_type", F.explode(types)).select(
        "project_key", "dataset_key", "dataset_id", "metadata_type", body.alias("body"))


def inherit_defaults(records: DataFrame, admin: str = "admin") -> DataFrame:
    """Lays a project's defaults over administrative dataset records, where the record has the field."""
    return records.withColumn("body", fill(F.col("body"), inherited(F.col(admin))))


def init_contextual(datasets: DataFrame, run_ts: str, registry: DataFrame | None = None) -> DataFrame:
    """A contextual record per dataset for its ``template`` (unknown or NULL: the base schema).

    A schema's own template name wins over the wanted one. Expects ``experiment_id``
    (NULL: minted) and ``dataset_link`` (NULL or '': none known).
    """
    defaults = default_records(_registry_of(datasets, registry))
    roots = ["data_root"] if registry is not None and "data_root" in datasets.columns else []
    shape = F.struct("schema_id", "defaults", "template_const")
    own = defaults.select(*roots, F.col("schema_id").alias("_own"), shape.alias("_s1"))
    base = defaults.where(F.col("schema_id") == BASE_CONTEXTUAL).select(*roots, shape.alias("_s2"))
    joined = datasets.withColumn("_own", F.concat(F.lit("contextual/"), "template")).join(own, [*roots, "_own"], "left")
    joined = joined.join(base, roots, "left") if roots else joined.withColumn("_s2", base.scalar())
    joined = joined.withColumn("_s", F.coalesce("_s1", "_s2"))
    experiment = F.coalesce("experiment_id", mint_id("project_key", "dataset_key", F.lit("experiment")))
    names = F.map_keys(V.members("_s.defaults"))
    run_field = (
        F.when(F.array_contains(names, "experiment_identifier_run_id"), "experiment_identifier_run_id")
        .when(F.array_contains(names, "experiment_identifier_object_id"), "experiment_identifier_object_id").otherwise(""))
    auto = F.map_concat(
        _auto({"experiment_template_type": F.coalesce("_s.template_const", "template", F.lit("unknown_template"))} | _audit(run_ts)),
        F.create_map(run_field, experiment.cast("variant")))
    body = with_members(fill(F.col("_s.defaults"), auto), {
        "experiment_name": F.when(~F.array_contains(names, "experiment_name"), F.lit("").cast("variant")),
        "dataset_identifier_link": F.when(F.col("dataset_link") != "", F.col("dataset_link").cast("variant"))})
    return joined.select("project_key", "dataset_key", F.col("_s.schema_id").alias("schema_id"), body.alias("body"))


def linked_body(body: Column, identifier: Column) -> Column:
    """A contextual body whose empty dataset link is set to the identifier, if that is not empty."""
    missing = ~truthy(V.field(body, "dataset_identifier_link")) | V.field(body, "dataset_identifier_link").isNull()
    return with_members(body, {"dataset_identifier_link": F.when(missing & truthy(identifier), identifier)})


def fill_dataset_link(contextual: DataFrame, structural: DataFrame, key: tuple[str, ...] = ("dataset_key",)) -> DataFrame:
    """Sets an empty dataset link of contextual records to the id in the structural record, if that has one."""
    ids = structural.select(*key, V.field("body", "dataset_identifier").alias("_id"))
    return contextual.join(ids, list(key), "left").withColumn("body", linked_body(F.col("body"), F.col("_id"))).drop("_id")
