"""Layered schema registries as tables.

A registry has one row per schema and layer: ``data_root``, ``schema_id``, ``source``,
``priority`` (0 wins), ``title``, ``description`` and the schema text in ``body``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlake import constants as C
from fairlake import schemas as S
from fairlake.functions import paths as P
from fairlake.functions import variants as V

# Layers from strongest to weakest.
LAYERS = ["explicit", "local", "custom", "packaged"]
BASE_CONTEXTUAL = "experiment_contextual_schema"


def layer_priority(source) -> Column:
    s = F.col(source) if isinstance(source, str) else source
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), s).cast("int") - 1


def packaged_registry(spark: SparkSession) -> DataFrame:
    """The built-in schemas as a registry with one layer."""
    rows = [(S.SCHEMA_FILES[k], k, S.BY_TYPE["project_descriptive" if k == "project" else k]) for k in S.SCHEMA_FILES]
    rows += [(f"contextual/{k}", k, v) for k, v in S.BY_TEMPLATE.items()]
    values, args = [], {}
    for i, (sid, kind, body) in enumerate(rows):
        args |= {f"s{i}": sid, f"t{i}": kind.replace("_", " ").title(), f"b{i}": json.dumps(body)}
        values.append(f"('', :s{i}, 'packaged', {LAYERS.index('packaged')}, :t{i}, CAST(NULL AS STRING), :b{i})")
    names = "data_root, schema_id, source, priority, title, description, body"
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS r({names})", args)


def resolve_schemas(registry: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """The winning layer of every schema of every data root, for all roots in one job."""
    rest = [c for c in registry.columns if c not in ("data_root", "schema_id")]
    first = F.min_by(F.struct(*rest), F.struct("priority", *tie)).alias("_s")
    return registry.groupBy("data_root", "schema_id").agg(first).select(
        "data_root", "schema_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def schema_report(registry: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Which layers each schema has, and which one won."""
    return registry.groupBy("data_root", "schema_id").agg(
        *[F.bool_or(F.col("source") == s).alias(f"has_{s}") for s in LAYERS],
        F.min_by("source", F.struct("priority", *tie)).alias("resolution_source"))


def contextual_schemas(registry: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Contextual templates; a stronger layer replaces the whole entry of a weaker one."""
    found = registry.where(F.col("schema_id").startswith("contextual/"))
    name = F.substring_index("schema_id", "/", -1)
    return resolve_schemas(found, tie).select(
        "data_root", name.alias("schema_id"), F.coalesce("title", name).alias("schema_title"),
        F.col("description").alias("schema_description"), "source")


def get_schema(registry: DataFrame, schema_type: str, schema_id: str | None = None) -> DataFrame:
    """Registry rows of a schema type; an unknown type is an error."""
    if schema_type == "contextual":
        wanted = f"contextual/{schema_id}"
    elif schema_type in S.SCHEMA_FILES:
        wanted = S.SCHEMA_FILES[schema_type]
    else:
        raise ValueError(f"unknown schema type: {schema_type}")
    return registry.where(F.col("schema_id") == wanted)


def _texts(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<string>")


def _json_items(value: Column) -> Column:
    return F.transform(V.items(value), lambda x: F.to_json(x))


def _members_beside(value: Column, *known: str) -> Column:
    """How many members an object has beside the known ones."""
    names = F.map_keys(V.members(value))
    return F.coalesce(F.size(F.array_except(names, F.array(*[F.lit(k) for k in known]))), F.lit(0))


def _cases(node: Column) -> Column:
    """The if/then rules of a node, its own one and those in ``allOf``, with the number of members that no rule here may have."""
    listed = F.transform(V.items(V.field(node, "allOf")), lambda rule: F.struct(
        V.field(rule, "if").alias("test"), V.field(rule, "then").alias("then"),
        _members_beside(rule, "if", "then", "title", "description", "$comment").alias("beside")))
    own = F.array(F.struct(V.field(node, "if").alias("test"), V.field(node, "then").alias("then"),
                           V.field(node, "else").isNotNull().cast("int").alias("beside")))
    own = F.filter(own, lambda c: c["test"].isNotNull() | (c["beside"] > 0))
    return F.concat(F.coalesce(listed, F.array().cast("array<struct<test:variant,then:variant,beside:int>>")), own)


def _conditions(node: Column) -> Column:
    """If/then rules as array<struct<tests, required>>; allowed values as JSON text."""
    def tests(test: Column) -> Column:
        return F.transform(F.map_entries(V.members(V.field(test, "properties"))), lambda e: F.struct(
            e["key"].alias("field"),
            F.coalesce(_json_items(V.field(e["value"], "enum")), F.array(F.to_json(V.field(e["value"], "const")))).alias("allowed")))

    return F.transform(_cases(node), lambda c: F.struct(
        tests(c["test"]).alias("tests"), _texts(V.field(c["then"], "required")).alias("required")))


def _unsupported_conditions(node: Column) -> Column:
    """How many parts of if/then rules are not checked: other tests than of values, other demands than of members, ``else``."""
    def parts(c: Column) -> Column:
        asked = F.coalesce(F.map_values(V.members(V.field(c["test"], "properties"))), F.array().cast("array<variant>"))
        odd = F.aggregate(asked, F.lit(0), lambda n, v: n + _members_beside(v, "enum", "const", "title", "description"))
        return c["beside"] + odd + _members_beside(c["test"], "properties") + _members_beside(c["then"], "required")

    return F.aggregate(F.transform(_cases(node), parts), F.lit(0), lambda n, x: n + x)


#: Nesting of the packaged schemas; other registries are measured.
DEPTH = 4

# Keywords of JSON Schema that constrain values and are not supported here.
UNSUPPORTED = ["$ref", "anyOf", "oneOf", "not", "dependencies", "dependentRequired", "dependentSchemas", "patternProperties",
               "propertyNames", "multipleOf", "uniqueItems", "contains", "exclusiveMinimum", "exclusiveMaximum", "minProperties",
               "maxProperties", "prefixItems", "additionalItems", "unevaluatedProperties", "unevaluatedItems"]


def _nesting(node: object) -> int:
    """Levels of properties and items below a schema node."""
    if not isinstance(node, dict):
        return 0
    properties = node.get("properties")
    below = [*(properties.values() if isinstance(properties, dict) else []), *([node["items"]] if node.get("items") is not None else [])]
    return max((1 + _nesting(b) for b in below), default=0)


def schema_depth(registry: DataFrame) -> int:
    """How deep the schemas of a registry nest. A registry is a small table, read here before the query's own job."""
    @F.pandas_udf(T.IntegerType())
    def depth(bodies: pd.Series) -> pd.Series:
        def one(text: str | None) -> int:
            try:
                return _nesting(json.loads(text or "null"))
            except ValueError:
                return 0

        return bodies.map(one).astype("int32")

    return registry.agg(F.max(depth(F.col("body").cast("string")))).first()[0] or 0


def escaped(name: Column) -> Column:
    """A member's name as one step of a rule path: dots in it are no separators, and ``[]`` is not the items."""
    plain = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))
    return F.when(name == "[]", F.lit("\\[]")).otherwise(plain)


def unescaped(path: Column) -> Column:
    return F.regexp_replace(path, r"\\(.)", "$1")


def schema_fields(registry: DataFrame, depth: int | None = None, whole: bool = True) -> DataFrame:
    """One row per field of every schema, nested ones with a dotted path.

    Array items appear as ``[]`` in ``rule_path``; ``field_path`` leaves them out. The row
    with the empty path is the schema itself. ``depth`` ends the walk earlier; without it
    the walk is as deep as the schemas.
    """
    depth = schema_depth(registry) if depth is None else depth
    keys = ["data_root", "schema_id"]
    none = F.array().cast("array<struct<rule_path:string,name:string,required:boolean,node:variant>>")

    def child(path: Column, name: Column, required: Column, node: Column) -> Column:
        return F.struct(path.alias("rule_path"), name.alias("name"), required.alias("required"), node.alias("node"))

    def below(n: Column) -> Column:
        prefix = F.when(n["rule_path"] == "", "").otherwise(F.concat(n["rule_path"], F.lit(".")))
        needed = F.coalesce(_texts(V.field(n["node"], "required")), F.array().cast("array<string>"))
        members = F.transform(F.map_entries(V.members(V.field(n["node"], "properties"))), lambda e: child(
            F.concat(prefix, escaped(e["key"])), e["key"], F.array_contains(needed, e["key"]), e["value"]))
        items = F.filter(F.array(child(F.concat(prefix, F.lit("[]")), F.lit("[]"), F.lit(False), V.field(n["node"], "items"))),
                         lambda c: c["node"].isNotNull())
        return F.concat(F.coalesce(members, none), items)

    root = child(F.lit(""), F.lit(""), F.lit(False), F.col("_schema"))
    df = registry.select(*keys, V.parse_strict("body").alias("_schema")).where("_schema IS NOT NULL").select(
        *keys, F.array(root).alias("_level0"))
    for i in range(depth):
        df = df.withColumn(f"_level{i + 1}", F.flatten(F.transform(f"_level{i}", below)))
    levels = F.concat(*[f"_level{i}" for i in range(depth + 1)])
    fields = df.select(*keys, F.explode(levels).alias("_n")).select(*keys, "_n.*")

    def number(name: str) -> Column:
        return F.try_variant_get("node", f"$.{name}", "double")

    def size(name: str) -> Column:
        return F.try_variant_get("node", f"$.{name}", "int")

    path = F.regexp_replace(F.regexp_replace("rule_path", r"(^|\.)\[\]", ""), r"^\.", "")
    parent = F.when(path.rlike(r"(?<!\\)\."), F.regexp_replace(path, r"(?<!\\)\.(?:[^.\\]|\\.)*$", "")).otherwise(F.lit(""))
    return fields.select(
        *keys, "rule_path", unescaped(path).alias("field_path"), "name", unescaped(parent).alias("parent"),
        F.coalesce(V.text("node", "title"), P.humanize("name")).alias("title"),
        V.text("node", "description").alias("description"), "required",
        F.coalesce(F.try_variant_get("node", "$.readOnly", "boolean"), F.lit(False)).alias("read_only"),
        F.struct(
            V.text("node", "type").alias("type"),
            F.coalesce(_texts(V.field("node", "type")), F.array(V.text("node", "type"))).alias("types"), _json_items(V.field("node", "enum")).alias("enum"),
            F.to_json(V.field("node", "const")).alias("const"), V.text("node", "pattern").alias("pattern"),
            V.text("node", "format").alias("format"), number("minimum").alias("minimum"), number("maximum").alias("maximum"),
            size("minItems").alias("min_items"), size("maxItems").alias("max_items"),
            size("minLength").alias("min_length"), size("maxLength").alias("max_length"),
            _texts(V.field("node", "required")).alias("required"),
            V.field("node", "properties").isNotNull().alias("has_properties"),
            F.map_keys(V.members(V.field("node", "properties"))).alias("names"),
            F.coalesce(F.to_json(V.field("node", "additionalProperties")) == "false", F.lit(False)).alias("closed"),
            (F.coalesce(F.size(F.array_intersect(F.map_keys(V.members("node")), F.array(*[F.lit(k) for k in UNSUPPORTED]))), F.lit(0))
             + _unsupported_conditions(F.col("node")) + V.items(V.field("node", "items")).isNotNull().cast("int")).alias("unsupported"),
            _conditions(F.col("node")).alias("conditions")).alias("rule"))


def schema_rules(registry: DataFrame, depth: int | None = None, whole: bool = True) -> DataFrame:
    """One row per schema: ``rules``, a map from rule path to the constraints there."""
    entry = F.struct(F.col("rule_path").alias("key"), F.col("rule").alias("value"))
    return schema_fields(registry, depth, whole).groupBy("data_root", "schema_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("rules"))


def field_catalog(registry: DataFrame, metadata_types: dict[str, str] | None = None) -> DataFrame:
    """Top-level fields with protected identifiers marked read-only."""
    types = metadata_types or {v: k for k, v in S.SCHEMA_FILES.items()} | {"project_descriptive": "project_descriptive"}
    protected = [f"{sid}:{name}" for sid, kind in types.items() for name in C.PROTECTED_FIELDS.get(kind, [])]
    protected += [f"contextual:{name}" for name in C.PROTECTED_FIELDS["experiment_contextual"]]
    owner = F.when(F.col("schema_id").startswith("contextual/"), "contextual").otherwise(F.col("schema_id"))
    top = schema_fields(registry, 1, whole=False).where("rule_path NOT IN ('', '[]')")
    return top.withColumn("read_only", F.col("read_only") | F.concat_ws(":", owner, "name").isin(protected)).drop("rule")


def describe_fields(registry: DataFrame, depth: int | None = None) -> DataFrame:
    """Title, description and required flag by dotted path; only top-level names can be required."""
    fields = schema_fields(registry, depth).where("name NOT IN ('', '[]')")
    root = schema_fields(registry, 0, whole=False).select("data_root", "schema_id", F.coalesce(
        F.col("rule.required"), F.array().cast("array<string>")).alias("_required"))
    return fields.join(root, ["data_root", "schema_id"]).select(
        "data_root", "schema_id", "field_path", "title", "description",
        F.array_contains("_required", F.col("name")).alias("required"))


def schema_id_of(metadata_type="metadata_type") -> Column:
    """Registry id of a metadata type."""
    files = S.SCHEMA_FILES | {"project_descriptive": "project_descriptive"}
    table = F.create_map(*[F.lit(x) for kv in files.items() for x in kv])
    return F.try_element_at(table, F.col(metadata_type))


def effective(registry: DataFrame, by_root: bool) -> DataFrame:
    """The winning layer of every schema: per data root, or over all roots, of which the first wins at a tie."""
    if by_root:
        return resolve_schemas(registry)
    rest = [c for c in registry.columns if c != "schema_id"]
    first = F.min_by(F.struct(*rest), F.struct("priority", "data_root")).alias("_s")
    return registry.groupBy("schema_id").agg(first).select("schema_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def with_rules(records: DataFrame, registry: DataFrame | None, top_only: bool = False) -> tuple[DataFrame, int]:
    """Records with ``schema_id`` and the ``rules`` of their schema, and how deep those nest.

    Layers are resolved first. Records with a ``data_root`` follow the schemas of their root;
    without a registry the packaged schemas hold for all roots.
    """
    by_root = registry is not None and "data_root" in records.columns
    schemas = packaged_registry(records.sparkSession) if registry is None else effective(registry, by_root)
    depth = 1 if top_only else DEPTH if registry is None else schema_depth(registry)
    return dispatch(records, schema_rules(schemas, depth), ["rules"], "data_root" if by_root else None), depth


def dispatch(records: DataFrame, schemas: DataFrame, columns: list[str], tie_root: str | None = None) -> DataFrame:
    """Adds ``schema_id`` and ``columns`` of the schema that applies to each record.

    Contextual records follow their template when the registry has it, else the base schema;
    rows of a type without schema keep NULLs. The registry holds one row per schema, so it
    is small beside the records; Spark broadcasts it when its size allows that.
    """
    template = V.text("body", "experiment_template_type")
    contextual = F.col("metadata_type") == "experiment_contextual"
    keyed = records.withColumn("_base", schema_id_of()).withColumn(
        "_own", F.when(contextual & template.isNotNull(), F.concat(F.lit("contextual/"), template)).otherwise(F.col("_base")))
    on = [tie_root] if tie_root else []
    pick = [F.col(c) for c in on]
    own = schemas.select(*pick, F.col("schema_id").alias("_own"), F.struct("schema_id", *columns).alias("_s1"))
    base = schemas.select(*pick, F.col("schema_id").alias("_base"), F.struct("schema_id", *columns).alias("_s2"))
    joined = keyed.join(own, [*on, "_own"], "left").join(base, [*on, "_base"], "left")
    chosen = F.coalesce("_s1", "_s2")
    return joined.withColumn("_s", chosen).select(
        *records.columns, F.col("_s.schema_id").alias("schema_id"), *[F.col(f"_s.{c}").alias(c) for c in columns])
