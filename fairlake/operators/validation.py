"""Validation, form rules and normalisation of records against registry schemas.

Records are spread into their nodes (path, kind, value) inside the row, and each node is
checked against the rules that its schema holds for that path. The expression is the same
for every schema, and a table is validated in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake.functions import variants as V
from fairlake.operators.registry import escaped, with_rules

RECORD_RULES = ("type", "required", "enum", "const", "pattern", "length", "range", "items", "conditional", "additional", "schema")
FORM_RULES = ("type", "required", "enum", "format", "length", "range", "items")

# Text formats that forms check.
FORM_FORMATS = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?Z$",
    "email": r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$",
}

_NAMES = "array<string>"
#: How deep objects with properties nest in the packaged schemas.
PACKAGED_OBJECTS = 2


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _node(path: Column, rule_path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), rule_path.alias("rule_path"), V.kind(value).alias("kind"),
                    F.map_keys(V.members(value)).alias("names"), value.alias("value"),
                    F.try_element_at("rules", rule_path).alias("rule"))


def _dot(prefix: Column, part: Column) -> Column:
    return F.when(prefix == "", part).otherwise(F.concat(prefix, F.lit("."), part))


def _children(level: Column) -> Column:
    def below(n: Column) -> Column:
        members = F.transform(F.map_entries(V.members(n["value"])), lambda e: _node(
            _dot(n["path"], e["key"]), _dot(n["rule_path"], escaped(e["key"])), e["value"]))
        items = F.transform(V.items(n["value"]), lambda x, i: _node(
            _dot(n["path"], i.cast("string")), _dot(n["rule_path"], F.lit("[]")), x))
        return F.coalesce(members, items, F.filter(F.array(n), lambda _: F.lit(False)))

    return F.flatten(F.transform(level, below))


def _checks(n: Column, r: Column, rules: tuple[str, ...], form: bool) -> Column:
    """array of (rule, member name or NULL, message) of one node; NULL entries are no violations."""
    kind, value = n["kind"], n["value"]
    text = F.when(kind == "string", value.cast("string"))
    number = F.when(kind == "number", F.try_variant_get(value, "$", "double"))
    whole = F.coalesce(number == F.floor(number), F.lit(False))
    typed = F.exists(r["types"], lambda t: F.when(t == "integer", whole).otherwise(kind == t))
    listed = F.array_contains(r["enum"], F.to_json(value))
    size = F.size(V.items(value))
    have = n["names"]
    bad = {
        "type": [(~typed, "has the wrong type")],
        "enum": [(~listed & typed if form else ~listed, "is not one of the listed values")],
        "const": [(r["const"] != F.to_json(value), "differs from the fixed value")],
        "pattern": [(~F.rlike(text, r["pattern"]), "does not match the pattern")],
        "range": [(number < r["minimum"], "is below the minimum"), (number > r["maximum"], "is above the maximum")],
        "items": [(size < r["min_items"], "has too few items"), (size > r["max_items"], "has too many items")],
        "schema": [(r["unsupported"] > 0, "has a schema with keywords that are not supported")],
        "length": [(F.length(text) < r["min_length"], "is too short"), (F.length(text) > r["max_length"], "is too long")],
    }
    wrong_format = F.lit(None).cast("boolean")
    for name, pattern in FORM_FORMATS.items():
        fails = ~text.rlike(pattern)
        if name != "email":
            fails = fails | F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd").isNull()
        wrong_format = F.when((r["format"] == name) & r["enum"].isNull() & text.isNotNull(), fails).otherwise(wrong_format)
    bad["format"] = [(wrong_format, "has the wrong format")]
    none = F.lit(None).cast("string")

    def one(rule: str, member: Column, message: str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), member.alias("member"), F.lit(message).alias("message"))

    simple = [F.when(test, one(rule, none, message)) for rule in rules for test, message in bad.get(rule, [])]
    parts = [F.array(*simple)]
    if "required" in rules:
        missing = F.array_except(F.when(kind == "object", r["required"]), have)
        parts.append(F.transform(missing, lambda m: one("required", m, "is required")))
    if "additional" in rules:
        extra = F.array_except(F.when((kind == "object") & r["closed"], have), F.coalesce(r["names"], _empty(_NAMES)))
        parts.append(F.transform(extra, lambda m: one("additional", m, "is not allowed here")))
    if "conditional" in rules:
        def applies(c: Column) -> Column:
            return F.forall(c["tests"], lambda t: ~F.array_contains(have, t["field"]) | F.coalesce(
                F.array_contains(t["allowed"], F.to_json(F.try_element_at(V.members(value), t["field"]))), F.lit(False)))

        active = F.filter(F.when(kind == "object", r["conditions"]), applies)
        lacking = F.flatten(F.transform(active, lambda c: F.array_except(c["required"], have)))
        parts.append(F.transform(lacking, lambda m: one("conditional", m, "is required by another field")))
    return F.concat(*[F.coalesce(p, _empty("array<struct<rule:string,member:string,message:string>>")) for p in parts])


def violations(records: DataFrame, rules: tuple[str, ...] = RECORD_RULES, depth: int = 1, form: bool = False) -> DataFrame:
    """Adds ``violations``; expects ``body`` and the ``rules`` map of the record's schema.

    ``depth`` is the nesting of the schemas, as in ``schema_fields``; values below it have no rules.
    """
    # The marker column keeps every level in a projection of its own, so no level is computed twice.
    df = records.withColumn("_level0", F.array(_node(F.lit(""), F.lit(""), F.col("body"))))
    for i in range(depth):
        known = F.filter(_children(F.col(f"_level{i}")), lambda n: n["rule"].isNotNull())
        df = df.withColumn(f"_level{i + 1}", known)
    levels = [f"_level{i}" for i in range(depth + 1)]
    df = df.withColumn("_nodes", F.concat(*levels)).drop(*levels)

    def of_node(n: Column) -> Column:
        found = F.array_compact(_checks(n, n["rule"], rules, form))
        return F.transform(found, lambda c: F.struct(
            F.when(c["member"].isNull(), n["path"]).otherwise(_dot(n["path"], c["member"])).alias("field_path"),
            c["rule"].alias("rule"), c["message"].alias("message")))

    found = F.flatten(F.transform("_nodes", of_node))
    return df.withColumn("violations", F.coalesce(found, _empty(
        "array<struct<field_path:string,rule:string,message:string>>"))).drop("_nodes")


def validate(records: DataFrame, registry: DataFrame | None = None, strict: bool = False,
             rules: tuple[str, ...] = RECORD_RULES, form: bool = False) -> DataFrame:
    """Adds ``schema_id``, ``violations`` and ``valid``; records of a type without a schema are valid.

    ``strict`` fails the job at an invalid record.
    """
    matched, depth = with_rules(records, registry)
    out = violations(matched, rules, depth, form).drop("rules").withColumn("valid", F.size("violations") == 0)
    if strict:
        out = out.withColumn("valid", F.when(F.col("valid"), True).otherwise(
            F.raise_error(F.concat(F.lit("invalid record "), F.col("record_key"))).cast("boolean")))
    return out


def validate_form(records: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Like ``validate`` with the rules of the editing form: formats are checked, patterns are not."""
    return validate(records, registry, rules=FORM_RULES, form=True)


def violation_rows(validated: DataFrame, keys: tuple[str, ...] = ("record_key", "metadata_type")) -> DataFrame:
    """One row per violation.

    Spark filters the input of a plain explode by the size of the array, and pushes that filter below the records' joins
    with every level of the validation copied into it; an outer explode is filtered afterwards.
    """
    return validated.select(*keys, F.explode_outer("violations").alias("v")).where("v IS NOT NULL").select(*keys, "v.*")


def group_errors(validated: DataFrame) -> DataFrame:
    """Adds ``errors``: map of field path to its messages."""
    paths = F.array_distinct(F.transform("violations", lambda x: x["field_path"]))
    grouped = F.transform(paths, lambda p: F.struct(p.alias("key"), F.transform(
        F.filter("violations", lambda x: x["field_path"] == p), lambda x: x["message"]).alias("value")))
    return validated.withColumn("errors", F.map_from_entries(grouped))


def error_rows(grouped: DataFrame, keys: tuple[str, ...] = ("record_key",)) -> DataFrame:
    """One row per field path of ``errors`` with its ``messages``; an outer explode as in ``violation_rows``."""
    return grouped.select(*keys, F.explode_outer("errors").alias("field_path", "messages")).where("field_path IS NOT NULL")


def _leading_number(text: Column, integer: Column) -> Column:
    digits = F.regexp_extract(text, r"^\s*([-+]?\d+)", 1)
    whole = F.coalesce(digits.try_cast("bigint").cast("variant"), digits.try_cast("decimal(38,0)").cast("variant"),
                       digits.try_cast("double").cast("variant"))
    decimal = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    return F.when(integer, whole).otherwise(decimal.cast("variant"))


def _blank(value: Column) -> Column:
    return F.is_variant_null(value) | (value.cast("string") == "")


def _unless_empty(value: Column) -> Column:
    """The object or array, or NULL when it is {} or []; refers to the (large) expression only once."""
    return F.get(F.filter(F.array(value), lambda x: F.greatest(F.size(V.members(x)), F.size(V.items(x))) > 0), F.lit(0))


def _array_unless_empty(items: Column) -> Column:
    """The items as VARIANT, or NULL when there are none."""
    return F.get(F.transform(F.filter(F.array(items), lambda x: F.size(x) > 0), lambda x: x.cast("variant")), F.lit(0))


def _normal_object(value: Column, at: Column, depth: int) -> Column:
    """New object VARIANT with the members at rule path ``at`` rewritten."""
    required = F.coalesce(F.try_element_at("rules", at)["required"], _empty(_NAMES))

    def with_rule(e: Column) -> Column:
        path = _dot(at, escaped(e["key"]))
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), path.alias("path"),
                        V.kind(e["value"]).alias("kind"), F.try_element_at("rules", path).alias("rule"))

    def entry(e: Column) -> Column:
        new = _normal_value(e, F.array_contains(required, e["key"]), depth)
        return F.struct(e["key"].alias("key"), F.when(e["rule"].isNotNull(), new).otherwise(e["value"]).alias("value"))

    entries = F.transform(F.transform(F.map_entries(V.members(value)), with_rule), entry)
    return F.to_variant_object(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def _normal_value(entry: Column, required: Column, depth: int) -> Column:
    """New VARIANT of a member, or NULL where the member is dropped."""
    value, path, kind = entry["value"], entry["path"], entry["kind"]
    wanted, text = entry["rule"]["type"], value.cast("string")
    drop = F.lit(None).cast("variant")
    empty = (kind == "string") & (text == "")
    lowered = F.lower(text)
    single = F.when(~_blank(value), F.array(value).cast("variant"))
    items = _normal_items(V.items(value), _dot(path, F.lit("[]")), depth)
    shaped = entry["rule"]["has_properties"]
    child = F.when(shaped & (kind == "object"), _normal_object(value, path, depth - 1)).otherwise(value) if depth else value
    return (
        F.when(wanted.isNull(), value)
        .when(empty, F.when((wanted == "string") & required, value))
        .when(wanted.isin("number", "integer") & (kind == "null"), drop)
        .when(wanted.isin("number", "integer") & (kind == "string"), _leading_number(text, wanted == "integer"))
        .when((wanted == "boolean") & (kind == "string") & lowered.isin("true", "false"), (lowered == "true").cast("variant"))
        .when((wanted == "array") & (kind == "array"), _array_unless_empty(items))
        .when(wanted == "array", single)
        .when((wanted == "object") & kind.isin("object", "array"), _unless_empty(child))
        .otherwise(value)
    )


def _normal_items(items: Column, path: Column, depth: int) -> Column:
    wanted = F.try_element_at("rules", path)["type"]

    def rewrite(x: Column) -> Column:
        kind = V.kind(x)
        number = F.when(kind == "string", _leading_number(x.cast("string"), wanted == "integer")).otherwise(F.when(kind == "number", x))
        shaped = F.try_element_at("rules", path)["has_properties"]
        child = F.when(shaped, _normal_object(x, path, depth - 1)).otherwise(x) if depth else x
        return (
            F.when(_blank(x), F.lit(None).cast("variant"))
            .when(wanted.isin("number", "integer"), number)
            .when((wanted == "object") & (kind == "object"), _unless_empty(child))
            .when((wanted == "string") & (kind == "string") & V.is_blank(x.cast("string")), F.lit(None).cast("variant"))
            .otherwise(x)
        )

    return F.filter(F.transform(items, rewrite), lambda x: x.isNotNull())


def normalize(records: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Rewrites ``body`` so that form text fits the schema: numbers and booleans parsed, single
    values wrapped into arrays, empty optional values removed, as deep as the schemas nest."""
    matched, depth = with_rules(records, registry)
    depth = PACKAGED_OBJECTS if registry is None else depth
    new = F.when(F.col("rules").isNotNull(), _normal_object(F.col("body"), F.lit(""), depth))
    return matched.withColumn("body", F.coalesce(new, "body")).drop("rules")


def clean_enums(records: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Sets every truthy top-level value outside its field's list to ''."""
    matched, _ = with_rules(records, registry, top_only=True)

    def clean(name: Column, value: Column) -> Column:
        allowed = F.try_element_at("rules", escaped(name))["enum"]
        j = F.to_json(value)
        bad = ~F.array_contains(allowed, j) & ~j.isin("null", "false", "0", '""')
        return F.when(bad, F.lit("").cast("variant")).otherwise(value)

    cleaned = F.to_variant_object(F.transform_values(V.members("body"), clean))
    return matched.withColumn("body", F.when(F.col("rules").isNotNull(), cleaned).otherwise(F.col("body"))).drop("rules")
