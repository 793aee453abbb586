"""Semi-structured record bodies: strict parsing, value kinds and 'filled' rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlake.constants import PLACEHOLDER


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_strict(raw) -> Column:
    """VARIANT of a JSON text, NULL when it is not exactly one JSON value.

    Spark's parser stops after the first value, so text such as ``{}}`` would pass.
    The value is parsed together with a marker that has to follow it; the marker
    depends on the text, so that no text can carry its own.
    """
    r = _col(raw)
    mark = F.xxhash64(r)
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), r, F.lit(',"m":'), mark.cast("string"), F.lit("}")))
    return F.when(
        F.try_variant_get(wrapped, "$.m", "bigint") == mark,
        F.try_variant_get(wrapped, "$.v", "variant"))


def field(body, name: str) -> Column:
    """Member of an object as VARIANT; SQL NULL when absent (a JSON null is not)."""
    return F.try_variant_get(_col(body), "$['" + name.replace("'", "\\'") + "']", "variant")


def text(body, name: str) -> Column:
    """Member as string; NULL when absent, JSON null or a container."""
    v = field(body, name)
    return F.when(~is_container(v), v.cast("string"))


def members(body) -> Column:
    """map<string,variant> of an object's members, NULL for anything else."""
    return F.try_variant_get(_col(body), "$", "map<string,variant>")


def items(body) -> Column:
    """array<variant> of an array's items, NULL for anything else."""
    return F.try_variant_get(_col(body), "$", "array<variant>")


_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def kind_of_json(text: Column) -> Column:
    """Kind of a JSON text, told by its first character."""
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.left(text, F.lit(1))), F.when(text.isNotNull(), "number"))


# Types that tell the kind. Writing a value as JSON makes a generator for each of its strings, so only the
# others are written: doubles, which are strings when not finite, and types that JSON lacks.
_TYPES = {"OBJ": "object", "ARR": "array", "STR": "string", "BOO": "boolean", "VOI": "null", "BIG": "number", "DEC": "number"}


def kind(value) -> Column:
    """JSON kind: object, array, string, number, boolean or null; NULL when absent."""
    names = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    v = _col(value)
    return F.coalesce(F.try_element_at(names, F.left(F.schema_of_variant(v), F.lit(3))), kind_of_json(F.to_json(v)))


def is_container_json(text: Column) -> Column:
    return F.left(text, F.lit(1)).isin("{", "[")


def is_container(value) -> Column:
    return F.left(F.schema_of_variant(_col(value)), F.lit(3)).isin("OBJ", "ARR")


def is_blank(text: Column) -> Column:
    """Only white space, of Unicode too, or nothing."""
    return text.rlike(r"^[\s\x1c-\x1f\x85\p{Z}]*$")


# Fixed value: a JSON number that is zero.
ZERO = r"-?0(?:\.0*)?(?:[eE][+-]?[0-9]+)?"


def scores_as_filled(value) -> Column:
    """Score rule for scalars: truthy and not the placeholder."""
    return json_scores_as_filled(F.to_json(_col(value)))


def json_scores_as_filled(j: Column) -> Column:
    empty = j.isin("null", "false", '""', f'"{PLACEHOLDER}"') | j.rlike(f"^{ZERO}$")
    return F.coalesce(~empty, F.lit(False))


def scalar_marks(body) -> Column:
    """The shape of a value: its JSON text with ``s`` for each filled scalar and ``e`` for each other one, at any depth.

    Names are marked too. An escaped quote never stands before an opening quote, so the first
    pattern finds whole empty and placeholder strings only.
    """
    shape = F.regexp_replace(F.to_json(_col(body)), rf'(?<!\\)"(?:{PLACEHOLDER})?"', "e")
    shape = F.regexp_replace(shape, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "s")
    shape = F.regexp_replace(shape, rf"(?<=[\[,:])(?:{ZERO}|false|null)(?=[,\]}}])", "e")
    return F.regexp_replace(shape, r"(?<=[\[,:])(?:true|-?[0-9][0-9.eE+-]*)(?=[,\]}])", "s")


def passes_gate(value) -> Column:
    """Gate rule: present, not null, and not a blank or placeholder string."""
    v = _col(value)
    s = v.cast("string")
    open_text = (kind(v) == "string") & (is_blank(s) | (s == PLACEHOLDER))
    return v.isNotNull() & ~F.is_variant_null(v) & ~open_text


def form_complete(value, trim: bool = False) -> Column:
    """Form rule: not null, '', [], {} or the placeholder; 0 and false are complete."""
    j = F.to_json(_col(value))
    empty = j.isin("null", '""', "[]", "{}")
    mark = j.rlike(rf'^"\s*{PLACEHOLDER}\s*"$') if trim else j == f'"{PLACEHOLDER}"'
    return F.coalesce(~(empty | mark), F.lit(False))
