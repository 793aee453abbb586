"""Path, name and identifier rules as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake.functions.variants import parse_strict


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_path(path) -> Column:
    p = _col(path)
    return F.regexp_replace(p, "/[^/]*$", "")


def is_ignored(path, is_file=None, mode: str = "substring") -> Column:
    """Hidden from the catalog. ``substring`` matches names anywhere in the path
    (so ``env`` hides ``environment``); ``component`` matches whole path parts."""
    p = _col(path)
    file_flag = F.lit(True) if is_file is None else _col(is_file)
    if mode == "substring":
        hidden = p.rlike(_any_of(C.IGNORED_SYSTEM_NAMES + C.IGNORED_TEMP_MARKS + [C.TEMPLATE_SCHEMA_DIR]))
    elif mode == "component":
        names = C.IGNORED_SYSTEM_NAMES + [C.TEMPLATE_SCHEMA_DIR]
        hidden = p.rlike(f"(^|/)({_any_of(names)})(/|$)") | base_name(p).rlike(
            f"({_any_of(C.IGNORED_TEMP_MARKS)})$")
    else:
        raise ValueError(f"unknown ignore mode: {mode}")
    own_record = (
        file_flag & p.contains(C.METADATA_DIR)
        & p.rlike(f"({_any_of(C.IGNORED_METADATA_SUFFIXES)})$")
    )
    return hidden | own_record


def in_metadata(path) -> Column:
    return _col(path).contains(C.METADATA_DIR)


def classify_dir(path) -> Column:
    """Role of a directory: hidden, project, dataset, orphan_dataset, legacy_dataset or other."""
    parts = F.split(_col(path), "/")
    name = F.element_at(parts, -1)
    parent = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    under_project = parent.startswith(C.PROJECT_PREFIX)
    return (
        F.when(name.startswith(".") | (name == "__pycache__"), "hidden")
        .when(name.startswith(C.PROJECT_PREFIX), "project")
        .when(name.startswith(C.DATASET_PREFIX), F.when(under_project, "dataset").otherwise("orphan_dataset"))
        .when(under_project, "legacy_dataset")
        .otherwise("other")
    )


def strip_prefix(name, prefix: str) -> Column:
    n = _col(name)
    return F.when(n.startswith(prefix), F.substr(n, F.lit(len(prefix) + 1))).otherwise(n)


def is_project(path) -> Column:
    return base_name(path).startswith(C.PROJECT_PREFIX)


def is_dataset(path) -> Column:
    """Any directory directly below a project."""
    return base_name(parent_path(path)).startswith(C.PROJECT_PREFIX)


def suffix(path) -> Column:
    """Last suffix with its dot, '' when there is none; a leading dot starts no suffix."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def extension(path) -> Column:
    return F.regexp_replace(suffix(path), r"^\.+", "")


def relative_path(path, dataset_path) -> Column:
    p, d = _col(path), _col(dataset_path)
    return F.when(p.startswith(F.concat(d, F.lit("/"))), p.substr(F.length(d) + 2, F.length(p))).otherwise(p)


def file_parts(path, dataset_path) -> Column:
    return F.struct(
        base_name(path).alias("file_name"),
        extension(path).alias("file_extension"),
        relative_path(path, dataset_path).alias("file_path"),
    )


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def mime_type(sfx, basic: bool = False) -> Column:
    if basic:
        return F.lit(C.DEFAULT_MIME_TYPE)
    return _lookup(C.MIME_TYPES, F.lower(_col(sfx)), C.DEFAULT_MIME_TYPE)


def compression(sfx, basic: bool = False) -> Column:
    if basic:
        return F.lit("none")
    return _lookup(C.COMPRESSIONS, F.lower(_col(sfx)), "none")


def mode_string(mode) -> Column:
    """``ls -l`` text of POSIX mode bits."""
    m = _col(mode)

    def bit(mask: int) -> Column:
        return m.bitwiseAND(F.lit(mask)) != 0

    kinds = {0o140000: "s", 0o120000: "l", 0o100000: "-", 0o060000: "b",
             0o040000: "d", 0o020000: "c", 0o010000: "p"}
    kind = F.lit("?")
    fmt = m.bitwiseAND(F.lit(0o170000))
    for value, char in kinds.items():
        kind = F.when(fmt == value, char).otherwise(kind)
    cells = [kind]
    for read, write, run, special, mark in (
        (0o400, 0o200, 0o100, 0o4000, "s"),
        (0o040, 0o020, 0o010, 0o2000, "s"),
        (0o004, 0o002, 0o001, 0o1000, "t"),
    ):
        cells += [
            F.when(bit(read), "r").otherwise("-"),
            F.when(bit(write), "w").otherwise("-"),
            F.when(bit(special) & bit(run), mark)
            .when(bit(special), mark.upper())
            .when(bit(run), "x")
            .otherwise("-"),
        ]
    return F.concat(*cells)


def format_size(size) -> Column:
    """Human size; each step drops the fraction, and TB is the largest unit."""
    s = _col(size).cast("bigint")
    out = F.concat((F.shiftright(s, 40)).cast("string"), F.lit(".0 TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        text = F.concat(F.shiftright(s, 10 * power).cast("string"), F.lit(f".0 {unit}"))
        out = F.when(s < 1024 ** (power + 1), text).otherwise(out)
    return F.when(s == 0, "0 B").otherwise(out)


def sanitize_filename(name) -> Column:
    cleaned = F.regexp_replace(_col(name), r'[<>:"/\\|?*]', "_")
    trimmed = F.regexp_replace(cleaned, r"^[ .]+|[ .]+$", "")
    return F.when(trimmed == "", "unnamed_file").otherwise(trimmed)


def upload_name(name) -> Column:
    """Every character that is not a letter, digit, '_', '-' or '.' becomes '_'."""
    return F.regexp_replace(_col(name), r"[^\p{L}\p{M}\p{N}_\-.]", "_")


def _has_traversal(v: Column) -> Column:
    return v.contains("..") | v.contains("/") | v.contains("\\")


def id_error(value) -> Column:
    """First failed identifier check, NULL when the identifier is fine."""
    v = _col(value)
    return (
        F.when(v.isNull() | (v == ""), "empty")
        .when(F.length(v) > C.MAX_ID_LENGTH, "too_long")
        .when(_has_traversal(v), "traversal")
        .when(~v.rlike(C.ID_PATTERN), "charset")
    )


def type_error(value, kind: str = "metadata") -> Column:
    allowed = {"metadata": C.METADATA_TYPES, "schema": C.SCHEMA_TYPES}[kind]
    v = _col(value)
    return (
        F.when(v.isNull() | (v == ""), "empty")
        .when(F.length(v) > C.MAX_TYPE_LENGTH, "too_long")
        .when(_has_traversal(v), "traversal")
        .when(~v.isin(allowed), "not_allowed")
    )


def payload_error(raw, max_bytes: int = C.MAX_PAYLOAD_BYTES) -> Column:
    """Payloads must be JSON objects of limited size; an absent payload is fine."""
    r = _col(raw)
    kind = F.schema_of_variant(parse_strict(r))
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(kind.isNull(), "not_json")
        .when(~kind.startswith("OBJECT"), "not_object")
        .when(F.octet_length(r) > max_bytes, "too_large")
    )


def normalize_path(path, base) -> Column:
    """Absolute path with '.', '..' and doubled slashes resolved."""
    p = _col(path)
    full = F.when(p.startswith("/"), p).otherwise(F.concat(_col(base), F.lit("/"), p))
    parts = F.filter(F.split(full, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def path_error(path, base) -> Column:
    """'traversal' or 'outside' when a path must be refused, else NULL."""
    norm, root = normalize_path(path, base), _col(base)
    inside = (norm == root) | norm.startswith(F.concat(root, F.lit("/")))
    return F.when(norm.contains(".."), "traversal").when(~inside, "outside")


def humanize(name) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(_col(name), "_", " "), r"\s+", " "))
    return F.initcap(spaced)


def is_uuid_like(value) -> Column:
    return F.coalesce(_col(value).rlike(r"\A[0-9a-fA-F-]{36}\z"), F.lit(False))


def policy_ok(ext, size, formats: list[str], max_bytes: int) -> Column:
    """Supported format and size limit; extensions are compared without their dot."""
    plain = [f.lower().lstrip(".") for f in formats]
    return F.lower(F.ltrim(_col(ext), F.lit("."))).isin(plain) & (_col(size) <= max_bytes)


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` inside a name; ``**`` also crosses directories."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        ch = glob[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch))
        i += 1
    return out


def matches_glob(path, globs: list[str]) -> Column:
    """A glob without '/' is matched against the file name, else against the path end."""
    p = _col(path)
    hit = F.lit(False)
    for g in globs:
        hit = hit | p.rlike(f"(^|/){glob_to_regex(g)}$")
    return hit


def client_id(forwarded_for, real_ip, peer) -> Column:
    blanks = r"[\s\x1c-\x1f\x85\p{Z}]+"
    first = F.regexp_replace(F.split_part(_col(forwarded_for), F.lit(","), F.lit(1)), f"^{blanks}|{blanks}$", "")
    return (
        F.when(F.coalesce(_col(forwarded_for), F.lit("")) != "", first)
        .when(F.coalesce(_col(real_ip), F.lit("")) != "", _col(real_ip))
        .otherwise(F.coalesce(_col(peer), F.lit("unknown")))
    )
