"""What happens to records over the years: retention, migration between schema versions, values from sample tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlake.functions import variants as V

# --- retention ---------------------------------------------------------------------------------------------

_UNIT = r"(?:years?|yrs?|y|months?|mons?|weeks?|wks?|days?|d)"
_WORDS = rf"^\s*\d{{1,4}}\s*{_UNIT}(?:\s*(?:,|and|\s)\s*\d{{1,4}}\s*{_UNIT})*\s*$"
_ISO = r"^\s*P(?=\d)(?:\d{1,4}Y)?(?:\d{1,4}M)?(?:\d{1,4}W)?(?:\d{1,4}D)?\s*$"
_FOR_EVER = r"^\s*(?:indefinite(?:ly)?|permanent(?:ly)?|for\s?ever|unlimited)\s*$"


def _amounts(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda n, x: n + x.cast("int"))


def duration(text) -> Column:
    """A retention text as ``struct<state, months, days>``.

    ``state`` is ``limited`` for amounts of years, months, weeks and days in words (``10 years``, ``5 yrs and 3
    months``) or after ISO 8601 (``P5Y6M``), ``unlimited`` for words such as ``indefinitely``, ``none`` for null and blank texts,
    and ``unknown`` for all others. Amounts of one unit add up; upper and lower case are one.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    iso, words = t.rlike(_ISO.replace("P", "p").replace("Y", "y").replace("M", "m").replace("W", "w").replace("D", "d")), t.rlike(_WORDS)
    years = F.when(iso, _amounts(t, r"(\d+)y")).otherwise(_amounts(t, r"(\d+)\s*y"))
    months = F.when(iso, _amounts(t, r"(\d+)m")).otherwise(_amounts(t, r"(\d+)\s*mon"))
    weeks, days = _amounts(t, r"(\d+)\s*w"), _amounts(t, r"(\d+)\s*d")
    state = F.when(F.coalesce(V.is_blank(t), F.lit(True)), "none").when(iso | words, "limited").when(t.rlike(_FOR_EVER), "unlimited").otherwise("unknown")
    limited = state == "limited"
    return F.struct(state.alias("state"), F.when(limited, 12 * years + months).alias("months"), F.when(limited, 7 * weeks + days).alias("days"))


def retention_due(records: DataFrame, today: Column, schedule: str = "schedule", start: str = "start_date") -> DataFrame:
    """Adds ``retention`` (the state of the schedule), ``due_date`` and ``due``.

    Months are added first and end on the last day of a shorter month (31 January and a month is 28 or 29 February), days after
    that. What has no limit, an unknown text or no start has no due date and is never due, so unknown texts
    can be listed by their state.
    """
    read = records.withColumn("_d", duration(schedule))
    due = F.date_add(F.add_months(F.col(start).cast("date"), F.col("_d.months")), F.col("_d.days"))
    return read.withColumn("retention", F.col("_d.state")).withColumn("due_date", due).withColumn(
        "due", F.coalesce(F.col("due_date") <= today, F.lit(False))).drop("_d")


# --- migration -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Step:
    """How records of one schema version become the next: names, then values of absent members, then types, then what goes."""

    schema_id: str
    old: str
    new: str
    rename: dict[str, str] = field(default_factory=dict)
    default: dict[str, str] = field(default_factory=dict)  # JSON texts
    convert: dict[str, str] = field(default_factory=dict)  # SQL types
    drop: tuple[str, ...] = ()


def shortest_chain(steps: Sequence[Step], schema_id: str, old: str, new: str) -> list[Step] | None:
    """The fewest steps from one version to another, the first listed of equal ones; None where no chain leads there."""
    reached: dict[str, list[Step]] = {old: []}
    waiting = deque([old])
    while waiting:
        version = waiting.popleft()
        if version == new:
            return reached[version]
        for step in steps:
            if step.schema_id == schema_id and step.old == version and step.new not in reached:
                reached[step.new] = [*reached[version], step]
                waiting.append(step.new)
    return None


def _apply(members: Column, step: Step) -> tuple[Column, Column]:
    """Members after a step, and the names whose values cannot be converted; such values stay as they are."""
    if step.rename:
        names = F.create_map(*[F.lit(x) for kv in step.rename.items() for x in kv])
        present = F.map_keys(members)
        taken = F.map_filter(members, lambda k, _: ~(F.coalesce(F.array_contains(present, F.try_element_at(names, k)), F.lit(False))))
        members = F.transform_keys(taken, lambda k, _: F.coalesce(F.try_element_at(names, k), k))
    if step.default:
        values = F.create_map(*[x for k, v in step.default.items() for x in (F.lit(k), F.parse_json(F.lit(v)))])
        members = F.map_zip_with(members, values, lambda _, own, new: F.coalesce(own, new))
    failed = F.array().cast("array<string>")
    for name, kind in step.convert.items():
        value = F.try_element_at(members, F.lit(name))
        wanted = value.isNotNull() & ~F.is_variant_null(value)
        got = F.try_variant_get(value, "$", kind)
        failed = F.concat(failed, F.when(wanted & got.isNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
        new = F.create_map(F.lit(name), F.when(wanted, got.cast("variant")))
        members = F.map_zip_with(members, new, lambda _, own, changed: F.coalesce(changed, own))
        members = F.map_filter(members, lambda _, v: v.isNotNull())
    if step.drop:
        members = F.map_filter(members, lambda k, _: ~k.isin(*step.drop))
    return members, failed


def migrate(records: DataFrame, steps: Sequence[Step], targets: dict[str, str], schema_id: str = "schema_id", version: str = "version") -> DataFrame:
    """Brings record bodies to the ``targets`` version of their schema; adds ``migrated_version`` and ``problems``.

    The graph of versions is part of the call, and small; the shortest chain of steps for each version in it is composed into one
    expression over the body, so every record is rewritten where it lies, in one pass. A renamed member that would replace
    another stays out. ``problems`` names values that a type does not fit, which stay, and is ``no way to <version>`` for records
    whose version no chain leads on from; these, and records of other schemas, keep body and version.
    """
    members = V.members("body")
    bodies, problems, reached = F.col("body"), F.array().cast("array<string>"), F.col(version)
    for schema, target in targets.items():
        mine = F.col(schema_id) == schema
        known = dict.fromkeys(v for s in steps if s.schema_id == schema for v in (s.old, s.new))
        ways = {old: chain for old in known if old != target and (chain := shortest_chain(steps, schema, old, target))}
        lost = mine & ~F.coalesce(F.col(version).isin(target, *ways), F.lit(False))
        problems = F.when(lost, F.array(F.lit(f"no way to {target}"))).otherwise(problems)
        for old, chain in ways.items():
            now, failed = members, F.array().cast("array<string>")
            for step in chain:
                now, more = _apply(now, step)
                failed = F.array_union(failed, more)
            here = mine & (F.col(version) == old) & members.isNotNull()
            bodies = F.when(here, F.to_variant_object(now)).otherwise(bodies)
            problems = F.when(here, failed).otherwise(problems)
            reached = F.when(here, F.lit(target)).otherwise(reached)
    return records.select(*[c for c in records.columns if c != "body"], bodies.alias("body"), reached.alias("migrated_version"), problems.alias("problems"))


# --- values from sample tables -------------------------------------------------------------------------------

def prefill(records: DataFrame, samples: DataFrame, fields: Sequence[str], sample_id: str = "sample_id", at: str = "experiment_date") -> DataFrame:
    """Fills empty members of record bodies from sample tables; adds ``filled``, a map from member to the source it came from.

    ``samples`` has ``sample_id, source, precedence, valid_from`` and a text column per field. For each field the value comes from
    the source with the lowest precedence that has one, and of that source from the version valid at the record's date: the
    newest that does not begin after it. Equal dates are settled by the greater value. Members count as empty when
    they are absent, null, blank or the placeholder; others stay. Records without sample, date or match stay as they are.

    The best values change only where a version begins, and a running maximum along a sample's dates holds them. So versions
    of one date become one row, each asked date is one more, and records meet exactly one row: work and rows follow records
    and versions, not their pairs. ``record_key`` is unique.
    """
    wanted = records.where(F.col(sample_id).isNotNull() & F.col(at).isNotNull()).select(F.col(sample_id).alias("_id"), F.col(at).alias("_at")).distinct()
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct((-F.col("precedence")).alias("p"), "valid_from", F.col(f).alias("value"), "source"))).alias(f"_b_{f}")
            for f in fields]
    dated = samples.where(F.col("sample_id").isNotNull() & F.col("valid_from").isNotNull())
    versions = dated.groupBy(F.col("sample_id").alias("_id"), F.col("valid_from").alias("_at")).agg(*best)
    dates = versions.withColumn("_asked", F.lit(False)).unionByName(wanted.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy("_id").orderBy("_at")  # rows of equal dates count together
    known = dates.select("_id", "_at", "_asked", *[F.max(f"_b_{f}").over(so_far).alias(f"_b_{f}") for f in fields]).where("_asked").drop("_asked")
    joined = records.join(known, (F.col(sample_id) == F.col("_id")) & (F.col(at) == F.col("_at")), "left").drop("_id", "_at")
    body, filled = V.members("body"), F.create_map().cast("map<string,string>")
    for f in fields:
        empty = ~V.passes_gate(V.field("body", f))
        use = F.coalesce(empty, F.lit(True)) & F.col(f"_b_{f}").isNotNull()
        body = F.map_zip_with(body, F.create_map(F.lit(f), F.when(use, F.col(f"_b_{f}.value").cast("variant"))), lambda _, own, new: F.coalesce(new, own))
        filled = F.when(use, F.map_concat(filled, F.create_map(F.lit(f), F.col(f"_b_{f}.source")))).otherwise(filled)
    body = F.map_filter(body, lambda _, v: v.isNotNull())
    return joined.withColumns({"body": F.coalesce(F.to_variant_object(body), "body"), "filled": filled}).drop(*[f"_b_{f}" for f in fields])
