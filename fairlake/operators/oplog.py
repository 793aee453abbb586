"""Request-log and task-log analytics, access audit and quota audit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlake import constants as C
from fairlake.operators.ranking import running_total


def endpoint_stats(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint").agg(
        F.count("*").alias("count"), F.sum("latency_ms").alias("total_time"), F.avg("latency_ms").alias("avg_time"),
        F.min("latency_ms").alias("min_time"), F.max("latency_ms").alias("max_time"))


def slow_requests(requests: DataFrame, ms: float = C.SLOW_REQUEST_MS, n: int = 10, tie: str = "event_id") -> DataFrame:
    """The newest ``n`` requests above the threshold."""
    return (
        requests.where(F.col("latency_ms") > ms)
        .orderBy(F.desc("ts"), F.desc(tie)).limit(n)
        .select(tie, "endpoint", F.col("latency_ms").alias("duration_ms"), "ts")
    )


def hit_rates(lookups: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of every cache type; expects ``cache_type`` and boolean ``hit``
    (NULL for an access that was neither)."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return lookups.groupBy("cache_type").agg(
        hits.alias("hits"), misses.alias("misses"),
        F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0).alias("hit_rate"))


def suggestions(stats: DataFrame, hits: DataFrame) -> DataFrame:
    slow = stats.where(F.col("avg_time") > C.SLOW_REQUEST_MS).select(
        F.lit("slow_endpoint").alias("type"), F.col("endpoint").alias("subject"), F.col("avg_time").alias("measured"),
        F.concat(F.lit("cache or speed up "), "endpoint").alias("suggestion"))
    cold = hits.where(F.col("hit_rate") < C.LOW_HIT_RATE).select(
        F.lit("low_cache_hit_rate").alias("type"), F.col("cache_type").alias("subject"), F.col("hit_rate").alias("measured"),
        F.concat(F.lit("longer lifetime or better keys for "), "cache_type").alias("suggestion"))
    return slow.unionByName(cold)


def latency_percentiles(requests: DataFrame, percentiles: list[int] | None = None, column: str = "latency_ms",
                        approximate: bool = False) -> DataFrame:
    """Value at position ``int(p / 100 * (n - 1))`` of the sorted column, one row per percentile.

    Exact without sorting everything: values are counted (combined before the shuffle), the
    counts are added up over logarithmic buckets, of which doubles have a fixed number, and
    only the values in the few buckets that hold a wanted position are ordered.
    """
    ps = percentiles or C.REPORT_PERCENTILES
    if approximate:
        found = requests.agg(F.percentile_approx(column, [p / 100 for p in ps], 100_000).alias("v"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("percentile"), F.col("v").alias("value"))
        return found.select(F.inline(pairs))
    v = F.col(column).cast("double")

    def step(parts: int) -> Column:
        """A whole number that grows with the value, ``parts`` of them for each power of two."""
        size = F.when(F.abs("value") == float("inf"), 10_000 * parts).otherwise(F.floor(F.log2(F.abs("value")) * parts) + 2_000 * parts)
        return F.when(F.col("value") == 0, F.lit(0).cast("bigint")).otherwise(F.signum("value").cast("bigint") * size)

    values = (
        requests.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("value")).agg(F.count("*").alias("n"))
        .withColumn("bucket", step(64))
    )
    # One row per bucket, at most some 270,000 whatever the input: a single window is safe here.
    everything = Window.partitionBy(F.lit(0))
    buckets = (
        values.groupBy("bucket").agg(F.sum("n").alias("n"))
        .withColumn("total", F.sum("n").over(everything))
        .withColumn("upto", F.sum("n").over(everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    )
    wanted = F.array(*[
        F.struct(F.lit(p).alias("percentile"),
                 (F.floor(F.lit(p / 100) * (F.col("total") - 1)) + 1).alias("position")) for p in ps])
    hit = F.filter(wanted, lambda w: (w["position"] > F.col("upto") - F.col("n")) & (w["position"] <= F.col("upto")))
    targets = buckets.select("bucket", (F.col("upto") - F.col("n")).alias("before"), F.explode(hit).alias("w")).select(
        "bucket", "w.percentile", (F.col("w.position") - F.col("before")).alias("position"))
    inside = running_total(values.join(targets, "bucket"), ["percentile"], "value", "n", "upto", cut=step(65_536))
    here = (F.col("position") <= F.col("upto")) & (F.col("position") > F.col("upto") - F.col("n"))
    return inside.where(here).select("percentile", "value")


def latency_stats(requests: DataFrame) -> DataFrame:
    return requests.agg(F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"),
                        F.avg("latency_ms").alias("average_ms"))


def status_distribution(requests: DataFrame) -> DataFrame:
    """Requests per status code with their share in percent."""
    counts = requests.where("status_code IS NOT NULL").groupBy("status_code").agg(F.count("*").alias("n"))
    # One row per status code is left here.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.col("n") / total * 100)


def success_rate(requests: DataFrame) -> DataFrame:
    """Totals, failures and success rate; 100 when there are no requests."""
    failed = F.count_if(F.col("outcome").isin(C.FAILURE_OUTCOMES))
    total = F.count("*")
    return requests.agg(
        total.alias("total_requests"), failed.alias("total_failures"),
        F.when(total > 0, (total - failed) / total * 100).otherwise(100.0).alias("success_rate_percent"))


def outcome_counts(requests: DataFrame) -> DataFrame:
    return requests.where("outcome IS NOT NULL").groupBy("outcome").agg(F.count("*").alias("n"))


def critical_errors(requests: DataFrame, n: int = 20, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first ``n`` failed requests in log order."""
    return requests.where(F.col("outcome").isin(C.FAILURE_OUTCOMES)).orderBy(*order).limit(n)


def run_report(requests: DataFrame, all_lines: DataFrame | None = None,
               order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One row: run id (first one in log order), totals, rates, latency figures."""
    first_run = (all_lines if all_lines is not None else requests).agg(
        F.coalesce(F.expr(f"min_by(run_id, struct({', '.join(order)})) FILTER (WHERE run_id IS NOT NULL)"),
                   F.lit("unknown")).alias("run_id"))
    ps = C.REPORT_PERCENTILES
    wide = latency_percentiles(requests, ps).agg(*[
        F.max(F.when(F.col("percentile") == p, F.col("value"))).alias(f"p{p}_ms") for p in ps])
    stats = latency_stats(requests).select(F.struct("*")).scalar()
    positions = wide.select(F.struct("*")).scalar()
    return (
        success_rate(requests)
        .select("*", first_run.scalar().alias("run_id"), stats.alias("_s"), positions.alias("_p"))
        .select("run_id", "total_requests", "total_failures", "success_rate_percent", "_s.*", "_p.*")
    )


def list_tasks(tasks: DataFrame, task_type: str | None = None, status: str | None = None, n: int = 100) -> DataFrame:
    """Tasks of a type and status, newest first."""
    if task_type:
        tasks = tasks.where(F.col("task_type") == task_type)
    if status:
        tasks = tasks.where(F.col("status") == status)
    return tasks.orderBy(F.desc("created_at"), "task_id").limit(n)


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def retain(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Drops finished tasks created more than ``hours`` before ``now``."""
    old = F.col("created_at") < now - F.make_dt_interval(hours=F.lit(hours))
    return tasks.where(~(F.col("status").isin("completed", "failed", "cancelled") & old))


def access_audit(requests: DataFrame, endpoints: dict[str, str] = C.ENDPOINT_PERMISSIONS,
                 roles: dict[str, list[str]] = C.ROLE_PERMISSIONS) -> DataFrame:
    """Adds ``permission`` (NULL: none needed) and ``allowed``; expects method, path and array ``roles``."""
    needed = F.create_map(*[F.lit(x) for kv in endpoints.items() for x in kv])
    granted = F.create_map(*[x for r, ps in roles.items() for x in (F.lit(r), F.array(*[F.lit(p) for p in ps]))])
    permission = F.try_element_at(needed, F.concat_ws(" ", "method", "path"))
    held = F.flatten(F.transform("roles", lambda r: F.coalesce(
        F.try_element_at(granted, r), F.array().cast("array<string>"))))
    return requests.withColumn("permission", permission).withColumn(
        "allowed", F.col("permission").isNull() | F.coalesce(F.array_contains(held, F.col("permission")), F.lit(False)))


def _admit(times: np.ndarray, start: int, end: int, window: deque, limit: int, width: int, out: np.ndarray) -> None:
    """Marks the admitted requests of one client in ``times[start:end]``; jumps over denied runs."""
    i = start
    while i < end:
        while window and times[i] - window[0] >= width:
            window.popleft()
        if len(window) < limit:
            window.append(times[i])
            out[i] = True
            i += 1
        elif not window:
            return
        else:
            i += int(np.searchsorted(times[i:end], window[0] + width, side="left"))


def quota_audit(requests: DataFrame, limit: int, window_seconds: int, client: str = "client_id", ts: str = "ts",
                tie: str = "event_id") -> DataFrame:
    """Adds ``allowed``: at most ``limit`` admitted requests per client in any window.

    Denied requests do not count, and one exactly ``window_seconds`` old has expired, so
    the decisions of a client follow from each other and are made in one ordered pass per
    client that keeps ``limit`` times and never the client's rows. A pause of at least the
    window empties it, so every client is cut there into stretches that run apart. A client
    that never pauses stays one pass: its decisions form one chain.
    """
    width = window_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.withColumn("_t", micros)
    rows = rows.withColumn("_cell", F.floor(F.col("_t") / width))
    cells = rows.groupBy(client, "_cell").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    by_time = Window.partitionBy(client).orderBy("_cell")
    gap = F.coalesce(F.col("_from") - F.lag("_to").over(by_time) >= width, F.lit(True))
    cells = cells.withColumn("_gap", gap.cast("int")).select(
        F.col(client).alias("_client"), F.col("_cell").alias("_at"), F.sum("_gap").over(by_time).alias("_stretch"))
    same = F.col(client).eqNullSafe(F.col("_client")) & F.col("_cell").eqNullSafe(F.col("_at"))
    rows = rows.join(cells, same).drop("_cell", "_client", "_at")
    group = [client, "_stretch"]
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_t", "_stretch")] + [
        T.StructField("allowed", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, deque()
        for batch in batches:
            if batch.empty:
                continue
            times = batch["_t"].to_numpy()
            allowed = np.zeros(len(batch), dtype=bool)
            ids = [batch[c].to_numpy() for c in group]
            changes = np.any([c[1:] != c[:-1] for c in ids], axis=0)
            cuts = [0, *(np.flatnonzero(changes) + 1), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                owner = tuple(c[lo] for c in ids)
                if owner != current:
                    current, window = owner, deque()
                _admit(times, lo, hi, window, limit, width, allowed)
            yield batch.drop(columns=[c for c in ("_t", "_stretch") if c in batch]).assign(allowed=allowed)

    return rows.repartition(*group).sortWithinPartitions(*group, "_t", tie).mapInPandas(fold, schema)


def error_rows(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Error rows with type, message, context and cause; expects those four columns or NULLs."""
    return log.select(
        *(keep or []), F.coalesce("error_type", F.lit("Exception")).alias("error_type"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("context", F.lit("{}")).alias("context"),
        F.when(F.col("cause") != "", F.col("cause")).alias("cause"))
