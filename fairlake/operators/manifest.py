"""Per-dataset manifests: mapping, upsert, roll-up, uploads and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake.functions import paths as P
from fairlake.operators.ranking import rank_within, running_total
from fairlake.session import ensure_checkpoint_dir

# Manifest columns in their documented order.
MANIFEST_FIELDS = [
    "file_name", "role", "file_path", "file_extension", "file_size_bytes", "checksum",
    "checksum_algorithm", "file_type_os", "file_permissions", "file_accessed_utc",
    "file_created_utc", "file_modified_utc", "file_owner", "file_group", "file_encoding",
    "file_mime_type", "file_compression", "file_encryption", "file_validation_status",
    "file_processing_date",
]


def to_manifest(facts: DataFrame, run_ts: str, dataset_path: str = "dataset_path",
                algorithm: str = "sha256", compat: bool = True) -> DataFrame:
    """One manifest row per file fact. ``compat`` records SHA256 whatever the algorithm was."""
    recorded = "SHA256" if compat else algorithm.upper()

    def fact(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    return facts.select(
        F.col(dataset_path).alias("dataset_id"),
        P.base_name("path").alias("file_name"),
        F.lit("raw_data").alias("role"),
        P.relative_path("path", dataset_path).alias("file_path"),
        F.regexp_replace(F.coalesce("extension", F.lit("")), r"^\.+", "").alias("file_extension"),
        F.coalesce("size_bytes", F.lit(0)).alias("file_size_bytes"),
        fact("checksum", "").alias("checksum"),
        F.lit(recorded).alias("checksum_algorithm"),
        F.lit("file").alias("file_type_os"),
        fact("permissions", C.DEFAULT_PERMISSIONS).alias("file_permissions"),
        fact("accessed_time", run_ts).alias("file_accessed_utc"),
        fact("created_time", run_ts).alias("file_created_utc"),
        fact("modified_time", run_ts).alias("file_modified_utc"),
        fact("owner", "unknown").alias("file_owner"),
        fact("group", "unknown").alias("file_group"),
        fact("encoding", "unknown").alias("file_encoding"),
        fact("mime_type", C.DEFAULT_MIME_TYPE).alias("file_mime_type"),
        fact("compression", "none").alias("file_compression"),
        fact("encryption", "none").alias("file_encryption"),
        F.lit("validated").alias("file_validation_status"),
        F.lit(run_ts).alias("file_processing_date"),
    )


def upsert_manifest(current: DataFrame, new: DataFrame, order: list[str],
                    key: tuple[str, ...] = ("dataset_id", "file_name")) -> DataFrame:
    """Field-wise upsert: the latest non-null value of every field wins, per key.

    ``order`` columns of ``new`` give the ingest order. Both sides meet in one
    aggregation, which combines before the shuffle: a key that holds a third of
    the rows still sends one row per task, and no window or join is needed.
    """
    at = F.struct(F.lit(1).alias("_batch"), *[F.col(c) for c in order])
    incoming = new.withColumn("_at", at).drop(*[c for c in order if c not in current.columns])
    none = F.struct(F.lit(0).alias("_batch"), *[
        F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order])
    both = current.withColumn("_at", none).unionByName(incoming, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (*key, "_at")]
    latest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("value")))).alias(c)
        for c in fields
    ]
    merged = both.groupBy(*key).agg(*latest)
    return merged.select(*key, *[F.col(f"{c}.value").alias(c) for c in fields])


def append_new(current: DataFrame, new: DataFrame, order: list[str],
               key: tuple[str, ...] = ("dataset_id", "file_name")) -> DataFrame:
    """Insert-if-absent: rows whose key exists are left alone; of several new rows the first wins.

    New rows are reduced to one per key, combined before the shuffle, and only then joined, so a hot name is one row there.
    """
    rest = [c for c in new.columns if c not in key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("row")
    fresh = (
        new.groupBy(*key).agg(first)
        .join(current.select(*key), list(key), "left_anti")
        .select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])
    )
    return current.unionByName(fresh.select(*[c for c in fresh.columns if c in current.columns]),
                               allowMissingColumns=True)


def summarize_manifest(manifest: DataFrame) -> DataFrame:
    """File count, total size and distinct extensions of every dataset."""
    return manifest.groupBy("dataset_id").agg(
        F.count("*").alias("file_count"),
        F.sum(F.coalesce("file_size_bytes", F.lit(0))).alias("total_size_bytes"),
        F.array_sort(F.collect_set(F.coalesce("file_extension", F.lit("")))).alias("file_types"),
    )


def dataset_summary(datasets: DataFrame, manifest: DataFrame, rollup: DataFrame) -> DataFrame:
    """Stored roll-up per dataset, else the live file count; zeros without a manifest."""
    live = manifest.groupBy("dataset_id").agg(F.count("*").alias("_live"))
    return (
        datasets.join(live, "dataset_id", "left").join(rollup, "dataset_id", "left")
        .select(
            *datasets.columns,
            F.coalesce(F.when(F.col("_live").isNotNull(), F.coalesce("file_count", "_live")), F.lit(0)).alias("file_count"),
            F.coalesce(F.when(F.col("_live").isNotNull(), F.col("total_size_bytes")), F.lit(0)).alias("total_size_bytes"),
            F.coalesce(F.when(F.col("_live").isNotNull(), F.col("file_types")),
                       F.array().cast("array<string>")).alias("file_types"),
        )
    )


def append_uploads(manifest: DataFrame, uploads: DataFrame) -> DataFrame:
    """Adds upload rows without looking for the name; the comment becomes the description."""
    rows = uploads.select(
        "dataset_id", "file_name",
        F.lit("uploaded_file").alias("role"),
        F.concat(F.lit(C.METADATA_DIR + "/"), "file_name").alias("file_path"),
        F.coalesce("comment", F.lit("")).alias("file_description"),
        P.extension("file_name").alias("file_extension"),
        F.col("size_bytes").alias("file_size_bytes"),
        F.lit("file").alias("file_type_os"),
        F.col("uploaded_at").alias("file_created_utc"),
        F.col("uploaded_at").alias("file_modified_utc"),
    )
    return manifest.unionByName(rows, allowMissingColumns=True)


def _split_name(name: Column) -> tuple[Column, Column]:
    """Stem and last suffix; dots at the start do not open a suffix."""
    ext = F.when(name.rlike(r"(?s)^.*[^.].*\.[^.]*$"), F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)).otherwise(F.lit(""))
    return name.substr(F.lit(1), F.length(name) - F.length(ext)), ext


def dedupe_names(uploads: DataFrame, existing: DataFrame, order: str = "seq",
                 key: str = "dataset_id") -> DataFrame:
    """Adds ``stored_name``: the wanted name if free, else ``name_1.ext``, ``name_2.ext``…

    Uploads are served in the numeric, per-dataset unique ``order``. All uploads that want
    one name form a family; its k-th upload gets the k-th free number, computed from ranks,
    so nothing is tried row by row and a popular name is spread over many tasks. A name
    such as ``a_1.txt`` can be wanted by two families; then the earlier upload keeps it and
    the later ones of that name's root are computed again against the settled names.
    Every round settles at least the first open upload of each root, so it ends.
    """
    ensure_checkpoint_dir(uploads.sparkSession)
    stem, ext = _split_name(F.col("file_name"))
    columns = uploads.columns
    pending = uploads.withColumn("_stem", stem).withColumn("_ext", ext)
    pending = pending.withColumn("_root", F.regexp_replace("_stem", r"(_[0-9]+)+$", ""))
    root = [key, "_root", "_ext"]
    taken = existing.select(key, F.col("file_name").alias("_name")).distinct()
    settled = None
    while True:
        named = _free_numbers(pending, taken, order, key).withColumn("_name", F.concat(
            "_stem", F.when(F.col("_slot") > 0, F.concat(F.lit("_"), F.col("_slot").cast("string"))).otherwise(F.lit("")), "_ext"))
        winner = named.groupBy(key, "_name").agg(F.min(order).alias("_winner"))
        named = named.join(winner, [key, "_name"])
        first_loss = named.where(F.col(order) != F.col("_winner")).groupBy(*root).agg(F.min(order).alias("_loss"))
        named = named.join(first_loss, root, "left").checkpoint()
        done = F.col("_loss").isNull() | (F.col(order) < F.col("_loss"))
        won = named.where(done).select(*columns, F.col("_name").alias("stored_name"))
        settled = won if settled is None else settled.unionByName(won)
        pending = named.where(~done).select(*columns, "_stem", "_ext", "_root")
        if pending.isEmpty():
            return settled
        # Written each round, so the plan does not grow with the rounds.
        taken = taken.unionByName(won.select(key, F.col("stored_name").alias("_name"))).checkpoint()
        settled = settled.checkpoint()


def _free_numbers(pending: DataFrame, taken: DataFrame, order: str, key: str) -> DataFrame:
    """Adds ``_slot``: the upload's number in its family, 0 for the plain name."""
    family = [key, "_stem", "_ext"]
    ranked = rank_within(pending, family, order, "_k").withColumn("_at", F.col("_k") - 1)
    stem, ext = _split_name(F.col("_name"))
    parts = taken.select(key, stem.alias("_stem"), ext.alias("_ext"))
    plain = parts.withColumn("_n", F.lit(0).cast("bigint"))
    numbered = parts.where(F.col("_stem").rlike(r"(?s)_[1-9][0-9]{0,17}$")).select(
        key, F.regexp_replace("_stem", r"_[0-9]+$", "").alias("_stem"), "_ext",
        F.regexp_extract("_stem", r"_([0-9]+)$", 1).cast("bigint").alias("_n"))
    used = plain.unionByName(numbered).join(pending.select(*family).distinct(), family, "left_semi").distinct()
    # A taken number with at most k free numbers below it is skipped by the k-th upload (from 0).
    steps = rank_within(used, family, "_n", "_i").select(
        *family, (F.col("_n") - F.col("_i") + 1).alias("_at"), F.lit(1).cast("bigint").alias("_used"))
    points = ranked.select(*family, "_at", F.lit(0).cast("bigint").alias("_used")).unionByName(steps)
    per_point = points.groupBy(*family, "_at").agg(F.sum("_used").alias("_used"))
    skips = running_total(per_point, family, "_at", "_used", "_skip").select(*family, "_at", "_skip")
    return (
        ranked.join(skips, [*family, "_at"])
        .withColumn("_slot", F.col("_at") + F.col("_skip"))
        .drop("_k", "_at", "_skip")
    )


def nearest_root(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Adds ``dataset_root``: the deepest ancestor directory that is a root, else NULL.

    Ancestors are spelled out and matched by equality. This is done once per distinct
    directory, so the files themselves are joined only once, on their directory.
    """
    placed = files.withColumn("_dir", P.parent_path(path))
    ancestors = F.expr("transform(sequence(1, size(split(_dir, '/'))), i -> substring_index(_dir, '/', i))")
    nearest = (
        placed.select("_dir").distinct()
        .select("_dir", F.explode(ancestors).alias(root))
        .join(roots.select(root).distinct(), root)
        .groupBy("_dir").agg(F.max_by(root, F.length(root)).alias("dataset_root"))
    )
    return placed.join(nearest, "_dir", "left").drop("_dir")


def ingest_outcomes(files: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason``; expects ``dataset_root`` and ``size_bytes``."""
    reason = (
        F.when(F.col("dataset_root").isNull(), "no_dataset")
        .when(P.is_ignored("path"), "ignored")
        .when(F.col("size_bytes").isNull(), "missing")
        .when(F.col("size_bytes") < C.MIN_FILE_BYTES, "too_small")
    )
    return files.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "processed").otherwise("skipped"))


def dataset_files(manifest: DataFrame, dataset_id) -> DataFrame:
    """Manifest rows of one dataset; the filter reaches the scan."""
    return manifest.where(F.col("dataset_id") == dataset_id)


def ingest_uploads(uploads: DataFrame, manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads get safe, free names and are appended to the manifest."""
    safe = P.upload_name("file_name")
    named = uploads.withColumn(
        "file_name", F.when(safe == "", F.concat(F.lit("uploaded_file_"), F.col("seq").cast("string"))).otherwise(safe))
    stored = dedupe_names(named, existing).drop("file_name").withColumnRenamed("stored_name", "file_name")
    return append_uploads(manifest, stored)
