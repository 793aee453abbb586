"""Project and dataset listings, record status and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake import constants as C


def list_projects(projects: DataFrame, folders: DataFrame, titles: DataFrame, root: str) -> DataFrame:
    """Title, path, visible folders and datasets of every project directory."""
    visible = ~F.col("dataset_key").startswith(".")
    counts = folders.groupBy("project_key").agg(
        F.count_if(visible).alias("folder_count"),
        F.count_if(F.col("dataset_key").startswith(C.DATASET_PREFIX)).alias("dataset_count"))
    return (
        projects.where(F.col("project_key").startswith(C.PROJECT_PREFIX))
        .join(counts, "project_key", "left").join(titles, "project_key", "left")
        .select(
            F.col("project_key").alias("project_id"), "project_title",
            F.concat(F.lit(root.rstrip("/") + "/"), "project_key").alias("path"),
            F.coalesce("folder_count", F.lit(0)).alias("folder_count"),
            F.coalesce("dataset_count", F.lit(0)).alias("dataset_count"))
    )


def metadata_status(folders: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``metadata_status`` to dataset folders, from the kinds of record they have."""
    key = ["project_key", "dataset_key"]
    has = records.groupBy(*key).agg(
        F.bool_or(F.col("metadata_type") == "complete_metadata").alias("_complete"),
        F.bool_or(F.col("metadata_type") == "dataset_structural").alias("_structural"))
    status = (
        F.when(F.col("_complete"), "V2_Finalized").when(F.col("_structural"), "V1_Ingested").otherwise("V0_Initial"))
    return folders.join(has, key, "left").withColumn("metadata_status", status).drop("_complete", "_structural")


def list_datasets(folders: DataFrame, records: DataFrame, titles: DataFrame, root: str) -> DataFrame:
    """Prefixed dataset folders with title, path and status."""
    datasets = folders.where(F.col("dataset_key").startswith(C.DATASET_PREFIX))
    key = ["project_key", "dataset_key"]
    return metadata_status(datasets, records).join(titles, key, "left").select(
        "project_key", F.col("dataset_key").alias("dataset_id"), "dataset_title",
        F.concat_ws("/", F.lit(root.rstrip("/")), "project_key", "dataset_key").alias("path"), "metadata_status")


def status_label(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    label = F.initcap(F.coalesce(F.get(F.split(s, "_"), F.lit(1)), F.lit("")))
    return F.when(F.coalesce(s, F.lit("")) == "", "").otherwise(F.concat(
        F.get(F.split(s, "_"), F.lit(0)), F.lit(": "), F.when(label == "Finalized", "Finalised").otherwise(label)))


def resolve_project_id(datasets: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``project_id``: the project record's identifier, else the folder name."""
    return datasets.join(projects.select("project_key", "project_identifier"), "project_key", "left").withColumn(
        "project_id", F.coalesce(F.nullif("project_identifier", F.lit("")), "project_key")).drop("project_identifier")


def missing_records(projects: DataFrame, folders: DataFrame, records: DataFrame) -> DataFrame:
    """Records that should exist and do not: a descriptive record per project, an administrative and a
    structural one per visible folder below it."""
    wanted = projects.select(
        "project_key", F.lit("").alias("dataset_key"), F.lit("project_descriptive").alias("metadata_type"))
    wanted = wanted.unionByName(
        folders.where(~F.col("dataset_key").startswith(".")).select("project_key", "dataset_key", F.explode(F.array(
            F.lit("dataset_administrative"), F.lit("dataset_structural"))).alias("metadata_type")))
    have = records.select("project_key", F.coalesce("dataset_key", F.lit("")).alias("dataset_key"), "metadata_type")
    return wanted.join(have, ["project_key", "dataset_key", "metadata_type"], "left_anti")


def catalog_report(projects: DataFrame, folders: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Per project: datasets, files, bytes, extensions, and datasets by status."""
    datasets = metadata_status(folders.where(F.col("dataset_key").startswith(C.DATASET_PREFIX)), records)
    by_status = datasets.groupBy("project_key").agg(
        F.count("*").alias("datasets"),
        *[F.count_if(F.col("metadata_status") == s).alias(n) for s, n in (
            ("V0_Initial", "initial"), ("V1_Ingested", "ingested"), ("V2_Finalized", "finalized"))])
    by_files = files.where(F.col("dataset_key").startswith(C.DATASET_PREFIX)).groupBy("project_key").agg(
        F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("file_extension")), ",").alias("extensions"))
    zero = ["datasets", "initial", "ingested", "finalized", "files", "bytes"]
    return projects.join(by_status, "project_key", "left").join(by_files, "project_key", "left").select(
        "project_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], F.coalesce("extensions", F.lit("")).alias("extensions"))
