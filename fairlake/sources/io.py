"""Readers and writers of files, records, schemas and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlake import constants as C
from fairlake.functions import paths as P
from fairlake.functions import variants as V
from fairlake.sources import bucketed


def scan_files(spark: SparkSession, root: str, keep_ignored: bool = False) -> DataFrame:
    """Every file below ``root`` with size and time; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_ts"))
    )
    found = found.withColumn("ignored", P.is_ignored("path"))
    return found if keep_ignored else found.where(~F.col("ignored")).drop("ignored")


def watch_files(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming inventory of the files that appear below ``root``."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    source = source.schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    return source.load(root).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_ts"))


def parse_records(raw: DataFrame, source: str = "raw") -> DataFrame:
    """Adds ``body`` and ``readable``; unreadable JSON gets a NULL body and stays in the output."""
    return raw.withColumn("body", V.parse_strict(source)).withColumn("readable", F.col("body").isNotNull())


def load_records(spark: SparkSession, root: str) -> DataFrame:
    """All JSON records in the ``.metadata`` folders of projects and datasets below ``root``, one row each.

    The folders are named in the path: Spark does not list hidden folders by itself. Of a member
    that an object has twice the last value counts.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    folders = f"{root.rstrip('/')}/{{*,*/*}}/{C.METADATA_DIR}"
    texts = spark.read.option("pathGlobFilter", "*.json").text(folders, wholetext=True).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_path"))
    parts = F.split("source_path", "/")
    owner = F.get(parts, F.size(parts) - 3)
    above = F.get(parts, F.size(parts) - 4)
    is_dataset = ~owner.startswith(C.PROJECT_PREFIX)
    return parse_records(texts).select(
        "source_path", F.regexp_replace(P.base_name("source_path"), r"\.json$", "").alias("metadata_type"),
        F.when(is_dataset, above).otherwise(owner).alias("project_key"),
        F.when(is_dataset, owner).alias("dataset_key"), "raw", "body", "readable")


def parse_schemas(texts: DataFrame) -> DataFrame:
    """Adds title and description to schema texts in ``body``; unreadable ones are skipped."""
    return (
        texts.withColumn("_s", V.parse_strict("body")).where(F.col("_s").isNotNull())
        .withColumn("title", V.text("_s", "title")).withColumn("description", V.text("_s", "description")).drop("_s")
    )


def load_schema_registry(spark: SparkSession, roots: dict[str, tuple[str, int]], data_root: str = "") -> DataFrame:
    """Schemas below several folders: ``{source: (folder, priority)}``, bad files skipped."""
    layers = None
    for source, (folder, priority) in roots.items():
        texts = (
            spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
            .select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("_path"))
        )
        inside = F.regexp_extract("_path", r"((contextual/)?[^/]+)\.json$", 1)
        layer = parse_schemas(texts).select(
            F.lit(data_root).cast("string").alias("data_root"), inside.alias("schema_id"), F.lit(source).alias("source"),
            F.lit(priority).alias("priority"), "title", "description", "body")
        layers = layer if layers is None else layers.unionByName(layer)
    return layers


# The fields of one request log line.
_LOG_LINE = ("timestamp STRING, level STRING, name STRING, message STRING, details STRUCT<run_id: STRING, endpoint: STRING, "
             "method: STRING, status_code: INT, latency_ms: DOUBLE, outcome: STRING>, _corrupt STRING")


def parse_request_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Completed API requests of a JSON-lines log; undecodable lines are skipped."""
    kept = [c for c in lines.columns if c != value]
    parsed = lines.select(*kept, F.from_json(
        value, _LOG_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where(
        F.col("r._corrupt").isNull() & (F.col("r.name") == C.REQUEST_LOGGER) & (F.col("r.message") == C.REQUEST_MESSAGE)
    ).select(*kept, F.col("r.timestamp").alias("timestamp"), "r.details.*")


def load_request_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_request_log(spark.read.text(path))


def parse_change_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``hash|author|date|message`` lines; a line with any other number of parts is dropped."""
    parts = F.split(F.col(value), r"\|", -1)
    return lines.where(F.size(parts) == 4).select(*[
        parts[i].alias(n) for i, n in enumerate(("hash", "author", "date", "message"))])


def load_change_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_change_log(spark.read.text(path))


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Writes one immutable version of a table, then the pointer that makes it current.

    The committer publishes the data as a whole; readers follow the pointer, which is
    written last, so a failed write leaves the former version in place.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    spark.createDataFrame([(version,)], "version BIGINT").coalesce(1).write.mode("append").parquet(f"{path}/_pointers_")


def current_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/_pointers_").agg(F.max("version")).first()[0]


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current, or a given, version of a table, whole or in buckets."""
    if bucketed.pointers(spark, path):
        return bucketed.read_table(spark, path, version)
    chosen = current_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/version={chosen}")


def to_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per row next to its key columns."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("document"))


def export_json(df: DataFrame, path: str, partition: str = "project_key") -> None:
    """JSON documents as text, in one folder per project; rows of a project may fill many files."""
    to_documents(df, [partition]).write.mode("overwrite").partitionBy(partition).text(path)
