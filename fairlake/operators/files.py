"""File facts: checksums, scanners, defaults and minimum checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlake import constants as C
from fairlake.functions import paths as P

# The fields of a file fact.
FILE_FACT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("extension", T.StringType()), T.StructField("mime_type", T.StringType()),
    T.StructField("encoding", T.StringType()), T.StructField("permissions", T.StringType()),
    T.StructField("accessed_time", T.StringType()), T.StructField("created_time", T.StringType()),
    T.StructField("modified_time", T.StringType()), T.StructField("checksum", T.StringType()),
    T.StructField("owner", T.StringType()), T.StructField("group", T.StringType()),
    T.StructField("compression", T.StringType()), T.StructField("encryption", T.StringType()),
])


def large_enough(size) -> Column:
    """Files below ten bytes count as still being written."""
    return F.col(size) >= C.MIN_FILE_BYTES


def file_fact_error() -> Column:
    """First manifest field that is absent or empty; a size of 0 is empty too."""
    out = F.lit(None).cast("string")
    for name in ("checksum", "file_size_bytes", "file_path", "file_name"):
        empty = F.coalesce(F.col(name) == (0 if name == "file_size_bytes" else ""), F.lit(True))
        out = F.when(empty, name).otherwise(out)
    return out


def checksum(content, algorithm: str = "sha256") -> Column:
    """Hex digest of a string or binary column, computed inside the JVM."""
    data = F.col(content) if isinstance(content, str) else content
    data = data.cast("binary")
    algorithm = algorithm.lower()
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    raise ValueError(f"unknown checksum algorithm: {algorithm}")


def duplicate_files(files: DataFrame, contents: DataFrame | None = None, algorithm: str = "sha256") -> DataFrame:
    """Classes of files with equal content: ``size_bytes, checksum, representative, n_files, wasted_bytes``.

    ``files`` has ``path`` (unique) and ``size_bytes``. Sizes are counted first, and only files whose size another one
    has are digested: from ``contents`` (``path``, ``content``), joined by path, or else by reading the files on the
    executors. A class is counted, never listed: it has its first path, its number of files, and the bytes
    of all but one. Counts combine before their shuffle, so one digest may hold half of all rows. Files without a size are left
    out, files that cannot be read too; empty files are one class and waste nothing.
    """
    sized = files.where(F.col("size_bytes").isNotNull()).select("path", "size_bytes")
    shared = sized.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes")
    asked = sized.join(shared, "size_bytes", "left_semi")
    if contents is None:
        digested = checksum_files(asked, algorithm).where("checksum <> ''")
    else:
        digested = asked.join(contents, "path").select("size_bytes", "path", checksum("content", algorithm).alias("checksum"))
    classes = digested.groupBy("size_bytes", "checksum").agg(F.min("path").alias("representative"), F.count("*").alias("n_files"))
    return classes.where("n_files > 1").withColumn("wasted_bytes", (F.col("n_files") - 1) * F.col("size_bytes"))


def checksum_files(files: DataFrame, algorithm: str = "sha256", chunk_bytes: int = 4 << 20,
                   partitions: int | None = None) -> DataFrame:
    """Adds ``checksum`` by streaming each file in chunks on the executors.

    For files too large for one binary cell. Unreadable files get an empty checksum.
    """
    schema = T.StructType(files.schema.fields + [T.StructField("checksum", T.StringType())])

    def digest(path: str) -> str:
        from pyarrow import fs

        try:
            system, inner = fs.FileSystem.from_uri(path)
            h = hashlib.new(algorithm.lower())
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(chunk_bytes):
                    h.update(chunk)
            return h.hexdigest()
        except (OSError, ValueError):
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(checksum=[digest(p) for p in batch["path"]])

    spread = files.repartition(partitions) if partitions else files
    return spread.mapInPandas(run, schema)


def apply_scanner(files: DataFrame, scan: Callable[[dict], dict]) -> DataFrame:
    """Runs a user-supplied scanner on every row; a row that fails becomes a default fact.

    ``scan`` receives the row as a dict and returns any of the fact fields.
    """
    names = FILE_FACT.fieldNames()
    ints = {"size_bytes"}

    def one(row: dict) -> dict:
        try:
            found = scan(row)
            return {n: found.get(n) for n in names} | {"path": found.get("path", row["path"])}
        except Exception:
            return {n: None for n in names} | {"path": row["path"], "size_bytes": 0, "checksum": ""}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=names)
            yield out.astype({n: "Int64" for n in ints})

    return files.mapInPandas(run, FILE_FACT)


def standardize(facts: DataFrame, run_ts: str) -> DataFrame:
    """Fills every missing fact field with its default and keeps the fact columns only."""
    have = set(facts.columns)
    defaults = {
        "path": F.lit(None).cast("string"), "size_bytes": F.lit(0).cast("bigint"),
        "extension": P.suffix("path"), "mime_type": F.lit(C.DEFAULT_MIME_TYPE),
        "encoding": F.lit("unknown"), "permissions": F.lit(C.DEFAULT_PERMISSIONS),
        "accessed_time": F.lit(run_ts), "created_time": F.lit(run_ts), "modified_time": F.lit(run_ts),
        "checksum": F.lit(""), "owner": F.lit("unknown"), "group": F.lit("unknown"),
        "compression": F.lit("none"), "encryption": F.lit("none"),
    }
    return facts.select(*[
        (F.coalesce(F.col(n), default) if n in have else default).alias(n)
        for n, default in defaults.items()
    ])


def scan_content(files: DataFrame, run_ts: str, algorithm: str = "sha256", basic: bool = False) -> DataFrame:
    """File facts from rows that carry their content, with built-in functions only."""
    have = set(files.columns)
    sfx = P.suffix("path")
    known = {
        "path": F.col("path"), "size_bytes": F.octet_length("content").cast("bigint"), "extension": sfx,
        "mime_type": P.mime_type(sfx, basic), "compression": P.compression(sfx, basic),
        "checksum": checksum("content", algorithm),
    }
    if "mode" in have:
        known["permissions"] = P.mode_string("mode")
    known |= {n: F.col(n) for n in ("owner", "group", "accessed_time", "created_time", "modified_time") if n in have}
    return standardize(files.select(*[c.alias(n) for n, c in known.items()]), run_ts)
