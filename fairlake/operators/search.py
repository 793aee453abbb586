"""Search over record texts: an inverted index kept as a partitioned table, and ranked retrieval from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlake.session import shared_dir

#: Folders of the index, and parts into which the postings of one term are spread.
BUCKETS, SALTS = 32, 16
#: Pairs of query and record that one task scores, about.
PAIRS = 500_000
#: Usual BM25 settings: how soon repeated terms stop to matter, and how much length counts.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
                      F.array().cast("array<string>"))


def _bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A partitioned part of the index; an empty one has no files to read the schema from."""
    record = spark.read.parquet(f"{path}/records").schema["record"].dataType.simpleString()
    schema = {"terms": "term string, records long, bucket int",
              "postings": f"term string, record {record}, n long, length long, salt int, bucket int"}[name]
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def build_index(records: DataFrame, path: str, id_col: str = "record_key", text: str = "text", fields: Sequence[str] = ()) -> None:
    """Writes the index of ``text`` below ``path``, for :func:`search` to read as often as wanted.

    ``postings`` has one row per term and record with the count of the term and the record's length, in folders by
    a hash of the term, so a search reads the folders of its terms only; the postings of a frequent term
    are spread by a hash of the record. ``terms`` has the number of records per term, ``records`` the lengths and
    ``fields``, ``totals`` the number of records and of tokens. Counts combine before the shuffle.

    ``id_col`` is unique. Records without an id are left out; those without text have length 0 and are found by no
    term. Counting takes one shuffle; the folders are written from one more.
    """
    named = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record"), tokens(text).alias("found"), *fields)
    spark = records.sparkSession
    named.select("record", F.size("found").cast("long").alias("length"), *fields).write.mode("overwrite").parquet(f"{path}/records")
    spark.read.parquet(f"{path}/records").agg(F.count("*").alias("records"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).write.mode(
        "overwrite").parquet(f"{path}/totals")
    counted = named.select("record", F.size("found").cast("long").alias("length"), F.explode("found").alias("term"))
    counted = counted.groupBy("record", "length", "term").agg(F.count("*").alias("n"))
    placed = counted.select("term", "record", "n", "length", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int").alias("salt"),
                            _bucket("term").alias("bucket"))
    placed.repartition("bucket", "salt").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _part(spark, path, "postings").groupBy("bucket", "term").agg(F.count("*").alias("records")).repartition("bucket").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = 10, where: Column | None = None,
           query_id: str = "query_id", text: str = "text") -> DataFrame:
    """The ``top`` records for each query text by BM25: ``query_id, record, score, rank``.

    Every different term of a query counts once. ``score`` is in millionths, each term's part rounded, so that
    sums do not depend on their order; equal scores rank by record. ``where`` is a condition on the
    index's ``fields``: records that miss it are not ranked, and the weights of terms stay those of the whole index.

    The terms asked for are a table of their own, one row per term and part with the queries that ask for it. A posting meets it once and moves
    once, to its record's task, so a record's scores for all queries are added up where they arise and no pair of query and record is
    shuffled; tasks follow the number of pairs. Each task hands on the best ``top`` rows of a query only. A query
    without terms in the index has no rows; queries with the same id are one query. Null ids are left out.
    """
    totals = spark.read.parquet(f"{path}/totals").first()  # one row
    mean = max(totals["tokens"], 1) / max(totals["records"], 1)
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(tokens(text)).alias("term")).distinct()
    known = _part(spark, path, "terms").withColumnRenamed("records", "df")
    weight = F.log(1 + (totals["records"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.withColumn("bucket", _bucket("term")).join(known, ["bucket", "term"]).groupBy("bucket", "term", weight.alias("weight")).agg(
        F.collect_list("query_id").alias("queries"))
    terms = shared_dir(spark, "search-terms")
    weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).write.parquet(terms)
    part = F.col("weight") * (F.col("n") * (SATURATION + 1)) / (
        F.col("n") + SATURATION * ((1 - LENGTH_WEIGHT) + LENGTH_WEIGHT * F.col("length") / mean))
    tasks = min(max(totals["records"] * asked.agg(F.count_distinct("query_id")).first()[0] // PAIRS, 1), 10_000)
    hits = _part(spark, path, "postings").join(spark.read.parquet(terms), ["bucket", "term", "salt"]).select(
        "record", F.round(part * 1_000_000).cast("long").alias("part"), "queries").repartition(tasks, "record")
    if where is not None:
        allowed = spark.read.parquet(f"{path}/records").where(where).select("record")
        hits = hits.join(allowed, "record", "left_semi")
    scores = hits.select("record", "part", F.explode("queries").alias("query_id")).groupBy("query_id", "record").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "record")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
