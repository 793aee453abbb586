"""Search, link audit, duplicates and other work over the whole catalog."""

from pyspark.sql import functions as F

from fairlake.functions import variants as V
from fairlake.operators import files, links, search
from fairlake.plans.registry import query, table, view
from fairlake.plans.validation_queries import _records
from fairlake.session import shared_dir

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_SCORES = """SELECT query_id, record, CAST(sum(CAST(round(1000000 * (ln(1 + (r - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (n * 2.2::DOUBLE)
    / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (t::DOUBLE / r))))) AS BIGINT)) AS BIGINT) AS score
  FROM asked JOIN posted USING (term) JOIN terms USING (term) CROSS JOIN totals GROUP BY query_id, record"""


def _search_sql(records_sql: str, queries_sql: str, top: int, where: str = "true") -> str:
    return f"""
WITH docs AS ({records_sql}),
found AS (SELECT *, {_TOKENS.format("coalesce(text, '')")} AS w FROM docs),
totals AS (SELECT count(*) AS r, sum(len(w)) AS t FROM found),
posted AS (SELECT record, len(w) AS length, term, count(*) AS n FROM (SELECT record, w, unnest(w) AS term FROM found) x GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("text")}) AS term FROM ({queries_sql}) q),
scores AS ({_SCORES})
SELECT query_id, record, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record) AS INT) AS rank
FROM scores JOIN docs USING (record) WHERE {where} QUALIFY rank <= {top}"""


@query("l03_search", _search_sql("SELECT doc_id AS record, text FROM @documents", "SELECT item_id AS query_id, text FROM @benchmark", 10))
def search_documents(spark, d):
    path = shared_dir(spark, "search-documents")
    search.build_index(table(spark, d, "documents"), path, "doc_id")
    return search.search(spark, path, table(spark, d, "benchmark"), query_id="item_id")


_TITLED = """SELECT record_key AS record, project_key, concat_ws(' ', raw ->> '$.experiment_title', raw ->> '$.sequencing_platform',
  raw ->> '$.sequencing_type', raw ->> '$.microscope_type', raw ->> '$.experiment_template_type') AS text FROM $contextual c"""


@query("l03_search_filtered", _search_sql(
    _TITLED, "SELECT 1 AS query_id, 'Illumina exome' AS text UNION ALL SELECT 2, 'Confocal imaging microscopy_imaging' UNION ALL SELECT 3, 'Run 7 to be FILLED'",
    25, "project_key <> 'p_src1'"))
def search_records(spark, d):
    names = ("experiment_title", "sequencing_platform", "sequencing_type", "microscope_type", "experiment_template_type")
    body = V.parse_strict("raw")
    texts = view(spark, d, "contextual").select("record_key", "project_key", F.concat_ws(" ", *[V.text(body, n) for n in names]).alias("text"))
    path = shared_dir(spark, "search-records")
    search.build_index(texts, path, fields=["project_key"])
    asked = spark.createDataFrame([(1, "Illumina exome"), (2, "Confocal imaging microscopy_imaging"), (3, "Run 7 to be FILLED")], "query_id INT, text STRING")
    return search.search(spark, path, asked, 25, F.col("project_key") != "p_src1")


_LINKS = " UNION ALL ".join(
    f"SELECT record_key, '{field}' AS field, '{kind}' AS kind, "
    + (f"unnest(json_extract_string(raw, '$.{field}[*]'))" if field == "instrument_used_link" else f"raw ->> '$.{field}'")
    + f" AS target FROM $records r WHERE metadata_type = '{metadata_type}'"
    for metadata_type, field, kind in links.LINK_FIELDS)
_IDS = " UNION ALL ".join(
    f"SELECT record_key, '{kind}' AS kind, raw ->> '$.{field}' AS target FROM $records r WHERE metadata_type = '{metadata_type}'"
    for metadata_type, field, kind in links.ID_FIELDS)
_INSTRUMENTS = "SELECT DISTINCT 'i_' || (s_suppkey % 5) AS instrument_id FROM @supplier WHERE s_suppkey % 5 <> 3"


@query("h14_broken_links", f"""
WITH RECURSIVE linked AS (SELECT DISTINCT * FROM ({_LINKS}) x WHERE trim(target) <> '' AND target <> 'To be filled'),
ids AS (SELECT * FROM ({_IDS}) y WHERE trim(target) <> '' AND target <> 'To be filled'),
targets AS (SELECT kind, target FROM ids UNION SELECT 'instrument', instrument_id FROM ({_INSTRUMENTS}) i),
broken(record_key, field, kind, target, depth) AS (
  SELECT *, 1 FROM linked WHERE (kind, target) NOT IN (SELECT (kind, target) FROM targets)
  UNION
  SELECT l.record_key, l.field, l.kind, l.target, b.depth + 1 FROM broken b JOIN ids ON ids.record_key = b.record_key
    JOIN linked l ON l.kind = ids.kind AND l.target = ids.target WHERE b.depth < 6)
SELECT record_key, field, target, CAST(min(depth) AS INT) AS depth FROM broken GROUP BY record_key, field, target""")
def broken_links(spark, d):
    instruments = table(spark, d, "supplier").where("s_suppkey % 5 <> 3").select(F.concat(F.lit("i_"), F.col("s_suppkey") % 5).alias("instrument_id"))
    return links.broken_links(_records(spark, d), instruments.distinct())


@query("c02_duplicate_files", """
SELECT size_bytes, checksum, min(path) AS representative, count(*) AS n_files, (count(*) - 1) * size_bytes AS wasted_bytes
FROM (SELECT OCTETS(text) AS size_bytes, sha256(text) AS checksum, '/' || source || '/' || doc_id AS path FROM @documents WHERE text IS NOT NULL) f
GROUP BY size_bytes, checksum HAVING count(*) > 1""")
def duplicate_files(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "doc_id"))
    sized = docs.select("path", F.octet_length("text").alias("size_bytes"))
    return files.duplicate_files(sized, docs.select("path", F.col("text").alias("content")))
