"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlake.llm import (
    divergence, embeddings, licenses, line_quality, mixing, packing, periodic, personal_data, secret_scan, simhash, substrings, toxicity, warc)
from fairlake.llm.common import table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op2_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
comp AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u),
cnt AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN cnt ON cnt.u = vec_id LEFT JOIN comp ON comp.u = vec_id
""")
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("row_key")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op7_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || doc_id) AS ticket FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS weight
  FROM sized GROUP BY source),
full_ AS (SELECT *, 2 * source_size AS most, most / weight AS dry_at FROM src),
lev AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY dry_at, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY dry_at, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM full_),
dry AS (SELECT *, weight * left_words >= most * left_weight AS is_dry FROM lev),
lim AS (SELECT left_words AS lw, left_weight AS lg FROM dry WHERE NOT is_dry ORDER BY dry_at, source IS NULL, source LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN is_dry THEN most::DOUBLE
         ELSE weight * (SELECT lw FROM lim)::DOUBLE / (SELECT lg FROM lim)::DOUBLE END AS target FROM dry),
queued AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ticket, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (least(size, greatest(0, floor(target) - before)) + least(size, greatest(0, floor(target) - before - source_size)))::BIGINT AS taken
FROM queued JOIN goal ON queued.source IS NOT DISTINCT FROM goal.source
""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.queue(table(spark, sf_dir, "documents"))
    return copies.groupBy("doc_id", "source", "before", "size", "source_size", "target").agg(
        F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM twice, range(35) AS r(j)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
         FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _template_values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, {i}, {quote(text)})"
                     for name, texts in licenses.TEMPLATES.items() for i, text in enumerate(texts))


_GRAMS = """CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"""


@query("op9_license_scan", rf"""
WITH tpl AS (
  SELECT license, template, {_GRAMS} AS grams FROM (
    SELECT license, template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*') AS w
    FROM (VALUES {_template_values()}) AS v(license, template, text))),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS passage
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
grams AS (SELECT doc_id, line, {_GRAMS} AS g FROM (
  SELECT *, regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*') AS w FROM lines)),
scored AS (
  SELECT doc_id, line, license, template, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN tpl ON len(g) > 0 AND list_has_any(g, grams))
SELECT doc_id, line::INT AS line, license, template, dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license, template) = 1
""")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("passage")


@query("op10_line_quality", r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
worded AS (SELECT *, regexp_extract_all(lower(raw), '[^\x20\x09-\x0D]+') AS lw FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM worded GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
often AS (SELECT source, array_to_string(lw, ' ') AS line FROM worded JOIN hosts USING (source)
          GROUP BY source, line, host_docs HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > 0.05 * host_docs),
gone AS (SELECT doc_id, sum(len(lw)) AS n FROM worded JOIN often
         ON worded.source = often.source AND array_to_string(lw, ' ') = often.line GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_line_words <= 0.7 * n_words AS kept FROM m
""")
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    shown = F.filter("spans", lambda s: s["plain"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter(shown, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(shown), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {v}))"


@query("op12_source_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
tok AS (SELECT row, lang, source, unnest(w) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS all_n FROM tok GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
lang_ AS (SELECT lang, count(*) AS v, sum(all_n)::HUGEINT AS all_total FROM vocab GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN vocab USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp g LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source
        GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, vo.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="total", v="v")} AS p,
             {_SHARE.format(n="all_n", total="all_total", v="v")} AS q
      FROM tot t JOIN lang_ USING (lang) JOIN vocab vo ON vo.lang = t.lang
      LEFT JOIN cnt ON cnt.lang = t.lang AND cnt.source = t.source AND cnt.term = vo.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def planted_loops(docs: DataFrame) -> DataFrame:
    """The texts of the contract: in one document of ten, chosen by id, the words repeat from some word on."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", words(F.col("text")).alias("w"), hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    first = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    looped = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, first)).withColumn("p", period)
    return own.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_loops(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed_text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.period").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
