"""Secret scans: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake.llm.common import let, settle, words

#: A value: a run that can be a key, a digest, a password or an address.
SHAPE = r"[A-Za-z0-9+/_=.:@~-]{12,}"
#: What may be a value after a credential's name; every run of SHAPE is one of these too.
RUN = r"[A-Za-z0-9+/_=.:@~-]{6,}"
NAMES = r"(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth|bearer|credential)s?"
KEY_NAMES = rf"(?i)(?:^|[^a-z]){NAMES}(?:$|[^a-z])"
#: Text that ends with a credential's name and an assignment, and a run that begins so.
NAMED_BEFORE = rf"(?i)(?:^|[^a-z]){NAMES}[\"'`]?\s*[=:]+\s*[\"'`]*$"
NAMED_RUN = rf"(?i)^((?:[a-z0-9]+[_.-])*{NAMES})[=:](?=.{{6}})"
HARMLESS_NAMES = r"(?i)(?:^|[^a-z])(?:example|sample|dummy|uuid|sha1|sha256|md5|hash|commit|checksum|digest|card|phone|mail|url|isbn)(?:$|[^a-z])"
TEST_PATHS = r"(?i)(?:^|[/._-])(?:test|tests|example|examples|sample|fixture|fixtures|mock|docs?)(?:$|[/._-])"
CONFIG_PATHS = r"(?i)\.(?:env|ini|cfg|conf|ya?ml|json|toml|properties|tf)$"
#: Key formats that their issuers document.
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^sk_live_[A-Za-z0-9]{16,}$"
ADDRESS = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$|^[a-z]+://|^(?:www\.|[a-z0-9-]+\.)+[a-z]{2,}(?:/|$)"

FEATURES = ["length", "digits", "capitals", "class_changes", "vowel_changes", "distinct", "coverage", "is_test_path", "is_config_path",
            "path_depth", "named", "assigned", "quoted", "harmless"]


def candidates(docs: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """One row per candidate: its row, place among the words, number among the word's runs, value, the text around it and its path.

    Every run of a word is looked at. A run of 12 with a digit or a change of case is a candidate, and
    so is a value of 6 after a credential's name. The text before a later run is what lies between it and the run before.
    """
    def pick(w: Column) -> Column:
        found = F.transform(w, lambda x, i: F.when(x.rlike(RUN), F.struct(i.alias("place"), x.alias("word"))))
        kept = F.filter(found, lambda x: x.isNotNull())
        around = F.transform(kept, lambda x: F.struct(
            x["place"].alias("place"), x["word"].alias("word"),
            F.array_join(F.slice(w, F.greatest(x["place"] - 1, F.lit(1)), F.least(x["place"], F.lit(2))), " ").alias("before"),
            F.array_join(F.slice(w, x["place"] + 2, 2), " ").alias("after")))
        return F.filter(around, lambda x: x["word"].rlike(f"{SHAPE}|(?i){NAMES}") | x["before"].rlike(NAMED_BEFORE))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row_key"), F.col(path).alias("path"),
                       F.explode(let(words(F.col(text)), pick)).alias("x"))
    runs = F.regexp_extract_all("x.word", F.lit(RUN), F.lit(0))
    split = rows.select("id", "row_key", "path", "x.*", runs.alias("runs"), F.split("x.word", RUN, -1).alias("gaps"))
    each = split.select("*", F.posexplode("runs").alias("run", "text"))
    earlier = F.when(F.col("run") > 0, F.get("runs", F.col("run") - 1))
    plain = ~earlier.rlike(f"^{SHAPE}$") | ~earlier.rlike("[0-9]|[a-z][A-Z]")
    own = F.concat(F.when(plain, earlier).otherwise(""), F.get("gaps", F.col("run")))
    lead = F.when(F.col("run") > 0, own).when((own == "") | (F.col("before") == ""), F.concat("before", own)).otherwise(F.concat_ws(" ", "before", own))
    each = each.withColumn("before", lead)
    credential = F.regexp_extract("text", NAMED_RUN, 1)
    name = F.when(credential != "", credential).otherwise(F.regexp_extract("text", r"^([A-Za-z_.-]{1,40})[=:](?=.{8})", 1))
    value = F.rtrim(F.when(name != "", F.substr("text", F.length(name) + 2)).otherwise(F.col("text")), F.lit(".:=~-"))
    shaped = F.col("text").rlike(f"^{SHAPE}$") & F.col("text").rlike("[0-9]|[a-z][A-Z]") & (F.length(value) >= 8)
    named = (F.col("before").rlike(NAMED_BEFORE) | (credential != "")) & (F.length(value) >= 6)
    return each.where(shaped | named).select("id", "row_key", "path", "place", "run", "word", "before", "after", name.alias("name"), value.alias("value"))


def common_words(docs: DataFrame, text: str, least: int = 5) -> DataFrame:
    """The dictionary: runs of three or more letters that stand alone in at least ``least`` documents."""
    plain = F.filter(F.array_distinct(words(F.lower(F.col(text)))), lambda w: w.rlike(r"^\p{L}{3,}[.,;:!?]?$"))
    return (
        docs.select(F.explode(plain).alias("w")).groupBy(F.regexp_replace("w", "[.,;:!?]$", "").alias("word"))
        .agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)
    )


def _per_char(value: str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))) / F.greatest(F.length(value), F.lit(1))


def measured(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``FEATURES``.

    Coverage is the share of a value's characters in dictionary words that begin or end its runs of letters.
    """
    found = found.withColumn("key", F.xxhash64("row_key", "place", "run"))
    runs = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    split = found.select("key", F.explode(runs).alias("run")).withColumn("n", F.length("run"))
    sizes = F.sequence(F.lit(3), F.least(F.col("n"), F.lit(20)))
    ends = F.concat(F.transform(sizes, lambda k: F.struct(F.lit(0).alias("side"), F.substr("run", F.lit(1), k).alias("part"))),
                    F.transform(sizes, lambda k: F.struct(F.lit(1).alias("side"), F.substr("run", F.col("n") - k + 1, k).alias("part"))))
    parts = split.select("key", "run", "n", F.explode(ends).alias("x")).select("key", "run", "n", "x.side", "x.part")
    known = parts.join(dictionary.select("word"), F.col("part") == F.col("word")).withColumn("size", F.length("part"))
    longest = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("size"))), F.lit(0))
    per_run = known.groupBy("key", "run", "n").agg((longest(0) + longest(1)).alias("both"))
    covered = per_run.groupBy("key").agg(F.sum(F.least("n", "both")).alias("covered"))
    covered = covered.withColumnRenamed("key", "k")
    around = F.concat_ws(" ", "before", "name")
    path = F.coalesce("path", F.lit(""))
    flag = lambda c: c.cast("double")
    return found.join(covered, F.col("key") == F.col("k"), "left").select(
        *found.columns,
        F.length("value").cast("double").alias("length"),
        _per_char("value", "[0-9]").alias("digits"), _per_char("value", "[A-Z]").alias("capitals"),
        _per_char("value", r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])").alias("class_changes"),
        _per_char("value", r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])").alias("vowel_changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.greatest(F.length("value"), F.lit(1))).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / F.greatest(F.length("value"), F.lit(1))).alias("coverage"),
        flag(path.rlike(TEST_PATHS)).alias("is_test_path"), flag(path.rlike(CONFIG_PATHS)).alias("is_config_path"),
        (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double").alias("path_depth"),
        flag(around.rlike(KEY_NAMES)).alias("named"),
        flag((F.col("name") != "") | F.col("before").rlike("[=:]\\s*[\"'`]*$")).alias("assigned"),
        flag(F.col("word").rlike("[\"'`]")).alias("quoted"),
        flag(F.concat_ws(" ", "before", "name", "after").rlike(HARMLESS_NAMES)).alias("harmless"),
    )


def rule_findings(found: DataFrame) -> DataFrame:
    """Labelled findings that need no reviewer; what they cannot decide is left out.

    1: an issuer's documented format, or a value with digits assigned to a credential's name.
    0: addresses, plain numbers (card numbers too) and values made of dictionary words.
    """
    mark = (
        F.when(F.col("value").rlike(ISSUED), 1)
        .when(F.col("value").rlike(ADDRESS) | F.col("value").rlike(r"^[0-9.:/-]+$"), 0)
        .when((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0), 1)
        .when(F.col("coverage") > 0.6, 0)
    )
    return found.withColumn("label", mark.cast("double")).where("label IS NOT NULL")


def train_forest(findings: DataFrame, rows: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 7) -> PipelineModel | None:
    """A forest on at most ``rows`` distinct labelled findings; None unless both labels occur in all of them.

    Copies of a value with equal features count once. The sample is drawn by hash for each label; a rare
    label gets at least a tenth of the rows, or all it has, and weights keep the labels' shares. It
    is one small sorted partition, so reruns build the same trees.
    """
    single = settle(findings.where("label IS NOT NULL").select("value", *FEATURES, "label").distinct().withColumn(
        "h", F.xxhash64("value", *FEATURES)), "secret-labelled")
    counts = {r["label"]: r["count"] for r in single.groupBy("label").count().orderBy("label").collect()}
    if len(counts) < 2:
        return None
    total, drawn = sum(counts.values()), []
    quotas = {k: min(n, max(rows * n // total, rows // 10)) for k, n in counts.items()}
    most = max(quotas, key=lambda k: quotas[k])
    quotas[most] = min(quotas[most], rows - sum(q for k, q in quotas.items() if k != most))
    for label, quota in quotas.items():
        share = min(1.0, (2 * quota + 1000) / counts[label])  # so that not much more than twice the sample meets in one task
        near = single.where((F.col("label") == label) & (F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))))
        drawn.append(near.orderBy("h", *FEATURES).limit(quota).withColumn("weight", F.lit(counts[label] / quota)))
    sample = settle(reduce(DataFrame.unionByName, drawn), "secret-sample")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample.orderBy("h", *FEATURES, "label").coalesce(1))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", path: str = "source",
         threshold: float = 0.5, least: int = 5) -> DataFrame:
    """Every candidate of every whole text with the forest's ``score`` and ``is_secret``.

    ``findings`` holds labelled candidates, ``(value, label)``; without it the rules label what
    they can decide. The dictionary is counted over all documents. Returns ``id_col``,
    ``row_key``, ``place`` (of the word), ``run`` (within it), ``value``, ``before``, ``after``, ``FEATURES``, ``score`` and ``is_secret``. With labels of one kind
    only in all labelled findings, every candidate gets that label; without any, 0. Null and empty texts have no candidates;
    a null path is an empty one; repeated rows give their candidates each. Further columns are
    ignored. An empty table gives no rows.
    """
    found = settle(candidates(docs, id_col, text, path), "secret-candidates")
    ready = settle(measured(found.distinct(), settle(common_words(docs, text, least), "secret-words")), "secret-features")
    if findings is None:
        labelled = rule_findings(ready)
    else:
        named = findings.groupBy(F.col("value").alias("v")).agg(F.max("label").cast("double").alias("label"))
        labelled = ready.join(named, F.col("value") == F.col("v")).drop("v")
    model = train_forest(labelled)
    if model is None:
        only = labelled.agg(F.max("label")).first()[0] or 0.0
        scored = ready.withColumn("score", F.lit(float(only)))
    else:
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    keys = ["id", "row_key", "place", "run"]
    again = found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_times")).where("_times > 1")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_row_key")) & (F.col("place") == F.col("_place")) & (
        F.col("run") == F.col("_run"))
    every = scored.join(again, same, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_times", F.lit(1)))))
    return every.select(F.col("id").alias(id_col), "row_key", "place", "run", "value", "before", "after", *FEATURES, "score",
                        (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mark`` wherever it stands in its text; no row is lost."""
    secret = scan(docs, id_col=id_col, text=text, path=path, **options).where("is_secret")
    values = secret.groupBy(F.col("row_key").alias("_key")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("_values"))
    joined = docs.join(settle(values, "secret-values"), F.xxhash64(id_col, text) == F.col("_key"), "left")
    clean = F.when(F.col("_values").isNull(), F.col(text)).otherwise(
        F.aggregate("_values", F.col(text), lambda t, v: F.replace(t, v, F.lit(mark))))
    return joined.select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
