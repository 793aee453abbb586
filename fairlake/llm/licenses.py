"""Licence scans: normalised passages against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlake.llm.common import let

#: Short notices of common public licences, as their authors word them. More can be passed in.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License.", "Released under the Apache License 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the three clause BSD license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal."],
    "Proprietary": ["All rights reserved."],
}


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner full stops or hyphens: ``2.0`` and ``by-nc`` are one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def bigrams(words: Column) -> Column:
    """The set of word pairs; a lone word is a set of itself, no words none."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(
        F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def template_table(spark, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``(license, template, grams)``, one row per template."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), F.lit(text).alias("text"))
            for name, texts in (TEMPLATES if templates is None else templates).items() for i, text in enumerate(texts)]
    frame = spark.range(1).select(F.explode(F.array(*rows)).alias("t")) if rows else spark.sql(
        "SELECT named_struct('license', '', 'template', 0, 'text', '') AS t WHERE false")
    return frame.select("t.license", "t.template", bigrams(normal_words(F.col("t.text"))).alias("grams"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8,
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Every passage of every document that matches a licence template.

    Passages are the lines of a text. Two bigram sets of sizes a and b reach a Dice coefficient of
    ``threshold`` only if the smaller is at least ``threshold / (2 - threshold)`` of the larger, so
    a line is compared only to templates whose size lies in these bounds; most lines have none.
    A line is matched to its best template; ties go to the first name, then the first template.

    Returns one row per matching line: ``id_col``, ``line`` (from 0), ``passage`` (the line as it
    is), ``license``, ``template`` and ``dice``. Null and empty texts give no rows; repeated rows
    give their matches each. Further columns of ``docs`` are ignored. Templates are a fixed list
    that is part of the plan; its size does not follow the data.
    """
    rows = sorted(template_table(docs.sparkSession, templates).collect(), key=lambda r: (r["license"], r["template"]))
    ratio = threshold / (2 - threshold)
    fewest = min((len(r["grams"]) for r in rows), default=1) * ratio

    if not rows:
        return docs.selectExpr(f"{id_col}", "0 AS line", f"{text} AS passage", "'' AS license", "0 AS template", "0D AS dice").where("false")

    def fits(n: Column, size: int) -> Column:
        return n.between(int(-(-size * ratio // 1)), int(size / ratio))

    def dice(grams: Column, row) -> Column:
        wanted = F.array(*[F.lit(g) for g in row["grams"]])
        score = 2.0 * F.size(F.array_intersect(grams, wanted)) / (F.size(grams) + len(row["grams"]))
        return F.when(fits(F.size(grams), len(row["grams"])), F.struct(
            score.alias("dice"), F.lit(row["license"]).alias("license"), F.lit(row["template"]).alias("template")))

    def best(grams: Column) -> Column:
        found = F.filter(F.array(*[dice(grams, r) for r in rows]), lambda x: x["dice"] >= threshold)
        return F.reduce(found, F.get(found, F.lit(0)), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))

    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("passage")))
    # a line of n words has at most n - 1 bigrams, so the shortest lines go before any set is made
    wide = F.filter(lines, lambda x: F.length(x["passage"]) > 0)
    one_line = docs.select(F.col(id_col).alias("id"), F.explode(wide).alias("x"))
    matched = one_line.select("id", "x.line", "x.passage", let(normal_words(F.col("x.passage")), lambda w: F.when(
        F.size(w) >= fewest, let(bigrams(w), best))).alias("hit"))
    return matched.where("hit IS NOT NULL").select(F.col("id").alias(id_col), "line", "passage", "hit.license", "hit.template", "hit.dice")
