"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment of shingles verifies them.

Texts and templates are sequences of five-word shingles. Windows of 4 shingles start at every second shingle of a text and at every
shingle of a template; a shorter template is a window itself. A window is signed by 32 bands of one hash function: the least and the
greatest of its shingles' hashes after each of 16 rotations by 4 bits. A text and a template that have a band in common meet in a join
on it; nothing is known of the texts before. Of windows with Jaccard similarity J, the chance that no band meets is about (1 - J)^32:

* A template of one shingle lies in two text windows, J = 1/4: 0.0001 (simulated 0.00002, as a window's least and greatest differ).
* One of two to four shingles has a window with J = 1/2 or more: under 10^-9.
* Of a longer one at least 4 in 5 shingles are there, so at least 2 in a row are, J = 1/3 or more: under 0.00001; where five in
  a row are, one text window of the two that start in them is a window of the template.

Retrieved pairs are verified with the whole text: they must share enough distinct shingles, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.llm.shared import keep, let, read_texts

SHINGLE = 5
CONTAINED = 0.8
#: Shingles in a window, and the distance between starts in a text.
WINDOW, STEP = 4, 2
#: Bits by which hashes are rotated; each rotation gives two bands.
ROTATIONS = range(0, 64, 4)
#: Bytes of templates whose bands are broadcast; beyond it, Spark chooses the join.
MOST_BROADCAST = 1_000_000

#: License and notice as public licenses word it (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def license_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_names(words: str, length: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of words; none where there are fewer words."""

    def of(w: Column) -> Column:
        last = F.size(w) - length
        names = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)]))
        return F.when(last >= 0, names).otherwise(F.array().cast("array<bigint>"))

    return let(F.col(words), of)


def shingle_texts(words: str, length: int = SHINGLE) -> Column:
    """The distinct shingles of an array of words."""

    def of(w: Column) -> Column:
        last = F.size(w) - length
        texts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, length), " "))
        return F.when(last >= 0, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))

    return let(F.col(words), of)


def bands(named: DataFrame, step: int) -> DataFrame:
    """The other columns of ``named`` and ``band``: one row for each window of its column ``names`` and each band."""
    others = [c for c in named.columns if c != "names"]
    shingle = [f"s{i}" for i in range(WINDOW)]
    windows = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(*[F.get(x, i + k).alias(s) for k, s in enumerate(shingle)]))
    rows = named.where(F.size("names") > 0).select(*others, let(F.col("names"), windows).alias("windows")).select(*others, F.inline("windows"))
    rows = rows.select(*others, *shingle, F.explode(F.array(*map(F.lit, ROTATIONS))).alias("by"))
    turned = [F.call_function("shiftleft", F.col(s), F.col("by")).bitwiseOR(F.call_function("shiftrightunsigned", F.col(s), 64 - F.col("by"))) for s in shingle]
    # least and greatest pass over the nulls after the last shingle; the complement keeps bands of the two kinds apart
    rows = rows.select(*others, F.least(*turned).alias("least"), F.greatest(*turned).alias("greatest"))
    return rows.select(*others, F.explode(F.array("least", F.bitwise_not("greatest"))).alias("band"))


def _template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """Templates with a word: number, license, words and length of their shingles, which are shorter only in templates of under five words."""
    rows = [(i, license_id, text) for i, (license_id, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", license_words(F.col("text")).alias("words"))
    return df.where(F.size("words") > 0).select("*", F.least(F.size("words"), F.lit(SHINGLE)).alias("length"))


def _template_bands(table: DataFrame, length: int) -> DataFrame:
    """Every window of a template starts a row for each band; windows that run over its end are left out, but for a template that is one window."""
    named = table.select("template", shingle_names("words", length).alias("names"))
    n = F.size("names")
    pieces = lambda names: F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.slice(names, i + 1, WINDOW))
    return bands(named.select("template", F.explode(let(F.col("names"), pieces)).alias("names")), WINDOW).distinct()


def retrieve(texts: DataFrame, table: DataFrame, length: int, broadcast: bool) -> DataFrame:
    """Distinct ``k1``, ``k2`` and ``template`` of the pairs with a band in common. ``texts``: k1, k2 and words."""
    signed = bands(texts.select("k1", "k2", shingle_names("words", length).alias("names")), STEP)
    known = _template_bands(table, length)
    known = F.broadcast(keep(known)) if broadcast else known
    return signed.join(known, "band").select("k1", "k2", "template").distinct()


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row for each document and template found in it: ``id_col``, ``license``, ``template``, ``n_shared``, ``n_shingles``.

    A template is found where the text holds at least ``contained`` of its distinct shingles; one of under five words is a single shingle.
    Whole texts are read. Null, empty and short texts have no shingle and no row, and templates without a word are never found. Rows that
    repeat, or share an id, give one row for each template and id with the most shingles shared; rows with a null id are told by their texts. Other
    columns are not read.
    """
    spark = documents.sparkSession
    given = TEMPLATES if templates is None else templates
    table = _template_table(spark, given)
    broadcast = sum(len(t) for _, t in given) <= MOST_BROADCAST
    kind = documents.schema[id_col].dataType
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows are told by hashes of id and text, so that ids that occur twice do no harm
    keyed = source.select("id", F.xxhash64("id").alias("k1"), F.xxhash64("text").alias("k2"), license_words(F.col("text")).alias("words"))
    found = None
    for length in sorted(r["length"] for r in table.select("length").distinct().collect()):
        own = table.where(F.col("length") == length)
        met = keep(retrieve(keyed.select("k1", "k2", "words"), own, length, broadcast))
        shingles = own.select("template", "license", shingle_texts("words", length).alias("wanted"))
        held = keyed.join(met.groupBy("k1", "k2").agg(F.collect_set("template").alias("templates")), ["k1", "k2"])
        held = held.select("id", "k2", "templates", shingle_texts("words", length).alias("held"))
        pair = held.select("id", "k2", "held", F.explode("templates").alias("template")).join(F.broadcast(shingles) if broadcast else shingles, "template")
        pair = pair.select("id", "k2", "license", "template", F.size(F.array_intersect("held", "wanted")).cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_shingles"))
        pair = pair.where(F.col("n_shared") >= F.ceil(F.lit(contained) * F.col("n_shingles")))
        found = pair if found is None else found.unionAll(pair)
    if found is None:
        return spark.createDataFrame([], "n long").select(F.lit(None).cast(kind).alias(id_col), F.lit("").alias("license"), F.lit(0).alias("template"), F.col("n").alias("n_shared"), F.col("n").alias("n_shingles"))
    nameless = F.when(F.col("id").isNull(), F.col("k2")).alias("nameless")
    best = found.groupBy("id", nameless, "license", "template").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.select(F.col("id").alias(id_col), "license", "template", "n_shared", "n_shingles")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses found in all documents."""
    return scan(read_texts(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(t)})" for i, (a, t) in enumerate(TEMPLATES))
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return rf"""
WITH t AS (SELECT template, license, {words} AS w FROM (VALUES {rows}) v(template, license, text)),
ts AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT template, license, count(*) AS n FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {words} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, template, count(*) AS n_shared FROM ds JOIN ts USING (s) GROUP BY ALL)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, n_shared, n AS n_shingles FROM m JOIN tn USING (template) WHERE n_shared >= ceil({CONTAINED} * n)"""


ORACLE = _oracle()
