"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts become lower-case ASCII words; five neighbouring words are a shingle. Templates are put into
length classes. For a class of low to high shingles, a document is cut into windows of high + step - 1
shingles, one every ``step`` = max(1, high // 4), so any copy of a template lies within one window, at a
Jaccard similarity of at least low / (high + step - 1), which is above one half. A band is one MinHash value; window
and template meet if any of BANDS values agree: at similarity s that fails with probability
(1 - s)^BANDS, below 1e-9 for a whole copy and below 1e-5 for one that keeps 80 % of its shingles. Windows that hold no shingle of any
template can't contain one and are left out before hashing; this loses nothing.

Retrieved pairs are verified on the words themselves: the share of the template's distinct
shingles that the window holds must reach THRESHOLD percent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, let, text_of, write_through

SHINGLE = 5
BANDS = 30
THRESHOLD = 80
#: Templates are a parameter of bounded size: they travel in the plan and by broadcast.
MOST_TEMPLATE_WORDS = 200_000

# Public license notices, as their texts say them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
     "notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _at(words: Column, i: Column, k: int) -> list[Column]:
    return [words[(i + j).cast("int")] for j in range(k)]


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of k words; none if there are fewer."""
    n = F.size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*_at(words, i, k)))).otherwise(
        F.array().cast("array<bigint>")
    )


def shingle_texts(words: Column, k: int = SHINGLE) -> Column:
    n = F.size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.concat_ws(" ", *_at(words, i, k)))).otherwise(
        F.array().cast("array<string>")
    )


def length_classes(sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """(low, high, window, step) in shingles of the classes that hold a template of ``sizes``."""
    out, low = [], 1
    while low <= max(sizes, default=0):
        high = max(low, low * 3 // 2)
        step = max(1, high // 4)
        if any(low <= s <= high for s in sizes):
            out.append((low, high, high + step - 1, step))
        low = high + 1
    return out


def _bands(hashes: Column, bands: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(b, h)))),
    )


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: int = THRESHOLD,
                  bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` and license found: doc_id, license, containment, word (of the first window that shows it), windows.

    ``containment`` is the best share of a template's shingles; ``windows`` counts the windows that reach the
    threshold, overlapping ones, too. Null and empty texts, and templates of fewer words than a shingle, match nothing.
    Rows that repeat a doc_id with one text give one row; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    sizes = [len([w for w in re.split("[^a-z0-9]+", t.lower()) if w]) for _, t in templates]
    if sum(sizes) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of {sum(sizes)} words; {MOST_TEMPLATE_WORDS} at most: scan in parts")
    classes = length_classes([n - shingle + 1 for n in sizes if n >= shingle])
    number = F.lit(-1)
    for i, (low, high, _, _) in enumerate(classes):
        number = F.when(F.col("n").between(low, high), i).otherwise(number)
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    words = license_words(F.col("text"))
    known = known.select("template", "license", shingle_hashes(words, shingle).alias("hashes"), F.array_distinct(shingle_texts(words, shingle)).alias("texts"))
    known = known.where(F.size("hashes") > 0).withColumn("n", F.size("hashes")).withColumn("class", number)
    # At most MOST_TEMPLATE_WORDS numbers.
    all_hashes = sorted({h for r in known.select("hashes").collect() for h in r["hashes"]})
    by_band = known.select("template", "license", "texts", "class", F.posexplode(_bands(F.col("hashes"), bands)).alias("band", "value"))

    wanted = F.expr(f"array({', '.join(f'{h}L' if h > -2**63 else 'cast(-9223372036854775808 as bigint)' for h in all_hashes)})") if all_hashes else F.array().cast("array<bigint>")
    if not classes:
        classes = [(1, 1, 1, 1)]

    def class_cuts(no: int, window: int, step: int, words: Column, hashes: Column, hits: Column) -> Column:
        """The windows of a class that hold a hit; a text shorter than a window is one."""
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - (window - step + 1), F.lit(0)), F.lit(step))
        return F.transform(
            F.filter(starts, lambda s: F.arrays_overlap(F.slice(hashes, s + 1, window), hits)),
            lambda s: F.struct(
                F.lit(no).alias("class"), s.alias("start"), F.slice(hashes, s + 1, window).alias("part"),
                F.slice(words, s + 1, window + shingle - 1).alias("around"),
            ),
        )

    def cuts(words: Column, hashes: Column, hits: Column) -> Column:
        return F.flatten(F.array(*[class_cuts(i, window, step, words, hashes, hits) for i, (_, _, window, step) in enumerate(classes)]))

    empty = F.expr("cast(array() as array<struct<class: int, start: int, part: array<bigint>, around: array<string>>>)")
    found = let(license_words(text_of()), lambda words: let(shingle_hashes(words, shingle), lambda hashes: let(
        F.array_intersect(hashes, wanted), lambda hits: F.when(F.size(hits) > 0, cuts(words, hashes, hits)).otherwise(empty)
    )))
    cut = docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    cut = write_through(cut.withColumn("bands", _bands(F.col("part"), bands)).drop("part"), "license-windows")
    windows = cut.select("doc_id", "class", "start", "around", F.posexplode("bands").alias("band", "value"))
    met = windows.join(F.broadcast(by_band), ["class", "band", "value"]).dropDuplicates(["doc_id", "start", "class", "around", "template"])
    met = write_through(met, "license-pairs")
    found = met.withColumn("share", F.size(F.array_intersect("texts", F.array_distinct(shingle_texts(F.col("around"), shingle)))) / F.size("texts"))
    found = found.where(F.col("share") * 100 >= threshold)
    return found.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("start").cast("long").alias("word"), F.countDistinct("class", "start").alias("windows")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
