"""License scans (operator 10). DataFrame functions only.

1. Units: every line of a file, every block of lines between blank ones (a header that is hard-wrapped, in a comment or
   not) and the whole text of a file named like a licence are compared with license templates (notices, openings
   and whole licence texts) by the cosine of TF-IDF vectors over words. The space is that of
   the templates' words, whose document frequencies are counted over all files; any other
   word of a unit weighs OTHER.
2. A unit can only reach the threshold if it shares words with a template that carry
   THRESHOLD^2 of the template's squared length, so it holds one of the words that are left
   when the lightest ones, short of that, are taken away. Lines without such a word are passed
   over. That loses nothing.
3. Equal units are scored once.
4. A file's own licence is that of its best unit (ties: the lowest number, then the name).
   Licence files stand for their directory: files named like one, and those whose first
   line or block is a notice if `first_line` is set.
5. Other files inherit from the nearest ancestor directory that has a licence file, by a join
   of directories with the paths above them.

Nulls: a null text is an empty one; a null path has no directory and inherits nothing.
Files of equal path are rows of their own. Of several licence files of a directory the best
match counts (ties: least path, then name).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, spread_join, text_key, unused

THRESHOLD, OTHER = 0.6, 1.0
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

#: Notices as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   "except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
            'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in re.findall("[a-z0-9]+", t.lower())})


def weights(files: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequencies of the templates' words over all files."""
    own = F.array_intersect(words(F.col("text").cast("string")), F.lit(vocabulary(templates)))
    counted = files.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    total, df = files.count(), {r["word"]: r["n"] for r in counted}
    return {w: math.log(1 + (total + 1) / (df.get(w, 0) + 1)) for w in vocabulary(templates)}


def vectors(idf: dict[str, float], templates=TEMPLATES) -> list[tuple[str, dict[str, float]]]:
    """Templates as vectors of length 1."""
    out = []
    for name, text in templates:
        own = re.findall("[a-z0-9]+", text.lower())
        v = {w: own.count(w) * idf[w] for w in set(own)}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {w: x / size for w, x in v.items()}))
    return out


def needed(made: list[tuple[str, dict[str, float]]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a line that reaches the threshold holds one."""
    out = set()
    for _, v in made:
        left = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            left += x * x
            if left >= threshold**2 - 1e-9:
                out.add(w)
    return sorted(out)


def scored(lines: DataFrame, idf: dict[str, float], made, threshold: float = THRESHOLD) -> DataFrame:
    """line_id, license, similarity: the best template of each line that reaches the threshold.
    lines: line_id, line, a row per distinct line."""
    spark = lines.sparkSession
    # both tables are as large as the templates, a parameter
    terms = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    rows = [(w, i, name, x) for i, (name, v) in enumerate(made) for w, x in v.items()]
    vector = F.broadcast(spark.createDataFrame(rows, "word string, template int, license string, x double"))
    tf = lines.select("line_id", F.explode(words(F.col("line"))).alias("word"))
    tf = tf.groupBy("line_id", "word").agg(F.count("*").alias("n")).join(terms, "word", "left")
    tf = materialized(tf.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(OTHER))), "line-words")
    norm = tf.groupBy("line_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(vector, "word").groupBy("line_id", "template", "license").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    cosine = dot.join(norm, "line_id").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best")
    out = cosine.where(F.col("similarity") >= threshold).groupBy("line_id").agg(best)
    return out.select("line_id", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"))


def units(text: Column, named: Column) -> Column:
    """array of (no, text): each line with its number, each block of more than one line with its number among the blocks, and
    where `named` the whole text, if it has more than one block, as number 0."""
    lines = F.transform(F.split(text, "\\n"), lambda x, i: F.struct(i.alias("no"), x.alias("text")))
    # A line without letters or digits parts blocks; marks of comments are no words.
    parted = F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)")
    blocks = F.transform(parted, lambda x, i: F.struct(i.alias("no"), x.alias("text")))
    blocks = F.filter(blocks, lambda b: F.contains(F.trim(b["text"]), F.lit("\n")))
    whole = F.filter(F.array(F.struct(F.lit(0).alias("no"), text.alias("text"))), lambda _: named & (F.size(parted) > 1))
    return F.concat(lines, blocks, whole)


def ancestors(directory: Column) -> Column:
    """A directory's path and those above it, nearest first, down to the root ''."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, first_line: bool = False) -> DataFrame:
    """files (path, text, ...) with license, license_origin ('own', 'inherited' or null),
    license_similarity and license_from (the path of the licence file, if inherited)."""
    added = ["license", "license_origin", "license_similarity", "license_from"]
    files = files.drop(*added)
    idf = weights(files, templates)
    made = vectors(idf, templates)
    text_id, directory = unused(files, "text_id"), unused(files, "directory")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = F.col("path").cast("string")
    tagged = files.withColumns({
        text_id: text_key(text),
        directory: F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), ""),
    })
    stands = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    pattern = "(?<![a-z0-9])(?:" + "|".join(needed(made, threshold)) + ")(?![a-z0-9])"
    hit = tagged.select(text_id, text.alias("t"), stands.alias("named")).where(F.lower("t").rlike(pattern))
    headers = hit.select(F.col(text_id).alias("text_id"), F.explode(units(F.col("t"), F.col("named"))).alias("unit"))
    headers = headers.select("text_id", F.col("unit.no").alias("line_no"), F.ltrim("unit.text").alias("line"))
    headers = headers.where(F.lower("line").rlike(pattern))
    headers = materialized(headers.withColumn("line_id", text_key(F.col("line"))), "headers")
    distinct = headers.groupBy("line_id").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    distinct = materialized(distinct, "distinct-headers")
    found = materialized(scored(distinct.select("line_id", "line"), idf, made, threshold), "scored-headers")
    marked = spread_join(
        headers.select("text_id", "line_no", "line_id"), found, "line_id", distinct.select("line_id", "n"), F.xxhash64("text_id", "line_no")
    )
    order = F.struct((-F.col("similarity")).alias("s"), "line_no", "license")
    own = marked.groupBy("text_id").agg(F.min(order).alias("best"), F.min(F.when(F.col("line_no") == 0, order)).alias("top"))
    own = materialized(own.withColumnRenamed("text_id", text_id), "own-licenses")
    copies = tagged.join(own.select(text_id), text_id, "left_semi").groupBy(text_id).agg(F.count("*").alias("n"))
    rows = tagged.drop("text").select("path", text_id, directory)
    licensed = spread_join(rows, own, text_id, copies, F.xxhash64("path"))
    used = F.when(stands, F.col("best"))
    used = F.coalesce(used, F.col("top")) if first_line else used
    standing = licensed.withColumn("used", used).where(F.col("used").isNotNull() & F.col(directory).isNotNull())
    standing = standing.groupBy(F.col(directory).alias("above")).agg(
        F.min(F.struct(F.col("used.s").alias("s"), "path", F.col("used.license").alias("license"))).alias("given")
    )
    sizes = materialized(tagged.where(F.col(directory).isNotNull()).groupBy(directory).agg(F.count("*").alias("n")), "directories")
    above = sizes.select(directory, F.posexplode(ancestors(F.col(directory))).alias("steps", "above"))
    below = above.groupBy("above").agg(F.count("*").alias("n"))
    given = spread_join(above, standing, "above", below, F.xxhash64(directory))
    given = given.groupBy(directory).agg(F.min(F.struct("steps", "given")).alias("near"))
    given = materialized(given.select(directory, F.col("near.given").alias("given")), "given-licenses")
    out = spread_join(tagged, own.drop("top"), text_id, copies, F.xxhash64("path"), "left")
    out = spread_join(out, given, directory, sizes, F.xxhash64("path", text_id), "left")
    mine = F.col("best").isNotNull()
    return out.select(
        *files.columns,
        F.coalesce("best.license", "given.license").alias("license"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").alias("license_origin"),
        (-F.coalesce("best.s", "given.s")).alias("license_similarity"),
        F.when(~mine, F.col("given.path")).alias("license_from"),
    )
