"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame expressions and joins only. What is compared are units: sentences or lines that speak of a licence, and the whole text of files that
are named like a licence. Equal units are scored once, however many files share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, few, shielded

# SPDX identifiers and notices that name the licence, one line each.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("BSD-2-Clause", "Released under the 2-clause BSD License, also called the Simplified BSD License."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License, also called the New BSD License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, under the ISC License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "Copyright, all rights reserved; no licence is granted."),
]
#: A unit has one of these.
TRIGGER = r"(?i)licen[sc]|copyright|all rights reserved|redistribut|permission (?:is hereby granted|to use)|SPDX"
#: Base names of files whose licence holds for their directory; a path that ends in a slash is a directory's own page.
NAMED = r"(?i)(?:^|/)(?:licen[sc]es?|copying(?:\.lesser)?|copyright|unlicense|notice)(?:[.-][a-z0-9.+-]*)?$"
_GOVERNS = rf"{NAMED}|/$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]++(?:-[\p{L}]++)*+|\d++(?:\.\d++)*+)"), F.lit(1))


def units(text: Column, whole: Column) -> Column:
    """Sentences and lines that speak of a licence, blanks collapsed, sentences also over the lines of a paragraph and without marks of comments; and the whole
    text where ``whole``."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"(?m)^[ \t]*+(?:/\*++|\*++/?|//++|#++|;++|--++|<!--)?+[ \t]*+", "")
    both = F.concat_ws("\n", t, F.regexp_replace(bare, r"(?<!\n)\n(?!\n)", " "))
    parts = F.filter(F.split(both, r"\n|(?<=[.!?])\s+|\s\|\s"), lambda s: s.rlike(TRIGGER))
    clean = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    found = F.when(t.rlike(TRIGGER), F.transform(parts, clean)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, F.when(whole & (F.length(F.trim(t)) > 0), F.array(clean(t))).otherwise(F.array().cast("array<string>"))))


def score(found: DataFrame) -> DataFrame:
    """For each distinct ``unit``: licence and score, its best template's; ties to the first template.

    A term weighs (1 + ln tf) * idf, idf counted over all units; the template's terms are the vocabulary, any other term weighs as one that
    is everywhere (idf 1). Templates are a fixed table, broadcast.
    """
    spark = found.sparkSession
    texts = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    tf = texts.select("template", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("n"))
    vocabulary = F.broadcast(tf.select("term").distinct())
    all_terms = durable(found.select("unit", F.explode(terms(F.col("unit"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n")))
    n = found.agg(F.count("*").alias("_n"))
    seen = all_terms.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("_df"))
    idf = tf.select("term").distinct().join(seen, "term", "left").crossJoin(n).select("term", (F.ln((F.col("_n") + 1) / (F.coalesce("_df", F.lit(0)) + 1)) + 1).alias("idf"))
    idf = durable(idf.coalesce(1))  # one row for each term of the templates
    weight = (1 + F.ln("n")) * F.coalesce("idf", F.lit(1.0))
    sides = tf.join(F.broadcast(idf), "term").select("template", F.col("term").alias("_term"), weight.alias("_w"))
    norms = sides.groupBy(F.col("template").alias("_t")).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    mine = all_terms.join(F.broadcast(idf), "term", "left").select("unit", "term", weight.alias("w"))
    lengths = mine.groupBy(F.col("unit").alias("_unit")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    dots = mine.join(F.broadcast(sides), F.col("term") == F.col("_term")).groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("_w")).alias("_dot"))
    near = dots.join(F.broadcast(norms), F.col("template") == F.col("_t")).select("unit", "template", (F.col("_dot") / F.col("_norm")).alias("_s"))
    best = near.groupBy("unit").agg(F.max(F.struct(F.round("_s", 9).alias("s"), (-F.col("template")).alias("t"))).alias("_b"))
    made = best.join(lengths, F.col("unit") == F.col("_unit")).select("unit", (-F.col("_b.t")).alias("_t"), (F.col("_b.s") / F.col("_length")).alias("score"))
    return made.join(F.broadcast(texts.select("template", "licence")), F.col("_t") == F.col("template")).select("unit", "licence", "score")


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None, least: float = 0.6) -> DataFrame:
    """Columns ``keep`` (all but the text, unless given) of ``files``, licence, score, and licence_path.

    A file's licence is that of its best unit with a cosine of at least ``least``; licence_path is its own path then. A file without one inherits from the
    nearest ancestor directory, its own first, that holds a licence file or page with a licence; of several there the best score, then the smallest
    name. Else all three are null. Null and empty texts have no unit; a null path has no directory. Rows may repeat. Texts are not shuffled, units are.
    """
    keep = [c for c in files.columns if c != text] if keep is None else keep
    files, _, to = shielded(files)
    p, t = F.col(to[path]), F.col(to[text])
    named = F.coalesce(p.rlike(NAMED), F.lit(False))
    rows = durable(files.select(*[F.col(to[c]).alias(f"k_{i}") for i, c in enumerate(keep)], p.alias("_path"), units(t, named).alias("_units")))
    own = rows.where(F.size("_units") > 0).withColumn("_of", F.sha2(F.concat_ws("\n", "_units"), 256))
    sets = durable(own.groupBy("_of").agg(F.first("_units").alias("_units")))  # equal lists, whichever comes first
    scored = score(durable(sets.select(F.explode("_units").alias("unit")).distinct())).where(F.col("score") >= least)
    parts = sets.select("_of", F.explode("_units").alias("_unit"))
    best = parts.join(scored, F.col("_unit") == F.col("unit")).groupBy("_of").agg(F.max(F.struct("score", "licence")).alias("_best"))
    best = durable(best.select(F.col("_of").alias("_key"), F.col("_best.licence").alias("licence"), F.col("_best.score").alias("score")))
    # Rows without a unit, mostly nearly all, take no part in the join: their null keys would meet in one task.
    known = few(rows.where(F.size("_units") > 0).withColumn("_of", F.sha2(F.concat_ws("\n", "_units"), 256)).drop("_units"), best, F.col("_of") == F.col("_key"), "left").drop("_of", "_key")
    bare = rows.where(F.size("_units") <= 0).drop("_units").withColumn("licence", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    marked = durable(known.unionByName(bare))
    directory = F.regexp_replace("_path", r"/?[^/]*$", "")
    dirs = marked.where(F.col("licence").isNotNull() & F.col("_path").rlike(_GOVERNS)).select(directory.alias("_dir"), "licence", "score", "_path")
    dirs = dirs.groupBy("_dir").agg(F.max(F.struct("score", "licence", "_path")).alias("_from"))
    # Each directory that lacks files' licences once, with its ancestors; not each file.
    steps = F.split(F.col("_dir"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("up")))
    lacking = marked.where(F.col("licence").isNull() & F.col("_path").isNotNull()).select(directory.alias("_dir")).distinct()
    chain = lacking.select(F.col("_dir").alias("_below"), F.explode(above).alias("_a")).select("_below", "_a.depth", "_a.up")
    heirs = chain.join(dirs, F.col("up") == F.col("_dir")).groupBy("_below").agg(F.max(F.struct("depth", "_from")).alias("_got")).select("_below", F.col("_got._from").alias("_from"))
    heirs = durable(heirs)
    # So do those with a licence; directories, few for many files, are broadcast as long as they are few.
    asks = F.col("licence").isNull() & F.col("_path").isNotNull()
    heir = few(marked.where(asks).withColumn("_at", directory), heirs, F.col("_at") == F.col("_below"), "left").drop("_at", "_below")
    joined = heir.unionByName(marked.where(~asks).withColumn("_from", F.lit(None).cast(heirs.schema["_from"].dataType)))
    own_path = F.when(F.col("licence").isNotNull(), F.col("_path"))
    return joined.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("licence", "_from.licence").alias("licence"), F.coalesce("score", "_from.score").alias("score"), F.coalesce(own_path, F.col("_from._path")).alias("licence_path"),
    )


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags part lines."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", "\n")


def page_path(url: Column) -> Column:
    """Host and path of a URL, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
