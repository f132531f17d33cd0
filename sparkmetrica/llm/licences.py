"""Licence scan of files: TF-IDF cosine to licence templates, and inheritance from the nearest directory above.

DataFrame functions only. Every line, sentence and paragraph of a file (a text without a blank line is one paragraph) is a sparse TF-IDF vector over its
words; its words' document frequencies are counted exactly over all files, for units that can reach the threshold at all: a table
of a fixed number of word buckets, counted first, bounds every cosine from above. A file's own licence is that of the template nearest to any of these units, if the
cosine reaches the threshold. Related licences share most of their words, so a template counts only where the words that tell its licence apart
(version, clauses, "lesser", "nc") are in the unit as in the template, and none that would make it another licence. A licence file is one whose whole text
is that near to a template, or whose name says so. A file without a licence of its own inherits that of the licence file in its
directory or the nearest directory above. The opening paragraph that licences of two and three clauses have in common is taken for that of three.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.session import settle

THRESHOLD = 0.6
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"

# Notices by which files state their licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]

# Words that tell a licence from its relatives (needed where the template has them), and words it can't have.
TELLING = {
    "AGPL-3.0": ("affero agpl 3", "lesser lgpl"),
    "Apache-2.0": ("apache 2", ""),
    "BSD-2-Clause": ("bsd 2", ""),
    "BSD-3-Clause": ("bsd 3", ""),
    "CC-BY-4.0": ("cc by attribution 4", "nc noncommercial sa sharealike nd noderivatives"),
    "CC-BY-NC-4.0": ("cc by nc noncommercial 4", "sa sharealike nd noderivatives"),
    "GPL-2.0": ("gpl general 2", "lesser library affero lgpl agpl"),
    "GPL-3.0": ("gpl general 3", "lesser library affero lgpl agpl"),
    "ISC": ("isc", ""),
    "LGPL-2.1": ("lgpl lesser 2 1", "affero agpl"),
    "LGPL-3.0": ("lgpl lesser 3", "affero agpl"),
    "MIT": ("mit", ""),
    "MPL-2.0": ("mozilla mpl 2", ""),
}
BUCKETS = 1 << 14  # of words, for bounds on their frequencies
STEPS = 4  # to which those bounds are rounded down, for each unit of the logarithm
SALTS = 16  # parts of a word that many units hold, when its frequency is looked up


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def buckets_of(words: Column) -> Column:
    return F.array_distinct(F.transform(words, bucket))


def byte_at(data: Column, place: Column) -> Column:
    """A byte below 128 of a binary value."""
    return F.ascii(F.substring(data, place + 1, 1).cast("string"))


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def template_words(templates=TEMPLATES) -> list[Counter]:
    return [Counter(re.findall(r"[a-z0-9]+", t.lower())) for _, t in templates]


def rules(templates=TEMPLATES, telling=TELLING) -> list[tuple[list[str], list[str]]]:
    """Words a unit must have and must not have, for each template."""
    out = []
    for (name, _), words in zip(templates, template_words(templates), strict=True):
        needs, bars = (v.split() for v in telling.get(name, ("", "")))
        out.append(([w for w in needs if w in words], bars))
    return out


def words_that_matter(vectors: list[dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which a text must have one to reach the threshold with any template.

    A text whose words in common with a template all belong to a set of small weight has a cosine of at most the
    length of the template's vector on that set, so the most common words are left out while that stays below the threshold.
    """
    common: set[str] = set()
    for w in sorted(idf, key=lambda w: (idf[w], w)):
        if any(math.sqrt(sum(v[x] ** 2 for x in v if x in common or x == w)) >= threshold - 1e-6 for v in vectors):
            continue
        common.add(w)
    return sorted(set(idf) - common)


def scan(
    files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES, telling=TELLING
) -> DataFrame:
    """``(id, path, licence, similarity, inherited, licence_dir)`` for every row of ``files``.

    ``licence`` is NULL where there is none; ``similarity`` is the cosine of the file's own notice, rounded to 9 places, NULL if inherited.
    NULL and empty texts have no notice; a NULL path has no directory and inherits nothing. Of two licence files in a directory the nearer to its template
    counts, then the one with the smaller path. Repeated rows get equal answers. Paths use ``/``. ``templates`` are pairs of licence and notice, any
    number per licence, full texts too; ``telling`` gives per licence the words it needs and the words it can't have.
    """
    counts = template_words(templates)
    vocabulary = sorted(set().union(*counts))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    lit = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    # In how many files each template word occurs, and each bucket of all words; "" counts the files.
    named = F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: w.isin(vocabulary))
    keys = F.concat(F.array(F.lit("")), named, F.transform(buckets_of(tokens(F.col("text"))), lambda b: F.concat(F.lit("#"), b.cast("string"))))
    held = rows.where("text IS NOT NULL").select(F.explode(keys).alias("key")).groupBy("key").count()
    seen = {r[0]: r[1] for r in held.collect()}  # at most BUCKETS and as many as the templates have words
    total = seen.get("", 0)
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}
    vectors = []
    for c in counts:
        v = {w: n * idf[w] for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({w: x / length for w, x in v.items()})
    needed = lit(words_that_matter(vectors, idf, threshold))
    ruled = rules(templates, telling)
    told = sorted({w for r in ruled for words in r for w in words})

    def fits(i: int, words: Column) -> Column:
        needs, bars = ruled[i]
        out = ~F.arrays_overlap(words, lit(bars)) if bars else F.lit(True)
        for w in needs:
            out = out & F.array_contains(words, w)
        return out

    # No word of a bucket is in more files than the bucket, which bounds the length of a unit from below and its cosine from above.
    floors = F.lit(bytearray(min(127, int(STEPS * math.log((total + 1) / (seen.get(f"#{b}", 0) + 1)))) for b in range(BUCKETS)))
    floor = lambda w: byte_at(floors, bucket(w)) / float(STEPS)
    parts_of = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.array(*[F.lit(idf[w] * v.get(w, 0.0)) for v in vectors]))])

    def may_reach(words: Column) -> Column:
        """Whether a unit of these words can be as near as the threshold to a template whose rules it keeps."""
        zero = F.array(*[F.lit(0.0)] * len(templates))
        dots = F.aggregate(F.filter(words, lambda w: w.isin(vocabulary)), zero, lambda sums, w: F.zip_with(sums, F.element_at(parts_of, w), lambda x, y: x + y))
        length = F.sqrt(F.aggregate(words, F.lit(0.0), lambda sums, w: sums + floor(w) * floor(w)))
        some = lambda d, least, have: reduce(or_, [(F.get(d, F.lit(i)) >= least) & fits(i, have) for i in range(len(templates))])
        near = bound(dots, lambda d: bound(length * (threshold - 1e-6), lambda least: bound(F.array_intersect(words, lit(told)), lambda have: some(d, least, have))))
        return F.when(F.arrays_overlap(words, needed), near).otherwise(F.lit(False))

    near = rows.where(F.arrays_overlap(tokens(F.col("text")), needed)).select(F.xxhash64("id", "path", "text").alias("row"), "path", "text")
    split = lambda kind, cut: bound(F.split("text", cut), lambda found: F.transform(found, lambda part, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), part.alias("part"), F.size(found).alias("parts"))))
    units = near.select("row", "path", F.inline(F.concat(split("line", r"\n"), split("sentence", r"[.;]\s+"), split("paragraph", r"\n\s*\n"))))
    units = units.where(bound(tokens(F.col("part")), may_reach))
    word_counts = settle(units.select("row", "path", "kind", "unit", "parts", F.explode(tokens(F.col("part"))).alias("word")).groupBy("row", "path", "kind", "unit", "parts", "word").count())
    # Exact frequencies of the words of those units, over all files; words of other buckets end where they are read.
    wanted = word_counts.select("word").distinct()
    flags = bytearray(BUCKETS)
    for r in wanted.select(bucket(F.col("word"))).distinct().collect():  # at most BUCKETS
        flags[r[0]] = 1
    asked = F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: byte_at(F.lit(flags), bucket(w)) == 1)
    held = settle(rows.select(F.explode(asked).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files")).join(wanted, "word", "left_semi"))
    # Words that many units hold are looked up in parts, so that none gathers in one task.
    spread = held.select("word", F.log(F.lit(float(total + 1)) / (F.col("files") + 1)).alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    weighed = word_counts.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["word", "salt"])
    on = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.array(*[F.lit(v.get(w, 0.0)) for v in vectors]))])
    weight = F.col("count") * F.col("idf")
    weighed = weighed.select("row", "path", "kind", "unit", "parts", "word", weight.alias("weight"), on[F.col("word")].alias("on"))
    dots = [F.sum(F.col("weight") * F.coalesce(F.get("on", F.lit(i)), F.lit(0.0))).alias(f"t{i}") for i in range(len(templates))]
    scored = weighed.groupBy("row", "path", "kind", "unit", "parts").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"), F.collect_set(F.when(F.col("word").isin(told), F.col("word"))).alias("told"), *dots
    )

    def likeness(i: int, name: str) -> Column:
        return F.when(fits(i, F.col("told")), F.struct(F.round(F.try_divide(F.col(f"t{i}"), F.col("length")), 9).alias("similarity"), F.lit(name).alias("licence")))

    best = F.array_max(F.array(*[likeness(i, name) for i, (name, _) in enumerate(templates)]))
    found = scored.select("row", "path", "kind", "parts", best.alias("best")).where(F.col("best.similarity") >= threshold)
    own = found.groupBy("row", "path").agg(
        F.max("best").alias("best"), F.max(F.when((F.col("kind") == "paragraph") & (F.col("parts") == 1), F.lit(True))).alias("whole")
    )

    parent = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    licence_files = own.where(F.col("whole") | F.col("path").rlike(FILE_NAME)).where("path IS NOT NULL")
    by_dir = licence_files.groupBy(parent(F.col("path")).alias("licence_dir")).agg(F.min(F.struct(-F.col("best.similarity"), "path", F.col("best.licence").alias("licence"))).alias("first"))
    by_dir = by_dir.select("licence_dir", F.col("first.licence").alias("from_dir"))
    # One row per directory, then one per directory and directory above it.
    dirs = rows.where("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.concat_ws("/", F.slice(steps, 1, i)).alias("licence_dir")))
    over = dirs.select("dir", F.inline(F.array_distinct(above))).join(by_dir, "licence_dir")
    nearest = over.groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "from_dir")).alias("nearest"))

    keyed = rows.select("id", "path", F.xxhash64("id", "path", "text").alias("row"), parent(F.col("path")).alias("dir"))
    both = keyed.join(own.select("row", "best"), "row", "left").join(nearest, "dir", "left")
    has = F.col("best").isNotNull()
    return both.select(
        "id", "path", F.when(has, F.col("best.licence")).otherwise(F.col("nearest.from_dir")).alias("licence"), F.col("best.similarity").alias("similarity"),
        (~has & F.col("nearest").isNotNull()).alias("inherited"), F.when(~has, F.col("nearest.licence_dir")).alias("licence_dir"),
    )
