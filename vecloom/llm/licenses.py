"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

The units of a file are its lines, its paragraphs and, for a file named as a licence file or
holding a phrase of a short licence, its whole text. Units that mention a licence, and do not
deny one, are compared to templates as sparse TF-IDF vectors: notices, titles of long licences
and whole short ones. Document frequencies of the templates' terms are counted over all files;
a term of no template counts as one that no file holds. A unit has the licence of its nearest
template among those whose numbers (versions, dates) it holds, if that is near enough and no
template of another licence comes within a margin; else it is unclear. A file has the licence of its best clear unit. A file whose licence lines
make up most of its words is a licence file, and so is one named as such (LICENSE, COPYING).
Its directory's licence holds for all files below without a notice of their own, down to the
next directory with a licence file; one that names no known licence ends the search too.

All of it is DataFrame operations: terms are joined with a broadcast table bounded by the
templates' vocabulary, ancestors are joined by path for directories rather than for files,
and no key gathers more than one file's units or one directory's pre-aggregated best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialise

# Licence identifiers, the wording of short licences and of notices, titles.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:"
)
MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
MIT_WARRANTY = (
    'The software is provided "as is", without warranty of any kind, express or implied, '
    "including but not limited to the warranties of merchantability, fitness for a particular "
    "purpose and noninfringement. In no event shall the authors or copyright holders be liable "
    "for any claim, damages or other liability, whether in an action of contract, tort or "
    "otherwise, arising from, out of or in connection with the software or the use or other "
    "dealings in the software."
)
BSD_SENTENCE = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:"
)
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used "
    "to endorse or promote products derived from this software without specific prior written "
    "permission."
)
BSD_WARRANTY = (
    'This software is provided by the copyright holders and contributors "as is" and any '
    "express or implied warranties, including, but not limited to, the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed. In no event shall the "
    "copyright holder or contributors be liable for any direct, indirect, incidental, special, "
    "exemplary, or consequential damages (including, but not limited to, procurement of "
    "substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or "
    "tort (including negligence or otherwise) arising in any way out of the use of this "
    "software, even if advised of the possibility of such damage."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted"
)
ISC_NOTICE = "the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = (
    'The software is provided "as is" and the author disclaims all warranties with regard to '
    "this software including all implied warranties of merchantability and fitness. In no event "
    "shall the author be liable for any special, direct, indirect, or consequential damages or "
    "any damages whatsoever resulting from loss of use, data or profits, whether in an action of "
    "contract, negligence or other tortious action, arising out of or in connection with the use "
    "or performance of this software."
)
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("BSD-3-Clause", BSD_SENTENCE),
    ("BSD-2-Clause", BSD_SENTENCE),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", MIT_GRANT),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{BSD_SENTENCE} {BSD_CLAUSES} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_SENTENCE} {BSD_CLAUSES} {BSD_NAMES} {BSD_WARRANTY}"),
    ("ISC", f"{ISC_GRANT}, provided that {ISC_NOTICE} {ISC_WARRANTY}"),
    ("0BSD", f"{ISC_GRANT}. {ISC_WARRANTY}"),
]
# Names by which a sentence calls a licence, and those that SPDX has with two suffixes.
CALLED = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"]
SUFFIXED = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
PLAIN = ["Apache-2.0", "MPL-2.0", "CC0-1.0", "0BSD", "Unlicense", "EPL-2.0"]
COMMONS = [
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]


def commons_notices() -> list[tuple[str, str]]:
    out = []
    for short, words in COMMONS:
        for v in ("4.0", "3.0"):
            name = f"CC-{short}-{v}"
            out += [
                (name, f"Licensed under CC {short} {v}."),
                (name, f"This work is licensed under a Creative Commons {words} {v} License."),
                (name, f"Creative Commons {words} {v} International Public License"),
                (name, f"SPDX-License-Identifier: {name}"),
            ]
    return out


def called_notices() -> list[tuple[str, str]]:
    said = ("Licensed under the {} License.", "Released under the {} License.")
    out = [(name, text.format(name)) for name in CALLED for text in said]
    for name in [*CALLED, *PLAIN, *SUFFIXED]:
        out.append((name, f"SPDX-License-Identifier: {name}"))
    for name in SUFFIXED:
        out += [(name, f"SPDX-License-Identifier: {name}-{s}") for s in ("only", "or-later")]
    return out


TEMPLATES = [*NOTICES, *called_notices(), *commons_notices()]

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# A unit without any of these is compared to nothing; every template holds one.
MENTIONS = (
    "licen[sc]|permission is hereby granted|permission to use, copy|redistribut|"
    "creative commons|spdx|cc0"
)
# A unit with one of these says which licence does not hold.
DENIALS = (
    r"(\b(not|never|no longer)|n.t)\s+(\w+\s+){0,2}"
    r"(licen[sc]ed|released|(distributed|available|published)\s+under|(covered|governed)\s+by)"
    r"|\b(do|does|did)\s+not\s+use\b"
)
# The whole text of a file with one of these is a unit; every whole short licence holds one.
WHOLE = "permission is hereby granted|permission to use, copy|redistributions of source"
MIN_COSINE = 0.7
# Lead that the nearest licence needs over the next one.
MARGIN = 0.01
# Share of a file's words in licence lines from which on it is a licence file.
LICENSE_FILE = 0.5
# Names of licence files.
FILE_NAME = (
    "(?i)(^|/)(un)?(licen[sc]e|copying)"
    "([._-](mit|apache|bsd|l?gpl|agpl|mpl|cc|lesser|[0-9])[a-z0-9_-]*([.][0-9]+)*)?"
    "([.](txt|md|markdown|rst|adoc|html?))?$"
)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_terms(df: DataFrame) -> DataFrame:
    """(template, license, term, tf) of TEMPLATES, made by the same expressions."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    made = df.sparkSession.createDataFrame(rows, "template int, license string, text string")
    words = made.select("template", "license", F.explode(terms_of(F.col("text"))).alias("term"))
    return words.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def vocabulary() -> list[str]:
    import re

    return sorted({t for _, text in TEMPLATES for t in re.findall(TERM, text.lower())})


def is_named(path: Column) -> Column:
    return F.coalesce(path.rlike(FILE_NAME), F.lit(False))


def read_units(files: DataFrame) -> DataFrame:
    """One row a file: its path, terms of the vocabulary, number of words, and the units
    that mention a licence and deny none as (terms, is_line). Written, so the texts are read once and rows
    have a lasting number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mentions = lambda u: F.lower(u).rlike(MENTIONS) & ~F.lower(u).rlike(DENIALS)
    lines = F.filter(F.split(text, "\n", -1), mentions)
    # Only paragraphs of more than one line; one of a single line is that line.
    paragraphs = F.filter(
        F.split(text, "\n[ \\t\\r]*\n", -1), lambda u: F.contains(u, F.lit("\n")) & mentions(u)
    )
    unit = lambda is_line: lambda u: F.struct(
        terms_of(u).alias("terms"), F.lit(is_line).alias("is_line")
    )
    asked = is_named(F.col("path")) | F.lower(text).rlike(WHOLE)
    whole = F.filter(F.array(F.when(asked, text)), lambda u: u.isNotNull() & mentions(u))
    units = F.when(
        F.lower(text).rlike(MENTIONS),
        F.concat(
            F.transform(lines, unit(True)),
            F.transform(paragraphs, unit(False)),
            F.transform(whole, unit(False)),
        ),
    )
    known = F.array(*[F.lit(t) for t in vocabulary()])
    words = files.withColumn("__terms", terms_of(text))
    return materialise(
        words.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "path",
            F.array_intersect("__terms", known).alias("known"),
            F.size("__terms").alias("words"),
            units.alias("units"),
        ),
        "units",
    )


def frequencies(files: DataFrame) -> DataFrame:
    """(term, idf) of the vocabulary, with the idf of unknown terms as the null term."""
    total = files.agg(F.count("*").alias("n"))
    counts = files.select(F.explode("known").alias("term")).groupBy("term").agg(
        F.count("*").alias("df")
    )
    spark = files.sparkSession
    every = spark.createDataFrame([(t,) for t in [*vocabulary(), None]], "term string")
    rows = every.join(counts, "term", "left").join(F.broadcast(total))
    idf = F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    return rows.select("term", idf.alias("idf"))


def file_licenses(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(row, license, score, covered) of the files with a notice of their own, from
    read_units; the licence is null where no notice is clear. ``covered`` is the share of
    their words in licence lines."""
    idf = materialise(frequencies(files), "idf")
    unknown = idf.filter("term IS NULL").select(F.col("idf").alias("most"))
    weighed = template_terms(files).join(F.broadcast(idf), "term").select(
        "template", "license", "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    sizes = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    # Numbers tell versions apart, so a unit must hold all numbers of a template.
    number = F.when(F.col("term").rlike("[0-9]"), 1).otherwise(0)
    needs = weighed.groupBy("template").agg(F.sum(number).alias("numbers"))
    sizes = sizes.join(needs, "template")
    found = F.struct("license", "template", (F.col("w") / F.col("size")).alias("w"), "numbers")
    templates = weighed.join(F.broadcast(sizes), "template").groupBy("term").agg(
        F.collect_list(found).alias("found")
    )
    table = idf.filter("term IS NOT NULL").join(templates, "term")
    table = F.broadcast(materialise(table, "templates"))
    units = files.filter(F.size("units") > 0).select(
        "row", "words", F.posexplode("units").alias("unit", "u")
    )
    words = units.select(
        "row", "words", "unit", "u.is_line", F.size("u.terms").alias("length"),
        F.explode("u.terms").alias("term"),
    )
    key = ["row", "unit", "words", "is_line", "length"]
    counts = words.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    placed = counts.join(table, "term", "left").join(F.broadcast(unknown))
    own = F.col("tf") * F.coalesce("idf", "most")
    placed = placed.select(*key, "term", own.alias("w"), "found")
    sizes = placed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    shares = placed.select(*key, "w", number.alias("number"), F.explode("found").alias("t"))
    dots = shares.groupBy(*key, "t.template", "t.license").agg(
        F.sum(F.col("w") * F.col("t.w")).alias("dot"),
        F.sum("number").alias("held"),
        F.max("t.numbers").alias("numbers"),
    ).filter("held = numbers")
    # Rounded, so that equal wordings are equally near whatever the order of sums.
    scored = dots.join(sizes, key).withColumn("score", F.round(F.col("dot") / F.col("size"), 9))
    near = scored.filter(F.col("score") >= min_cosine - MARGIN)
    each = near.groupBy(*key, "license").agg(F.max("score").alias("score"))
    best = each.groupBy(*key).agg(
        F.max_by("license", F.struct("score", "license")).alias("license"),
        F.max("score").alias("score"),
        F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(1)).alias("next"),
    ).filter(F.col("score") >= min_cosine)
    clear = F.coalesce(F.round(F.col("score") - F.col("next"), 9) >= MARGIN, F.lit(True))
    best = best.withColumn("clear", clear).withColumn("license", F.when(clear, F.col("license")))
    inside = F.sum(F.when(F.col("is_line"), F.col("length")).otherwise(0)) / F.max("words")
    return best.groupBy("row").agg(
        F.max_by(F.struct("license", "score"), F.struct("clear", "score", -F.col("unit"))).alias("b"),
        inside.alias("covered"),
    ).select("row", "b.license", "b.score", "covered")


def directory(path: Column) -> Column:
    """The directory of a path; empty for a file at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def directory_licenses(named: DataFrame, license_file: float = LICENSE_FILE) -> DataFrame:
    """(dir, license, from_dir) of every directory of ``named`` (dir, license, score, covered)
    that has a licence file in it or above it; the licence is null if that names none."""
    order = F.struct(
        F.col("license").isNotNull(), "covered", F.coalesce("score", F.lit(0.0)), "license"
    )
    own = named.filter(F.col("covered") >= license_file).groupBy("dir").agg(
        F.max_by("license", order).alias("license")
    )
    own = own.withColumnRenamed("dir", "from_dir")
    dirs = named.select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("from_dir"), n.alias("depth")),
    )
    ancestors = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    # The empty directory is its own only part, so it would come twice.
    ancestors = ancestors.groupBy("dir", "from_dir").agg(F.max("depth").alias("depth"))
    found = ancestors.join(own, "from_dir")
    return found.groupBy("dir").agg(
        F.max_by(F.struct("license", "from_dir"), "depth").alias("a")
    ).select("dir", "a.license", "a.from_dir")


def scan(
    files: DataFrame, min_cosine: float = MIN_COSINE, license_file: float = LICENSE_FILE
) -> DataFrame:
    """(id, path, license, basis, score, from_dir) of every row of ``files`` (id, path, text).

    ``basis`` is 'file' for a licence found in the file, 'directory' for an inherited one,
    'unclear' with a null licence where the file's notices fit two licences alike, and else
    null with a null licence. ``from_dir`` is the directory whose licence file decides, also
    where that names no known licence. Null and empty texts have no notice; a null path
    inherits nothing. Rows that repeat a path are files of their own; an empty table gives none.
    """
    units = read_units(files.select("id", "path", "text"))
    own = file_licenses(units, min_cosine)
    paths = units.select("row", "id", "path", directory(F.col("path")).alias("dir"))
    named = paths.join(own, "row", "left").withColumn(
        # A file named as a licence file is one whatever its lines cover.
        "covered", F.when(is_named(F.col("path")), 1.0).otherwise(F.col("covered"))
    )
    named = materialise(named, "licenses")
    inherited = directory_licenses(named.filter("dir IS NOT NULL"), license_file).select(
        F.col("dir").alias("d"), F.col("license").alias("above"), F.col("from_dir")
    )
    joined = named.join(inherited, F.col("dir") == F.col("d"), "left")
    # Files with a notice of their own, clear or not, inherit nothing.
    has = F.col("score").isNotNull()
    return joined.select(
        "id",
        "path",
        F.when(has, F.col("license")).otherwise(F.col("above")).alias("license"),
        F.when(F.col("license").isNotNull(), "file")
        .when(has, "unclear")
        .when(F.col("above").isNotNull(), "directory")
        .alias("basis"),
        "score",
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )
