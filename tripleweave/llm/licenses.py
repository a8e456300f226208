"""License scans: TF-IDF cosines of notices to license templates, then inheritance from the nearest ancestor directory.

A file's notices are its lines with a license cue and, around every cue word, the windows of words over which a template lies
if their cue words meet; windows run over line ends, comment marks and the rest of a longer line.  Each notice is a sparse
TF-IDF vector, and so is each template; document frequencies of terms are those of all files.  SPDX tags name a license
themselves.  The best template
at or above the threshold is the file's own license.  License files are files with a name like LICENSE, or files that are
little more than a notice.  A file without its own license takes that of the license file in the nearest directory on its
path.  Everything is joins and aggregates; the templates are a parameter and the only broadcast side.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored, text_column

#: License and the texts of its notices.  A parameter.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: Titles of license files and headers that the scan looks for besides the templates.  A parameter.
HEADERS: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International Public License"),
)
SPDX = r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9][A-Za-z0-9.+-]*)"
CUE_TERM = re.compile(r"(licen[sc].*|copyright|rights|domain|permission)")
CUE = r"([Ll]icen[sc]|LICENSE|[Cc]opyright|COPYRIGHT|[Rr]ights reserved|[Pp]ublic domain|SPDX|[Pp]ermission is hereby granted)"
LICENSE_NAME = r"(^|/)(LICEN[SC]E|COPYING|NOTICE|UNLICENSE)([.-][A-Za-z0-9.-]*)?$"
TERM = r"[a-z0-9]+"


def template_weights(templates: Sequence[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, license, term, normed weight) rows, the idf of each term, and the idf of all other terms."""
    terms = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    spread = Counter(t for c in terms for t in c)
    idf = {t: 1 + math.log((1 + len(terms)) / (1 + n)) for t, n in spread.items()}
    rows = []
    for i, ((name, _), counts) in enumerate(zip(templates, terms)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(counts.items())]
    return rows, idf, 1 + math.log(1 + len(terms))


def _folders(path: Column) -> Column:
    """All directories above a path, from the nearest to the root, which is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def _windows(files: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(file, notice): the words over which a template lies if one of its cue words is laid on an equal one of the file.

    ``files`` has (file, words).  Around each cue word only as many words are taken as the longest template has."""
    anchors = set()
    for _, text in templates:
        terms = re.findall(TERM, text.lower())
        anchors |= {(t, i, len(terms)) for i, t in enumerate(terms) if CUE_TERM.fullmatch(t)}
    reach = max(n for _, _, n in anchors)
    known = F.broadcast(files.sparkSession.createDataFrame(sorted(anchors), "term string, before int, length int"))
    cues = sorted({t for t, _, _ in anchors})

    def context(word: Column, i: Column) -> Column:
        start = F.greatest(i + 1 - reach, F.lit(1))
        return F.when(word.isin(cues), F.struct(word.alias("term"), (i + 2 - start).alias("at"), F.slice("words", start, 2 * reach).alias("near")))

    found = files.select("file", F.explode(F.filter(F.transform("words", context), lambda c: c.isNotNull())).alias("cue"))
    found = found.select("file", "cue.*").join(known, "term").withColumn("from", F.col("at") - F.col("before"))
    begin = F.greatest(F.col("from"), F.lit(1))
    return found.select("file", F.concat_ws(" ", F.slice("near", begin, F.col("length") + F.col("from") - begin)).alias("notice"))


def own_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8,
                 headers: Sequence[tuple[str, str]] = HEADERS) -> DataFrame:
    """(file, license, score) of the files with a notice at or above the threshold; ties go to the first license by name.

    ``files`` has (file, text).  Notices of many files weigh the same, so equal ones are scored once.  An SPDX tag scores 1."""
    spark, texts = files.sparkSession, [*templates, *headers]
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)
    spread = stored(files.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_files")), "spread")
    idf = 1 + F.log(F.lit(1.0 + files.count()) / (1 + F.coalesce("n_files", F.lit(0))))
    counts = [(i, name, t, n) for i, (name, text) in enumerate(texts) for t, n in sorted(Counter(re.findall(TERM, text.lower())).items())]
    weights = (F.broadcast(spark.createDataFrame(counts, "template int, license string, term string, n int")).join(spread, "term", "left")
               .select("template", "license", "term", (F.col("n") * idf).alias("weight")))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    weights = F.broadcast(stored(weights.withColumn("weight", F.col("weight") / norm), "weights"))  # a row for each term of a template
    cued = stored(files.where(F.col("text").rlike(CUE)).select("file", "text", words.alias("words")), "cued")
    lines = cued.select("file", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))).alias("notice"))
    notices = stored(lines.unionAll(_windows(cued, texts)).distinct(), "notices")
    terms = (notices.select("notice").distinct()
             .select("notice", F.explode(F.regexp_extract_all(F.lower("notice"), F.lit(TERM), 0)).alias("term"))
             .groupBy("notice", "term").agg(F.count(F.lit(1)).alias("n"))
             .join(spread, "term", "left").select("notice", "term", (F.col("n") * idf).alias("weight_here")))
    terms = stored(terms, "terms")
    norms = terms.groupBy("notice").agg(F.sqrt(F.sum(F.col("weight_here") * F.col("weight_here"))).alias("norm"))
    dots = terms.join(weights, "term").groupBy("notice", "template", "license").agg(F.sum(F.col("weight_here") * F.col("weight")).alias("dot"))
    best = (dots.join(norms, "notice").select("notice", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
            .where(F.col("score") >= threshold)
            .groupBy("notice").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best")))
    tags = cued.select("file", F.explode(F.regexp_extract_all("text", F.lit(SPDX), 1)).alias("license")).select(
        "file", F.struct(F.lit(-1.0).alias("less"), F.regexp_replace("license", r"(-only|-or-later|[+])$", "").alias("license")).alias("best"))
    return (notices.join(stored(best, "best"), "notice").select("file", "best").unionAll(tags)
            .groupBy("file").agg(F.min("best").alias("best"))
            .select("file", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score")))


def scan_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8,
                  short: int = 25, file_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(file_id, path, license, score, origin, license_path) per row of ``files``; ids name files and are unique.

    origin is ``own``, ``inherited`` or ``none``; license_path is the file whose notice holds.  A file with an own license
    and a name like LICENSE, or with ``short`` words at most, is a license file; of several in a directory the least path
    (then id) counts.  Null texts are empty, a null path lies in no directory, and rows with a null id have origin
    ``none``; repeated rows stay; an empty table gives an empty one."""
    rows = picked(files, file=file_id, path=path, text=text).withColumn("text", text_column("text"))
    own = stored(own_licenses(rows.where("file is not null").select("file", "text"), templates, threshold), "own")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    slim = rows.select("file", "path", (words <= short).alias("slim"))
    marked = stored(slim.join(own, "file", "left").withColumn("folder", F.get(_folders(F.col("path")), F.lit(0))), "marked")
    holders = (marked.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("slim") | F.col("path").rlike(LICENSE_NAME)))
               .groupBy("folder").agg(F.min(F.struct("path", "file", "license", "score")).alias("holder")))
    folders = marked.where(F.col("license").isNull() & F.col("folder").isNotNull()).select("folder").distinct()
    above = folders.select("folder", F.posexplode(F.concat(_folders(F.concat("folder", F.lit("/x"))), F.array(F.lit("")))).alias("up", "holder_folder"))
    nearest = stored(above.join(holders.withColumnRenamed("folder", "holder_folder"), "holder_folder")
                     .groupBy("folder").agg(F.min(F.struct("up", "holder")).alias("near"))
                     .select("folder", F.col("near.holder.license").alias("from_license"),
                             F.col("near.holder.score").alias("from_score"), F.col("near.holder.path").alias("from_path")), "nearest")
    has = F.col("license").isNotNull()
    return marked.join(nearest, "folder", "left").select(
        F.col("file").alias("doc_id"), "path", F.coalesce("license", "from_license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("from_score")).alias("score"),
        F.when(has, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("from_path")).alias("license_path"))
