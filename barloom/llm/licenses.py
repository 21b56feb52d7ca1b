"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import words
from barloom.operators.ordered import settle

COSINE = 0.75                       # similarity from which a notice names a licence
FILE_WORDS = 60                     # a text with a notice and at most so many words is a licence file
#: Licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted (BSD 3-Clause License)",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Headers as they stand in source files, and heads of licence files.
TEMPLATES |= {
    "MIT-head": "The MIT License (MIT)",
    "Apache-2.0-block": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                        "You may obtain a copy of the License at",
    "Apache-2.0-head": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-head": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-block": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-head": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                       "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                       "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                       "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-head": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD-3-Clause-head": "BSD 3-Clause License",
    "BSD-2-Clause-head": "BSD 2-Clause License",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0-head": "Mozilla Public License Version 2.0",
}
#: Whole licence texts.
TEMPLATES |= {f.name.removesuffix(".txt") + "-file": f.read_text("utf-8") for f in sorted(resources.files("barloom.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name)}
NOTICE = r"(?i)licen[cs]e|copyright|copyleft|spdx|public domain|redistribut|free of charge|all rights reserved"
BLANK = r"\n[^\p{L}\p{N}\n]*\n"      # between blocks: a line without letters and digits, also inside a comment
WRAP = r"[^\S\n]*\n[^\p{L}\p{N}\n]*"  # between the lines of a block, with the marks of a comment
SPDX = r"(?i:SPDX-License-Identifier:)[ \t]*(\(*[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*)*)"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.+-]*[\p{L}\p{N}]|[\p{L}\p{N}]"


def licence_of(template: str) -> str:
    return re.sub("-(line|header|block|head|file)$", "", template)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def frequencies(docs: DataFrame, terms: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, dict[str, int], int]:
    """Documents of each token of ``terms`` and of all, over whole texts; those of ``vocabulary`` are collected too."""
    wanted = terms.select("token").distinct()
    counts = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    known = settle(counts.join(wanted.unionByName(docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string")).distinct(), "token", "left_semi"))
    return known, dict(known.filter(F.col("token").isin(vocabulary)).collect()), docs.count()


def own_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """``path``, ``licence`` and ``score`` of the best notice of each file that has one.

    Notices are the parts of texts that have a licence word: sentences and lines, blocks between blank lines with their wrapped
    lines joined, the sentences of those, and the whole text; equal ones are compared once.  An SPDX identifier names its licence
    outright, an expression as it is written, without ``-only`` and ``-or-later``.
    Notices and templates are weighed by the document frequencies of all their words, so scores do not depend on
    the size of the corpus.
    """
    blocks = F.transform(F.filter(F.split("text", BLANK), lambda p: p.rlike(NOTICE)), lambda p: F.regexp_replace(p, WRAP, " "))
    sentences = F.flatten(F.transform(blocks, lambda p: F.split(p, r"(?<=[.!?])\s+")))
    pieces = F.filter(F.concat(F.split("text", r"\n+|(?<=[.!?])\s+"), blocks, sentences, F.array("text")), lambda p: p.rlike(NOTICE))
    marked = files.filter(F.col("text").rlike(NOTICE))
    notices = marked.select("path", F.explode(F.array_distinct(pieces)).alias("notice"))
    named = marked.select("path", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("licence"))
    named = named.select("path", F.struct(F.lit(1.0).alias("score"), F.concat(F.regexp_replace("licence", "-(only|or-later)(?![A-Za-z0-9.+-])", ""), F.lit("\tSPDX")).alias("template")).alias("b"))
    notices = settle(notices.select("path", F.md5(F.col("notice").cast("binary")).alias("id"), "notice"))
    once = notices.groupBy("id").agg(F.any_value("notice").alias("notice"))
    # Written tables, so that the join by token is of plain exchanges and a hot word can be split.
    terms = settle(once.select("id", F.explode(tokens(F.col("notice"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf")))
    texts = files.sparkSession.createDataFrame([(licence_of(k) + "\t" + k, v) for k, v in templates.items()], "template string, text string")
    words_of = [tuple(r) for r in texts.select("template", F.explode(tokens(F.col("text"))).alias("token")).groupBy("template", "token").agg(F.count("*").alias("tf")).collect()]
    vocabulary = sorted({t for _, t, _ in words_of})                 # bounded by the templates
    known, counted, total = frequencies(files, terms, vocabulary)
    idf = {t: math.log((1 + total) / (1 + counted.get(t, 0))) + 1 for t in vocabulary}
    norm: dict[str, float] = {}
    for template, token, tf in words_of:
        norm[template] = norm.get(template, 0.0) + (tf * idf[token]) ** 2
    table = files.sparkSession.createDataFrame([(k, t, tf * idf[t] / math.sqrt(norm[k])) for k, t, tf in sorted(words_of)], "template string, token string, weight double")
    weighed = terms.join(known, "token", "left").select("id", "token", (F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1)).alias("x"))
    weighed = settle(weighed)
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(table), "token").groupBy("id", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    best = (dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= cosine)
            .groupBy("id").agg(F.max(F.struct("score", "template")).alias("b")))
    return (notices.join(best, "id").select("path", "b").unionByName(named).groupBy("path").agg(F.max("b").alias("b"))
            .select("path", F.substring_index("b.template", "\t", 1).alias("licence"), "b.score"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE, file_words: int = FILE_WORDS) -> DataFrame:
    """``row`` of every input row with ``own``, ``score``, ``licence``, ``basis`` and ``given_by``.

    A file's own notice counts first; else the licence file of its directory or of the nearest ancestor that has one, its best
    notice, of equally good ones that of the smallest path.  A licence file is named LICENSE, LICENCE, COPYING or
    NOTICE, or has a notice and at most ``file_words`` words.  Directories are joined by path: each distinct
    directory meets its ancestors, then the files their directory.  NULL and empty texts have no notice, NULL paths
    no directory, repeated rows stay, an empty table gives none, and other columns pass in ``row``.
    """
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|notice)\b")
    small = F.size(words(F.col("text"))) <= file_words
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), F.col("path"), directory(F.col("path")).alias("dir"))
    own = settle(own_licences(files.select("path", "text"), templates, cosine))
    short = files.filter(named | small).select("path").distinct()
    giving = (own.join(short, "path", "left_semi").groupBy(directory(F.col("path")).alias("dir"))
              .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("g")).select("dir", "g.licence", "g.path"))
    parts = F.split("dir", "/")
    above = (files.select(directory(F.col("path")).alias("dir")).filter("dir is not null").distinct()
             .select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up")))
    nearest = (above.join(giving.select(F.col("dir").alias("up"), F.col("licence").alias("inherited"), F.col("path").alias("giver")), "up")
               .groupBy("dir").agg(F.max_by(F.struct("inherited", "giver"), F.length("up")).alias("n")).select("dir", "n.*"))
    joined = rows.join(own, "path", "left").join(nearest, "dir", "left")
    basis = F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return joined.select("row", F.col("licence").alias("own"), "score", F.coalesce("licence", "inherited").alias("licence"), basis.alias("basis"),
                         F.when(F.col("licence").isNull(), F.col("giver")).alias("given_by"))


def document_path(doc_id: Column, source: Column) -> Column:
    """A path for a document: the digits of its id as directories under its source, so low ids lie near the root."""
    digits = F.regexp_replace(F.coalesce(doc_id.cast("string"), F.lit("none")), "(?<=.)(?=.)", "/")
    return F.concat(F.coalesce(source, F.lit("none")), F.lit("/"), digits, F.lit(".txt"))
