"""Licence scan as an exact set-similarity join with containment, in SQL functions alone.

A paragraph is a run of lines without a blank line between; one of more than PIECE_WORDS words is cut into pieces of so many, which count as
paragraphs, so a block is never much longer than a notice and words that lie far apart prove nothing. A text block is a run of up to
PARAGRAPHS neighbouring paragraphs. It matches a template if the block's words hold at least THRESHOLD of the template's distinct words, all
of its key words, none of the words that belong to a sister licence, and no shorter block within it does. A short notice of common words also needs
its naming words side by side in the document: a bag of seven or thirteen words is met by prose. Identifiers of the form
`SPDX-License-Identifier: BSD-3-Clause` give the label of their licence.

Words of templates are ordered by their frequency over the blocks of all documents,
rarest first. A block that meets the threshold must hold a word of the template's prefix (its n - needed + 1 rarest words), must
have enough template words at all (length filter), and after the first common word both must have enough left (positional filter);
candidates that pass all three are confirmed on whole sets. Only words of templates can be shared, so blocks keep no others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_row_id

THRESHOLD = 0.8
#: In its published layout no notice of TEMPLATES has more paragraphs (apache and bsd have three, gpl two), nor more words in one.
PARAGRAPHS, PIECE_WORDS = 3, 150


@dataclass(frozen=True)
class Template:
    """A notice. keys: words that name the licence, without which a block is none of it; bars: words of its sisters, with which it isn't either."""

    text: str
    keys: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    phrase: str = ""  # words that have to stand side by side


_GPL = "free software you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
#: Public licence notices, and the phrases that name a licence.
TEMPLATES = {
    "agpl": Template("This program is " + _GPL.format("GNU Affero General Public License", "3", "This program"), ("gnu", "affero")),
    "apache": Template(
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache",),
    ),
    "boost": Template("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ("derivative",)),
    "bsd": Template(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistributions",),
    ),
    "cc-by": Template("This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons", ("creative", "commons", "attribution"), ("noncommercial", "noderivatives", "noderivs", "sharealike", "nc", "nd", "sa")),
    "cc-by-nc": Template("Licensed under CC BY-NC 4.0", ("cc", "nc"), phrase="cc by nc"),
    "cc-by-sa": Template("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons", ("creative", "commons", "sharealike"), ("noncommercial", "nc")),
    "cc0": Template("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", ("cc0", "waived")),
    "gpl": Template("This program is " + _GPL.format("GNU General Public License", "3", "This program"), ("gnu", "general", "public"), ("affero", "lesser", "library")),
    "gpl-notice": Template("This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "public", "license"), ("affero", "lesser"), "gnu general public license"),
    "isc": Template("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "granted", "fee")),
    "lgpl": Template("This library is " + _GPL.format("GNU Lesser General Public License", "2.1", "This library"), ("gnu", "lesser")),
    "mit": Template(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        ("permission", "granted"),
    ),
    "mpl": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla", "mpl")),
    "unlicense": Template("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered",)),
    "zlib": Template("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission", "granted", "freely")),
}
#: How identifiers begin, as words, and their labels; the longest that fits counts.
IDENTIFIERS = {
    "agpl": "agpl", "apache": "apache", "bsd": "bsd", "bsl 1": "boost", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc0": "cc0", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense", "zlib": "zlib",
}
IDENTIFIER = "spdx license identifier"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANY = "|".join(PHRASES)
_BLANK = r"\n[\x20\x09\x0B-\x0D]*\n"


def template_words(templates: dict[str, Template]) -> dict[str, list[str]]:
    """Distinct words of each template, sorted."""
    keep = lambda c: c if c.isalnum() else " "
    return {name: sorted({w.lower() for w in "".join(map(keep, t.text)).split()}) for name, t in templates.items()}


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _phrases(df: DataFrame) -> DataFrame:
    """Places of phrases, with s the text's words between single spaces. (?i) takes ASCII letters alone."""
    s, n = F.col("s"), F.col("n_base")
    df = df.withColumn("n_base", F.regexp_count("s", F.lit(f"(?i) (?:{_ANY})(?= )")).cast("long"))
    # What stands before a phrase is taken as a group: regexp_instr counts UTF-16 units, substring code points. (?s): '.' is any character.
    first = _spaces(F.regexp_extract("s", f"(?is)^(.*?) (?:{_ANY})(?= )", 1))
    last = _spaces(F.regexp_extract("s", f"(?is)^(.*) (?:{_ANY})(?= )", 1))
    labels = F.array(*(F.when(s.rlike(f"(?i) {p} "), F.lit(label)) for p, label in sorted(PHRASES.items(), key=lambda x: x[1])))
    # The longest beginning is tried first. Word ends are checked, so `mit` is not `mitre`.
    ids = "|".join(sorted(IDENTIFIERS, key=lambda x: (-len(x), x)))
    named = F.regexp_extract_all(F.lower(s), F.lit(f" {IDENTIFIER} ({ids})(?= )"), F.lit(1))
    label = F.create_map(*[F.lit(x) for pair in IDENTIFIERS.items() for x in pair])
    spdx = F.when(s.rlike(f"(?i) {IDENTIFIER} "), F.transform(named, lambda x: F.element_at(label, x))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("identified", spdx)
    return df.withColumns(
        {
            "first_word": F.when(n > 0, first.cast("long")),
            "last_word": F.when(n > 0, last.cast("long")),
            "base": F.when(n > 0, F.array_compact(labels)).otherwise(F.array().cast("array<string>")),
        }
    )


def _runs(own: Column) -> Column:
    """Blocks of paragraphs (first, words): each with up to PARAGRAPHS - 1 that follow it; without longer ones that have no word more."""

    def longer(x: Column, y: Column) -> Column:
        both = F.array_union(x["words"], y["words"])
        return F.struct(F.struct(x["block"]["first"].alias("first"), (x["block"]["paragraphs"] + 1).alias("paragraphs")).alias("block"), both.alias("words"), (F.size(both) > F.greatest(F.size(x["words"]), F.size(y["words"]))).alias("more"))

    runs = [own]
    for k in range(1, PARAGRAPHS):
        # No paragraph follows the last ones: their words are null.
        runs.append(F.filter(F.zip_with(runs[-1], F.slice(own, k + 1, F.size(own)), longer), lambda x: x["words"].isNotNull()))
    return F.concat(*runs)


def blocks_and_phrases(docs: DataFrame, words: dict[str, list[str]], bars: set[str], threshold: float, phrased: dict[str, Template]) -> DataFrame:
    """One row per document: row_id, doc_id, n_words, the phrase columns, the templates of `phrased` whose phrase it has (said), and blocks (place, template words) that can match at all."""
    vocabulary = F.array(*map(F.lit, sorted({w for ws in words.values() for w in ws} | bars)))
    least = min(math.ceil(threshold * len(ws)) for ws in words.values())
    df = with_row_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    df = df.withColumn("s", F.concat(F.lit(" "), F.regexp_replace("t", _OTHER, " "), F.lit(" ")))
    df = df.withColumn("s", F.regexp_replace("s", "  +", " "))
    said = F.array_compact(F.array(*(F.when(F.col("s").rlike(f"(?i) {t.phrase} "), F.lit(name)) for name, t in phrased.items()))) if phrased else F.array().cast("array<string>")
    df = df.withColumn("said", said)
    df = _phrases(df.withColumn("n_words", F.greatest(_spaces(F.col("s")) - 1, F.lit(0)).cast("long")))
    place = lambda i: F.struct(i.alias("first"), F.lit(1).alias("paragraphs")).alias("block")
    pieces = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / PIECE_WORDS).cast("int")), lambda k: F.array_intersect(F.slice(ws, k * PIECE_WORDS + 1, F.lit(PIECE_WORDS)), vocabulary))
    df = df.withColumn("split", F.transform(F.split("t", _BLANK), lambda b: F.split(F.lower(b), _OTHER)))
    own = F.transform(F.flatten(F.transform("split", pieces)), lambda ws, i: F.struct(place(i), ws.alias("words"), F.lit(True).alias("more")))
    df = df.withColumn("own", own).withColumn("blocks", _runs(F.col("own")))
    kept = F.filter("blocks", lambda b: b["more"] & (F.size(b["words"]) >= least))
    df = df.withColumn("blocks", F.transform(kept, lambda b: F.struct(b["block"].alias("block"), b["words"].alias("words"))))
    return df.select("row_id", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "said", "identified", "blocks")


def _map(of: dict[str, list[str]]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*(F.array(*map(F.lit, ws)).cast("array<string>") for ws in of.values())))


def containment_join(blocks: DataFrame, words: dict[str, list[str]], threshold: float) -> DataFrame:
    """(row_id, block, template, containment, words) of every block (row_id, block, words) that holds `threshold` of a template's words."""
    # As many counts as templates have words come to the driver.
    counts = {r.w: r.n for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({*counts, *(w for ws in words.values() for w in ws)}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for name, ws in words.items():
        own, needed = sorted(ws, key=rank.get), math.ceil(threshold * len(ws))
        prefixes += [(w, name, i, len(ws), needed) for i, w in enumerate(own[: len(ws) - needed + 1])]
    spark = blocks.sparkSession
    table = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t).alias("template"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(k).alias("needed")) for w, t, i, n, k in prefixes))))
    ranked = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*(F.lit(k) for k in range(len(order)))))
    ordered = blocks.select("row_id", "block", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(ranked, w).alias("r"), w.alias("w")))), lambda x: x["w"]).alias("words"))
    posted = ordered.select("row_id", "block", "words", F.posexplode("words").alias("j", "w"))
    # The table of prefixes is as large as the templates.
    met = posted.join(F.broadcast(table), "w").where("size(words) >= needed")
    pairs = met.groupBy("row_id", "block", "template").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.first("n").alias("n"), F.first("needed").alias("needed"), F.first("words").alias("words"))
    pairs = pairs.where("least(n - i, size(words) - j) >= needed")
    shared = F.size(F.array_intersect("words", F.element_at(_map(words), F.col("template"))))
    return pairs.withColumn("shared", shared).where("shared >= needed").select("row_id", "block", "template", (F.col("shared") / F.col("n")).alias("containment"), "words")


def scan(docs: DataFrame, templates: dict[str, Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts places where a phrase's words stand one after another, first_word and last_word are the smallest and largest
    word number (from 0) where one starts, else null; labels adds the names of templates that a block matches; both are
    distinct, sorted and joined by commas. score is 1 with a phrase or an identifier, else the largest containment found, else 0. matches has the blocks
    (number of the first paragraph or piece, template, containment, number of them). A null text is an empty one: no words, no labels, score 0. Repeated rows are scanned each time;
    texts may be of any length; other columns are ignored; an empty table gives an empty result.
    """
    words, bars = template_words(templates), {w for t in templates.values() for w in t.bars}
    phrased = {n: t for n, t in templates.items() if t.phrase}
    rows, _ = cut(blocks_and_phrases(docs, words, bars, threshold, phrased), "licence-blocks")
    blocks = rows.select("row_id", F.inline("blocks"))
    # As many entries as there are templates.
    keys, without = _map({n: list(t.keys) for n, t in templates.items()}), _map({n: list(t.bars) for n, t in templates.items()})
    met = containment_join(blocks, words, threshold)
    met = met.where((F.size(F.array_except(F.element_at(keys, F.col("template")), "words")) == 0) & ~F.arrays_overlap("words", F.element_at(without, F.col("template"))))
    found = met.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("template", "block.first", "block.paragraphs", "containment"))).alias("found"))

    def shortest(x: Column, n: Column) -> Column:
        # Blocks within this one are close by, as all are in order of their first paragraph.
        near = F.slice("found", F.greatest(n + 2 - PARAGRAPHS, F.lit(1)), F.lit(PARAGRAPHS * (PARAGRAPHS + 1)))
        end = lambda y: y["first"] + y["paragraphs"]
        return ~F.exists(near, lambda y: (y["template"] == x["template"]) & (y["first"] >= x["first"]) & (end(y) <= end(x)) & (y["paragraphs"] < x["paragraphs"]))

    out = rows.drop("blocks").join(found, "row_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<template string, first int, paragraphs int, containment double>>")))
    # Those that have to be said and are not.
    if phrased:
        out = out.withColumn("found", F.filter("found", lambda x: ~x["template"].isin(*phrased) | F.array_contains("said", x["template"])))
    matches = F.transform(F.filter("found", shortest), lambda x: F.struct(x["first"].alias("block"), x["template"].alias("template"), x["containment"].alias("containment"), x["paragraphs"].alias("paragraphs")))
    out = out.withColumn("matches", F.array_sort(matches)).drop("found")
    named = F.array_sort(F.array_distinct(F.concat("base", "identified", F.transform("matches", lambda m: m["template"]))))
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    score = F.when((F.col("n_base") > 0) | (F.size("identified") > 0), F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(named, ",").alias("labels"), score.alias("score"), "matches")
