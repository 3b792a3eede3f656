"""Licence scan: passages against licence templates by the Dice coefficient of
their word bigrams, in DataFrame functions only.

A text's passages are its lines, its paragraphs of several lines, and the whole
text. A passage is normalised (lower case, everything but letters and digits
taken as a space), and its size bounds the templates that can match: with Dice
at least t, ``|A| t / (2 - t) <= |B| <= |A| (2 - t) / t``. Passages that no
template's bounds admit are dropped before their bigrams are made; the rest meet
the templates through an index of the templates' bigrams, so no passage is
paired with every template. Matching counts are pre-aggregated.

Runs of words inside a text are passages too (``run_matches``): as long as the
template, from any of its bigrams on, over line breaks and within longer lines.
Dice of t needs ``t / (2 - t)`` of a template's bigrams, so some bigram of any
larger rest of them is in the passage: texts without a word of such a rest match
nothing and are not opened. Equal texts are scanned once.

The templates are a parameter, a short list: their index is broadcast, and a
list of more than ``MAX_TEMPLATE_BIGRAMS`` bigrams is refused.

Defined cases: null and empty texts have no licence; repeated rows get the same
result each; a passage of one word has no bigram and never matches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import let, scratch_table, table

DICE = 0.8
MAX_TEMPLATE_BIGRAMS = 200_000

#: Short licence notices (SPDX identifier, wording).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Compared with runs only: bodies and notices that a line seldom holds whole.
BODIES = [
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
                "to this software to the public domain worldwide. This software is distributed without any warranty."),
]


def template_bigrams(text: str) -> set[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def passages(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the whole text if it has several
    paragraphs."""
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda p: p.contains("\n"))
    return F.concat(lines, blocks, F.when(text.rlike(r"\n\s*\n"), F.array(text)).otherwise(F.array().cast("array<string>")))


def licence_matches(documents: DataFrame, key: Column, text: str = "text", templates=None, dice: float = DICE) -> DataFrame:
    """(key, licence, dice): the best match of every licence found in a text."""
    spark = documents.sparkSession
    index = [(n, name, len(b), x) for n, (name, words) in enumerate(templates or TEMPLATES)
             for b in [template_bigrams(words)] for x in sorted(b)]
    if len(index) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"more than {MAX_TEMPLATE_BIGRAMS} template bigrams")
    sizes = [n for _, _, n, _ in index]
    if not sizes:
        raise ValueError("no template has two words")
    low, high = min(sizes) * dice / (2 - dice), max(sizes) * (2 - dice) / dice
    index = F.broadcast(spark.createDataFrame(index, "template int, licence string, size int, bigram string"))
    # a passage of k bigrams has more than k words, of one character and a space at least
    units = documents.select(key.alias("key"), F.posexplode(F.filter(
        passages(F.coalesce(F.col(text), F.lit(""))), lambda p: F.length(p) > 2 * low)).alias("unit", "passage"))
    units = units.select("key", "unit", _bigrams_bounded(F.col("passage"), low, high).alias("bigrams"))
    rows = units.where(F.size("bigrams") > 0).select("key", "unit", F.size("bigrams").alias("n"), F.explode("bigrams").alias("bigram"))
    hits = rows.join(index, "bigram").where((F.col("n") >= F.col("size") * (dice / (2 - dice))) & (F.col("n") <= F.col("size") * ((2 - dice) / dice)))
    counted = hits.groupBy("key", "unit", "n", "template", "licence", "size").agg(F.count_distinct("bigram").alias("both"))
    score = F.col("both") * 2 / (F.col("n") + F.col("size"))
    return counted.where(F.col("both") * 2 >= (F.col("n") + F.col("size")) * dice).groupBy("key", "licence").agg(F.max(score).alias("dice"))


def _bigrams_bounded(passage: Column, low: float, high: float) -> Column:
    """Distinct bigrams, or an empty array where their number is out of bounds."""
    none = F.array().cast("array<string>")
    return let(_words(passage), lambda w: F.when(F.size(w) - 1 < low, none).otherwise(
        let(_bigrams(w), lambda b: F.when((F.size(b) >= low) & (F.size(b) <= high), b).otherwise(none))))


def trigger_words(templates, dice: float = DICE) -> list[str]:
    """Words of which every text with a run of Dice ``dice`` holds one at least."""
    out: set[str] = set()
    for _, words in sorted(templates, key=lambda x: len(x[1])):
        pairs = [x.split() for x in sorted(template_bigrams(words))]
        need = math.ceil(len(pairs) * dice / (2 - dice) - 1e-9)
        while len(rest := [x for x in pairs if out.isdisjoint(x)]) >= need:
            # long words are rare; any choice is complete
            out.add(max({w for x in rest for w in x}, key=lambda w: (sum(w in x for x in rest) * max(len(w) - 4, 0.1), w)))
    return sorted(out)


def holds_a_trigger(text: Column, templates, dice: float = DICE) -> Column:
    """Whether a passage of the text may match at all (see ``trigger_words``)."""
    words = "|".join(trigger_words(templates, dice))
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")


def run_matches(documents: DataFrame, key: str = "key", text: str = "text", templates=None, dice: float = DICE) -> DataFrame:
    """(key, licence, dice): the best run of every licence found in a text, by the
    distinct bigrams of the run and of the template. ``key`` is unique, and
    ``documents`` a stored table: it is read twice."""
    templates = [(name, words) for name, words in templates or TEMPLATES + BODIES if template_bigrams(words)]
    index = [(n, name, len(b), len(_plain(words)) - 1, math.ceil(len(b) * dice / (2 - dice) - 1e-9), k, x)
             for n, (name, words) in enumerate(templates) for b in [template_bigrams(words)] for k, x in enumerate(sorted(b))]
    if not 0 < len(index) <= MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"no template bigram, or more than {MAX_TEMPLATE_BIGRAMS}")
    index = F.broadcast(documents.sparkSession.createDataFrame(
        index, "template int, licence string, size int, length int, need int, id int, bigram string"))
    texts = documents.where(holds_a_trigger(F.col(text), templates, dice)).select(F.col(key).alias("key"), _words(F.col(text)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    texts = texts.where(F.size("w") > 1).select("key", pairs.alias("pairs"))
    hits = texts.select("key", F.posexplode("pairs").alias("at", "bigram")).join(index, "bigram")
    one = hits.groupBy("key", "template", "licence", "size", "length", "need").agg(
        F.sort_array(F.collect_list(F.struct("at", "id"))).alias("h")).where(
        F.size(F.array_distinct(F.col("h.id"))) >= F.col("need"))

    # a run of enough distinct template bigrams; the others of the run only lower its Dice
    def start(x, i):
        near = F.try_element_at(F.col("h"), i + F.col("need"))["at"] < x["at"] + F.col("length")
        inside = F.filter(F.slice("h", i + 1, F.col("length")), lambda y: y["at"] < x["at"] + F.col("length"))
        return F.struct(x["at"].alias("at"), F.when(near, F.size(F.array_distinct(inside["id"]))).otherwise(0).alias("both"))

    runs = F.filter(F.transform("h", start), lambda r: r["both"] >= F.col("need"))
    found = one.select("key", F.struct("licence", "size", "length", runs.alias("runs")).alias("m")).where(F.size("m.runs") > 0) \
        .groupBy("key").agg(F.collect_list("m").alias("ms")).join(texts, "key")

    def dices(m):
        return F.transform(m["runs"], lambda r: r["both"] * 2 / (
            F.size(F.array_distinct(F.slice(F.col("pairs"), r["at"] + 1, m["length"]))) + m["size"]))

    best = F.transform("ms", lambda m: F.struct(m["licence"].alias("licence"), F.array_max(dices(m)).alias("dice")))
    return found.select("key", F.inline(best)).where(F.col("dice") >= dice).groupBy("key", "licence").agg(F.max("dice").alias("dice"))


def _plain(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def told_apart(found: DataFrame, third: DataFrame) -> DataFrame:
    """Matches (key, licence, dice), where a body of two conditions is not
    BSD-3-Clause by its first sentence, and with the third clause (``third``)
    not BSD-2-Clause."""
    wrong = found.where("licence = 'BSD-2-Clause'").select("key").join(
        third.select("key", F.lit(True).alias("clause")), "key", "left").select(
        "key", F.when(F.col("clause"), "BSD-2-Clause").otherwise("BSD-3-Clause").alias("licence"))
    return found.join(wrong, ["key", "licence"], "left_anti")


def licences(documents: DataFrame, text: str = "text", id_col: str = "doc_id", templates=None, dice: float = DICE,
             runs: bool = False) -> DataFrame:
    """One row per document: id, n_licences, licences (sorted identifiers,
    comma-joined) and best_dice (0 without a match); ``runs``: with runs of words
    inside lines and over line breaks."""
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))
    passing = documents.select(key.alias("key"), t.alias("text")).where(
        holds_a_trigger(F.col("text"), templates or TEMPLATES + BODIES * runs, dice))
    # one row per different text that may match: all that follows reads these alone
    passing = scratch_table(passing.groupBy("key").agg(F.first("text").alias("text")), "candidates")
    found = licence_matches(passing, F.col("key"), "text", templates, dice)
    if runs:
        inner = scratch_table(run_matches(passing, "key", "text", templates, dice), "runs")
        clause = [x for x in BODIES if x[0] == "BSD-3-Clause"]
        found = scratch_table(found.union(inner).groupBy("key", "licence").agg(F.max("dice").alias("dice")), "matches")
        found = told_apart(found, run_matches(passing, "key", "text", clause, dice))
    found = found.groupBy("key").agg(
        F.array_sort(F.collect_set("licence")).alias("names"), F.max("dice").alias("best"))
    rows = documents.select(id_col, key.alias("key"))
    return rows.join(found, "key", "left").select(
        id_col, F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_licences"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licences"), F.coalesce(F.round("best", 9), F.lit(0.0)).alias("best_dice"))


def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents").select("doc_id", "text"), runs=True)
