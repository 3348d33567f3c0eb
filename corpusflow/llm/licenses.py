"""License scan: normalised statements against licence templates, by Dice coefficient over word bigrams.

A text is cut into statements at line ends and after sentence ends; besides, the lines of a paragraph are joined and
its sentences that go over several lines are statements too, and so is a whole paragraph of several lines and sentences,
unless a smaller statement in them matched. What matches nothing as a whole is compared span by span, each as long as
the template. A statement and a template are lower-cased (A-Z),
everything but ASCII letters, digits and non-ASCII characters becomes a space, and their sets of word bigrams are
compared: 2|A∩B| / (|A|+|B|). Size bounds prune templates first: at a Dice of t or more, |A| lies between t/(2-t)
and (2-t)/t times |B|. A lossless word filter skips most texts: a statement that matches shares so many bigrams with
its template that it must hold one of a few anchor words, chosen so that they cover enough of the template.

All of it is column expressions over one scan; nothing is shuffled, so no row or source can be hot.

Edge cases: null and empty texts have no statements; ties go to the licence that sorts first; repeated rows and null
ids each give their own row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    # whole permission and notice sentences as they stand in licence files and headers
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that ordinary texts hold: taken as anchors last.
COMMON = set("a an and any are as at by can except file following for form free general in is it later met not of on or other published subject that the this to under use version with without work you your".split())
ENDS = r"\n|(?<=[.!?])[\x20\x09-\x0D]+"
SENTENCES = r"(?<=[.!?])[\x20\x09-\x0D]+"
#: Between paragraphs: a line without a letter, digit or non-ASCII character, as in a commented header.
PARAGRAPHS = r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)+"


def grams_of(text: str) -> list[str]:
    words = re.sub(SEPARATORS, " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split(" ")
    words = [w for w in words if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every statement at or above the limit holds one, for each template."""
    out: set[str] = set()
    for _, text in templates:
        grams = grams_of(text)
        m = len(grams)
        fewest = math.ceil(m * least / (2 - least) - 1e-9)
        shared = math.ceil(least * (fewest + m) / 2 - 1e-9)
        words = sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in COMMON, w not in out, -len(w), w))
        covered: set[str] = set()
        for word in words:
            if len(covered) >= m - shared + 1:
                break
            if new := {g for g in grams if word in g.split(" ")} - covered:
                covered |= new
                out.add(word)
    return sorted(out)


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, DOWN), SEPARATORS), lambda w: w != "")


def grams(text: Column) -> Column:
    return grams_in(words_in(text))


def grams_in(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row per document: matching statements, licences found (sorted, comma-joined; null if none), the best and its Dice."""
    known = [(name, g) for name, text in templates if (g := grams_of(text))]
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("m"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known])
    text = F.col("text").cast("string")
    words = anchors([t for t in templates if grams_of(t[1])], least)

    edge = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    holds = lambda c: c.rlike(rf"(?i)(?<!{edge})(?:{'|'.join(words)})(?!{edge})") if words else F.lit(False)

    def matches(statement: Column) -> Column:
        near = F.filter(table, lambda t: (statement["n"] * (2 - least) >= t["m"] * least - 1e-9) & (t["m"] * (2 - least) >= statement["n"] * least - 1e-9))
        scored = F.transform(near, lambda t: F.struct(t["name"].alias("name"), (2.0 * F.size(F.array_intersect(t["grams"], statement["grams"])) / (statement["n"] + t["m"])).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= least)

    best_first = "(a, b) -> case when a.dice > b.dice then -1 when a.dice < b.dice then 1 when a.name < b.name then -1 when a.name > b.name then 1 else 0 end"
    lines = F.filter(F.split(text, ENDS), holds)
    sized = F.transform(lines, lambda u: F.struct(grams(u).alias("grams"), F.size(grams(u)).alias("n")))
    found = F.filter(F.transform(sized, matches), lambda m: F.size(m) > 0)

    def dice(window: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(t["grams"], window)) / (F.size(window) + t["m"])

    def spans(u: Column) -> Column:
        """The templates that some span of the statement meets; a statement that lacks too much of one has no such span."""
        whole = F.transform(F.array(words_in(u)), lambda w: F.struct(w.alias("words"), grams_in(w).alias("grams")))
        able = lambda x: F.filter(table, lambda t: (F.size(x["words"]) > t["m"]) & (F.size(F.array_intersect(t["grams"], x["grams"])) >= least / 2 * t["m"]))
        best = lambda x, t: F.array_max(F.transform(F.sequence(F.lit(1), F.size(x["words"]) - t["m"]), lambda i: dice(grams_in(F.slice(x["words"], i, t["m"] + 1)), t)))
        scored = F.flatten(F.transform(whole, lambda x: F.transform(able(x), lambda t: F.struct(t["name"].alias("name"), best(x, t).alias("dice")))))
        return F.filter(scored, lambda s: s["dice"] >= least)

    def whole_or_spans(u: Column) -> Column:
        one = F.transform(F.array(u), lambda v: matches(F.struct(grams(v).alias("grams"), F.size(grams(v)).alias("n"))))[0]
        return F.transform(F.array(one), lambda m: F.when(F.size(m) > 0, m).otherwise(spans(u)))[0]

    met = lambda u, ends: F.exists(F.filter(F.split(u, ends), holds), lambda v: F.size(matches(F.struct(grams(v).alias("grams"), F.size(grams(v)).alias("n")))) > 0)
    paragraphs = F.filter(F.split(text, PARAGRAPHS), lambda p: p.contains("\n") & holds(p))
    # a sentence over several lines, none of which matched
    wrapped = lambda p: F.filter(F.split(p, SENTENCES), lambda u: u.contains("\n") & holds(u) & ~met(u, ENDS))
    hit = lambda p: F.filter(F.transform(wrapped(p), whole_or_spans), lambda m: F.size(m) > 0)
    joined = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.array(hit(p)), lambda h: F.when((F.size(h) > 0) | met(p, ENDS), h).otherwise(F.filter(F.array(whole_or_spans(p)), lambda m: F.size(m) > 0)))[0]))
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(holds(text), F.concat(found, joined)).alias("found"))
    tops = hits.select("doc_id", F.expr(f"transform(found, m -> get(array_sort(m, {best_first}), 0))").alias("tops"))
    best = F.expr(f"get(array_sort(tops, {best_first}), 0)")
    return tops.select(
        "doc_id",
        F.coalesce(F.when(F.size("tops") >= 0, F.size("tops")), F.lit(0)).cast("long").alias("n_statements"),
        F.expr("nullif(array_join(array_sort(array_distinct(transform(tops, t -> t.name))), ','), '')").alias("licenses"),
        best["name"].alias("best_license"),
        best["dice"].alias("best_dice"),
    )
