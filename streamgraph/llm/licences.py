"""Operator 9: licence scans, in DataFrame functions only.

Units of a text are normalised to lower-case ASCII words and compared with
licence templates by the Dice coefficient over distinct word bigrams. Units are each line, the whole text, and from every beginning of a
line or sentence on as many words as a template has (which are compared with it alone), wherever lines are wrapped. A unit of ``a`` bigrams
can reach ``least`` against a template of ``b`` only if a and b are close, so a template is joined to
units by the sizes that can reach it; no other pair is ever made.

Texts that hold none of a few key words are left out before: of each template so many words that a unit without any
of them lacks too many bigrams to reach ``least``.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .columns import let

LEAST = 0.8
# Words that many texts hold, which are looked for last.
COMMON = frozenset("a above all an and any are as at be but by can either following for form from if in is it its made may must no nor not of on or other out such that the their this to under use used v way whether will with without you your".split())
#: Words of a text whose beginnings are handled together, which bounds a row of a very long text.
BLOCK_WORDS = 2000
# Notices and texts of well-known public licences.
_BSD_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": ["Released under the MIT License.", "This software is released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_SOURCE],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", f"{_BSD_SOURCE} {_BSD_NAMES}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", _ISC],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_rows() -> list[tuple[str, int, int, list[str]]]:
    """(licence, number of its template, its words, its distinct bigrams); the last template of each licence is its SPDX tag."""
    rows = []
    for name, texts in TEMPLATES.items():
        for i, text in enumerate([*texts, f"SPDX-License-Identifier: {name}"]):
            w = re.findall("[a-z0-9]+", text.lower())
            rows.append((name, i, len(w), sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return rows


def key_words(grams: list[str], least: float, chosen_before: frozenset[str] = frozenset()) -> list[str]:
    """Words of a template without all of which a unit can't reach ``least``: it needs least * b / (2 - least) of the b bigrams at least, and
    these words are in more than the rest. Words that other templates have chosen come first, then those in many bigrams; numbers and COMMON words last.
    """
    open_ = {tuple(g.split(" ")) for g in grams}
    spare = len(open_) - least * len(open_) / (2 - least)
    left, chosen = set(open_), []
    while len(open_) - len(left) <= spare + 1e-9:
        found = {w for g in left for w in g}
        word = max(found, key=lambda w: (w not in COMMON and not w.isdigit(), w in chosen_before, sum(w in g for g in left), len(w), w))
        chosen.append(word)
        left = {g for g in left if word not in g}
    return sorted(chosen)


def all_key_words(rows: list[tuple], least: float) -> list[str]:
    """Key words of all templates, small ones first."""
    found: frozenset[str] = frozenset()
    for *_, grams in sorted(rows, key=lambda r: len(r[-1])):
        found |= set(key_words(grams, least, found))
    return sorted(found)


def reachable(b: int, least: float) -> list[int]:
    """The sizes a with 2 min(a, b) / (a + b) >= least."""
    return [a for a in range(1, int(b * (2 - least) / least) + 2) if 2 * min(a, b) >= least * (a + b)]


def bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+", -1), lambda w: w != "")


def _any_of(text: Column, words: list[str]) -> Column:
    """The text holds any of the words: long ones as a part of words at least, short ones by themselves."""
    long_ = [w for w in words if len(w) > 4]
    parts = [F.contains(text, F.lit(w)) for w in long_ if not any(x != w and x in w for x in long_)]
    parts += [F.contains(text, F.lit(w)) & text.rlike(f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)") for w in words if len(w) <= 4]
    return reduce(lambda a, b: a | b, parts)


def needed(b: int, least: float) -> int:
    """Of a template's ``b`` bigrams so many at least are in a unit that reaches ``least``."""
    return max(1, ceil(least * b / (2 - least) - 1e-9))


def windows(texts: DataFrame, rows: list[tuple], least: float) -> DataFrame:
    """(doc_id, unit, n, g): from every beginning of a line or sentence on, the bigrams of as many words, n, as a template has; unit is the line.

    Places of a text whose bigram is any template's are marked; a window is taken only where it has as many marks as the template needs.
    """
    most = max(n for _, _, n, _ in rows)
    least_marks = {n: min(needed(len(grams), least) for _, _, m, grams in rows if m == n) for n in sorted({n for _, _, n, _ in rows})}
    known = F.array(*[F.lit(g) for g in sorted({g for *_, grams in rows for g in grams})])
    sentences = lambda line: F.split(line, "[.!?]+[ \t]+", -1)
    word = lambda i: lambda w, j: F.struct(w.alias("w"), (i + 1).alias("line"), (j == 0).alias("first"))
    of_line = lambda line, i: F.flatten(F.transform(sentences(line), lambda x: F.transform(words_of(x), word(i))))
    # every value that a lambda names is bound by let or comes out of explode, else it would be computed again for each element
    part = lambda w: lambda b: let(F.slice(w, b * BLOCK_WORDS + 1, BLOCK_WORDS + most), lambda x: F.struct(x["w"].alias("ws"), x["line"].alias("lines"), x["first"].alias("firsts")))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / BLOCK_WORDS).cast("int")), part(w))
    blocks = texts.select("doc_id", F.explode(let(F.flatten(F.transform(F.split("t", "\n", -1), of_line)), cut)).alias("b")).where(F.size("b.ws") > 1)
    pair = lambda i: F.concat(F.get("b.ws", i), F.lit(" "), F.get("b.ws", i + 1))
    places = F.sequence(F.lit(0), F.size("b.ws") - 2)
    marks = let(F.array_intersect(bigrams(F.col("b.ws")), known), lambda held: F.when(F.size(held) >= min(least_marks.values()), F.filter(places, lambda i: F.array_contains(held, pair(i)))).otherwise(F.array().cast("array<int>")))
    begins = F.filter(F.sequence(F.lit(0), F.least(F.size("b.ws"), F.lit(BLOCK_WORDS)) - 1), lambda i: F.get("b.firsts", i))

    def at(marks: Column) -> Column:
        """The beginnings with marks near, and the places of those marks counted from them."""
        near = lambda i: F.transform(F.filter(marks, lambda m: (m >= i) & (m < i + most - 1)), lambda m: m - i)
        every = F.transform(begins, lambda i: F.struct(F.get("b.lines", i).alias("unit"), i.alias("i"), near(i).alias("near")))
        return F.when(F.size(marks) > 0, F.filter(every, lambda s: F.size(s["near"]) >= min(least_marks.values())))

    starts = blocks.select("doc_id", F.col("b.ws").alias("ws"), F.explode(let(marks, at)).alias("s"))
    starts = starts.select("doc_id", "s.unit", "s.near", F.slice("ws", F.col("s.i") + 1, most).alias("ws"))
    lengths = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in least_marks.items()])
    enough = F.filter(lengths, lambda x: F.size(F.filter("near", lambda m: m < x["n"] - 1)) >= x["k"])
    taken = starts.select("doc_id", "unit", "ws", F.explode(enough).alias("x")).select("doc_id", "unit", "x.n", F.slice("ws", 1, F.col("x.n")).alias("ws"))
    return taken.select("doc_id", "unit", "n", let(F.col("ws"), bigrams).alias("g"))


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each unit and template with Dice >= least: doc_id, unit (0: the whole text, else the number of the line in which it begins), licence, template, dice.

    A text of one line has no unit 0, as its line says the same. Several units that begin in one line give rows of their own. Null and empty texts, lines of fewer than two words and rows that resemble no template give no
    rows; null and repeated ids are carried as they are; other columns are not read. There is no shuffle: the templates are a constant of this module.
    Texts that hold bigrams of templates are written once, to be read for each kind of unit.
    """
    spark: SparkSession = docs.sparkSession
    rows = template_rows()
    made = [(name, i, n, size, grams) for name, i, n, grams in rows for size in reachable(len(grams), least)]
    templates = spark.createDataFrame(made, "licence string, template int, words int, a int, grams array<string>")
    largest = max(a for *_, a, _ in made)
    keys = all_key_words(rows, least)
    known = F.array(*[F.lit(g) for g in sorted({g for *_, grams in rows for g in grams})])
    least_marks = min(needed(len(grams), least) for *_, grams in rows)
    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).where(_any_of(F.col("t"), keys))
    texts = texts.where(F.size(F.array_intersect(let(words_of(F.col("t")), bigrams), known)) >= least_marks)
    texts = scratch.keep(texts, "likely")  # few, and read once for each kind of unit
    lines = texts.select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("unit"), "line")
    whole = texts.where(F.instr("t", "\n") > 0).select("doc_id", F.lit(0).alias("unit"), F.col("t").alias("line"))
    seen = lines.unionByName(whole).select("doc_id", "unit", let(words_of(F.col("line")), bigrams).alias("g"))
    units = seen.withColumn("n", F.lit(None).cast("int")).unionByName(windows(texts, rows, least)).withColumn("a", F.size("g"))
    joined = units.where(f"a between 1 and {largest}").join(F.broadcast(templates), "a").where("n is null or n = words")
    dice = 2 * F.size(F.array_intersect("g", "grams")) / (F.col("a") + F.size("grams"))
    return joined.withColumn("dice", dice).where(F.col("dice") >= least).select("doc_id", "unit", "licence", "template", "dice")


def best_matches(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Of ``scan`` the best match of each unit; equal ones go by licence and template. Repeated rows of a document give one row."""
    order = F.struct("dice", "licence", (-F.col("template")).alias("template"))
    best = scan(docs, least).groupBy("doc_id", "unit").agg(F.max(order).alias("b"))
    return best.select("doc_id", "unit", "b.licence", (-F.col("b.template")).alias("template"), "b.dice")
