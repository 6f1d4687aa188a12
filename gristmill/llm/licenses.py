"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a document are its lines and its paragraphs (runs of lines between blank ones). A unit is lower-cased,
everything but letters and digits becomes one space, and its set of word bigrams is compared with that of each template
whose size lets the coefficient reach the threshold: with ``t`` bigrams in the template and ``n`` in the unit it is at
most ``2 * min(n, t) / (n + t)``. Units without any of a few words that every match must hold (``anchors``) are passed over. The template with the highest coefficient names the unit (the first by name of equals).

Templates are a short list that stands in the plan as a literal; every text is read once, in its own row, with built-in
functions only. Nothing is shuffled.

Defined results: null and blank texts and units of one word give no rows; repeated documents give repeated rows; a
paragraph of one line is not tested twice; a unit that repeats in a document is reported each time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Usual notices, and the first paragraphs of well-known licence texts and headers.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bounds(t: int, threshold: float) -> tuple[int, int]:
    """Sizes of a unit that can reach the threshold with a template of ``t`` bigrams."""
    low, high = t * threshold / (2 - threshold), t * (2 - threshold) / threshold
    return int(-(-(low - 1e-9) // 1)), int(high + 1e-9)


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold holds at least one.

    Such a unit shares a least number of bigrams with its template. Words are picked, those of five letters or more and
    of most templates first, until the bigrams of each template without any of them are fewer than that number.
    """
    open_ = []
    for _, text in templates:
        pairs = [b.split(" ") for b in bigrams_of(text)]
        least = threshold * (bounds(len(pairs), threshold)[0] + len(pairs)) / 2
        open_.append((pairs, least - 1e-9))
    picked: list[str] = []
    while open_:
        count: dict[str, int] = {}
        for pairs, _ in open_:
            for w in {w for pair in pairs for w in pair}:
                count[w] = count.get(w, 0) + 1
        if not count:
            break
        picked.append(min(count, key=lambda w: (len(w) < 5, -count[w], w)))
        rest = [([p for p in pairs if picked[-1] not in p], least) for pairs, least in open_]
        open_ = [(pairs, least) for pairs, least in rest if len(pairs) >= least]
    return picked


def _best(bigrams: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """The best (dice, minus the rank by name) of a set of bigrams, or null; templates outside the size bounds are not intersected."""
    n, tries = F.size(bigrams), []
    for rank, (_, text) in enumerate(templates):
        known = bigrams_of(text)
        low, high = bounds(len(known), threshold)
        dice = 2 * F.size(F.array_intersect(bigrams, F.array(*[F.lit(b) for b in known]))) / (n + len(known))
        tries.append(F.when(n.between(low, high), F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"))))
    return F.array_max(F.array(*tries))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, unit_no, license, dice) for each line or paragraph of ``docs(doc_id, text)`` that is a notice.

    ``unit_no`` counts lines, or paragraphs, from 1.
    """
    templates = sorted(TEMPLATES if templates is None else templates)
    sizes = [bounds(len(bigrams_of(t)), threshold) for _, t in templates]
    low, high = min(a for a, _ in sizes), max(b for _, b in sizes)
    words = F.array(*[F.lit(w) for w in anchors(templates, threshold)])

    def anchored(text: Column) -> Column:
        return F.exists(F.transform(F.array(F.lower(text)), lambda t: F.exists(words, lambda w: F.contains(t, w))), lambda x: x)

    docs = docs.filter(anchored(F.col("text")))

    def units_of(pattern: str, kind: str) -> Column:
        return F.transform(F.split("text", pattern), lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("unit_no"), x.alias("unit")))

    def pairs(words: Column) -> Column:
        n = F.size(words) - 1
        return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    lines = units_of("\r\n|[\n\r]", "line")
    paragraphs = F.filter(units_of(r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])\s*", "paragraph"), lambda p: p["unit"].rlike(r"\S\s*[\n\r]\s*\S"))
    # a unit of ``n`` bigrams has more than ``n`` words; repeated bigrams leave no upper bound by words
    long_enough = F.filter(F.concat(lines, paragraphs), lambda u: (F.length(u["unit"]) > 2 * low) & anchored(u["unit"]))
    sets = F.transform(long_enough, lambda u: F.struct(u["kind"].alias("kind"), u["unit_no"].alias("unit_no"), pairs(F.split(normalised(u["unit"]), " ")).alias("bigrams")))
    units = docs.select("doc_id", F.explode(F.filter(sets, lambda u: F.size(u["bigrams"]).between(low, high))).alias("u")).select("doc_id", "u.*")
    # a generator, so that the coefficients are computed once and not again to filter on them
    best = F.filter(F.array(_best(F.col("bigrams"), templates, threshold)), lambda x: x["dice"] >= threshold)
    found = units.select("doc_id", "kind", "unit_no", F.inline(best))
    return found.select("doc_id", "kind", "unit_no", F.element_at(F.array(*[F.lit(name) for name, _ in templates]), 1 - F.col("rank")).alias("license"), "dice")
