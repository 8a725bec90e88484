"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

A document is looked at line by line and block by block (a block is a run of lines between lines of
white space; one of a single line is that line). A unit is normalised to lower-case runs of letters and digits; its
set of word bigrams B is compared with a template's set A by 2|A and B| / (|A| + |B|). A value of t or
more needs |A| t / (2 - t) <= |B| <= |A| (2 - t) / t, so a unit meets only the templates within these
bounds, and no bigram is formed for a unit that lies outside all of them by its number of words.

Everything is a column expression on the row, so no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Short notices by which texts declare a license, by identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def normal_bigrams(text: str) -> list[str]:
    """The bigrams of a template, as the column expression forms them; a lone word is its own bigram."""
    found = re.findall(r"[a-z0-9ß-öø-ÿ]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])} or set(found))


def _unit_words(unit: Column) -> Column:
    return F.regexp_extract_all(F.lower(unit), F.lit(r"[a-z0-9\x{00df}-\x{00f6}\x{00f8}-\x{00ff}]+"), F.lit(0))


def _bigrams(found: Column) -> Column:
    pairs = F.transform(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))),
                        lambda w, i: F.concat(F.get(found, i), F.lit(" "), w))
    return F.array_distinct(F.when(F.size(found) == 1, found).otherwise(pairs))


def _once(**computed: Column) -> list[Column]:
    """The columns behind a generator of one row, so that later references do not compute them again."""
    return [F.inline(F.array(F.struct(*[c.alias(name) for name, c in computed.items()])))]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, threshold: float = 0.8,
                  text: str = "text") -> DataFrame:
    """docs with `units` (how many were looked at), `sized` (how many had a size some template allows)
    and `found`, an array of (unit, license, shared, unit_size, template_size, dice) for every unit and
    template at the threshold or above, in order of unit and template.

    unit is the number of the line, or the number of lines plus that of the block. Null and empty texts
    have no units. Repeated rows and lines are each looked at. An empty table gives an empty table.
    Columns named units, sized or found are replaced; no other is touched.
    """
    sets = [(name, normal_bigrams(body)) for name, body in templates]
    if any(not grams for _, grams in sets):
        raise ValueError("a template holds no word")
    if sum(len(grams) for _, grams in sets) > 200_000:
        raise ValueError("templates of more than 200,000 bigrams in all travel with every task; scan in parts")
    least = min(len(g) for _, g in sets) * threshold / (2 - threshold)
    most = max(len(g) for _, g in sets) * (2 - threshold) / threshold
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"),
                               F.array(*[F.lit(x) for x in g]).alias("grams")) for name, g in sets])
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[\x20\x09-\x0d]*\n"),
                      lambda b: F.contains(F.trim(b, F.lit("\n")), F.lit("\n")))
    numbered = F.transform(F.concat(lines, blocks), lambda u, i: F.struct(i.alias("unit"), _unit_words(u).alias("words")))
    names = [c for c in docs.columns if c not in ("units", "sized", "found")]
    units = F.filter(numbered, lambda u: F.size(u["words"]) > 0)
    fitting = F.filter("_units", lambda u: F.greatest(F.size(u["words"]) - 1, F.lit(1)) >= least)
    sized = F.filter(F.transform(fitting, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("grams"))),
                     lambda u: F.size(u["grams"]).between(least, most))
    kept = docs.select(*[docs[c] for c in names])
    looked = kept.select("*", *_once(_units=units)).select(*names, F.size("_units").alias("units"), *_once(_sized=sized))

    def against(u: Column) -> Column:
        within = F.filter(known, lambda t: F.size(u["grams"]).between(t["size"] * F.lit(threshold / (2 - threshold)),
                                                                    t["size"] * F.lit((2 - threshold) / threshold)))
        scored = F.transform(within, lambda t: F.struct(
            u["unit"].alias("unit"), t["license"].alias("license"),
            F.size(F.array_intersect(u["grams"], t["grams"])).alias("shared"),
            F.size(u["grams"]).alias("unit_size"), t["size"].alias("template_size")))
        return F.filter(scored, lambda x: 2 * x["shared"] >= F.lit(threshold) * (x["unit_size"] + x["template_size"]))

    found = F.transform(F.flatten(F.transform(F.col("_sized"), against)), lambda x: F.struct(
        x["unit"].alias("unit"), x["license"].alias("license"), x["shared"].alias("shared"),
        x["unit_size"].alias("unit_size"), x["template_size"].alias("template_size"),
        (2 * x["shared"] / (x["unit_size"] + x["template_size"])).alias("dice")))
    return looked.select(*names, "units", F.size("_sized").alias("sized"), found.alias("found"))
