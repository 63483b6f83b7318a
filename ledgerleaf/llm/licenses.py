"""License scan: lines, whole texts and runs of words against license templates by Dice coefficient over word bigrams.

A text is normalised to words of a-z and 0-9. With ``t`` the threshold, a set
of ``x`` bigrams reaches a template of ``y`` only if x lies between
y * t / (2 - t) and y * (2 - t) / t; other templates are not compared. All is
row-local: templates travel in the plan, their number is that of the list.

Runs find notices that are wrapped over lines of a longer text or share a line
with other words. A best run starts and ends at a bigram of its template, so
only those are tried, and only in texts that hold enough of its bigrams. A run
has at most the template's largest set, times the template's own repetition, in
bigrams. Of runs that overlap, the best stays.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.llm.common import bind

THRESHOLD = 0.75

# Short notices and grant texts of common licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in text))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest set that can reach a template of ``n`` bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _templates(templates, threshold: float) -> Column:
    rows = []
    for name, text in templates:
        words, grams = _words(text), template_bigrams(text)
        low, high = size_bounds(len(grams), threshold)
        rows.append(F.struct(
            F.lit(name).alias("license"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, grams)).alias("grams"),
            # Bigrams of the template that a match holds at least, bigrams of a run at most.
            F.lit(math.ceil(threshold * (low + len(grams)) / 2 - 1e-9)).alias("least"), F.lit(high * (len(words) - 1) // len(grams)).alias("reach"),
        ))
    return F.array(*rows)


def text_words(text: Column) -> Column:
    """Words of a normalised text, in order."""
    return F.split(F.btrim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def _pairs(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(pairs)


def text_bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    return bind(text_words(text), lambda w: F.array_distinct(_pairs(w)))


def _dice(grams: Column, template: Column) -> Column:
    return F.size(F.array_intersect(grams, template["grams"])) * 2.0 / (F.size(grams) + F.size(template["grams"]))


def _runs(grams: Column, template: Column, threshold: float) -> Column:
    """array<struct(dice, license, start, stop)>: per bigram of the template in a text, the best run that starts there."""
    least, reach = template["least"], template["reach"]

    def best(at: Column, i: Column) -> Column:
        start = F.get(at, i)
        stops = F.filter(F.slice(at, i + least, reach), lambda p: p - start < reach)
        run = lambda p: F.struct(
            bind(F.array_distinct(F.slice(grams, start + 1, p - start + 1)), lambda g: _dice(g, template)).alias("dice"),
            template["license"].alias("license"), start.alias("start"), p.alias("stop"),
        )
        return F.array_max(F.transform(stops, run))

    def of(at: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(at) - least)
        return F.filter(F.transform(starts, lambda i: best(at, i)), lambda r: r["dice"] >= threshold)

    at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda p: F.array_contains(template["grams"], F.get(grams, p)))
    return bind(at, of)


def best_runs(text: Column, templates: Column, every: Column, threshold: float) -> Column:
    """array<struct(dice, license, start, stop)> of runs that reach a template and overlap no better one; ``every`` holds all bigrams of the templates."""
    kind = "array<struct<dice:double,license:string,start:int,stop:int>>"

    def apart(kept: Column, run: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["start"] <= run["stop"]) & (run["start"] <= k["stop"]))
        return F.when(hit, kept).otherwise(F.array_append(kept, run))

    def found(grams: Column) -> Column:
        near = lambda seen: F.filter(templates, lambda t: F.size(F.array_intersect(seen, t["grams"])) >= t["least"])
        fitting = bind(F.array_intersect(grams, every), near)
        runs = F.flatten(F.transform(fitting, lambda t: _runs(grams, t, threshold)))
        return F.aggregate(F.reverse(F.array_sort(runs)), F.array().cast(kind), apart)

    return bind(text_words(F.coalesce(text, F.lit(""))), lambda w: bind(_pairs(w), found))


def best_match(text: Column, templates: Column, threshold: float) -> Column:
    """struct(dice, license) of the best template, null below the threshold; ties go to the later name."""

    def match(grams: Column) -> Column:
        fitting = F.filter(templates, lambda t: F.size(grams).between(t["low"], t["high"]))
        scored = F.transform(
            fitting,
            lambda t: F.struct(_dice(grams, t).alias("dice"), t["license"].alias("license")),
        )
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    return bind(text_bigrams(text), match)


def license_report(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_matches (lines that match), licenses (names, sorted), best_dice; one row per row.

    Each line is compared, the text as a whole where it has several lines, and runs
    of words wherever they stand; runs count for ``licenses`` and ``best_dice``. A
    null text has no match (and a null best_dice, as any without); null and
    repeated ids are rows as any other; an empty table gives an empty result.
    """
    known = _templates(templates, threshold)
    every = F.array(*map(F.lit, sorted({g for _, text in templates for g in template_bigrams(text)})))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    found = docs.select("doc_id", "text", known.alias("known")).select(
        "doc_id",
        F.filter(F.transform(lines, lambda line: best_match(line, F.col("known"), threshold)), lambda m: m.isNotNull()).alias("lines"),
        F.when(F.contains(F.col("text"), F.lit("\n")), best_match(F.col("text"), F.col("known"), threshold)).alias("whole"),
        F.transform(best_runs(F.col("text"), F.col("known"), every, threshold), lambda r: F.struct(r["dice"].alias("dice"), r["license"].alias("license"))).alias("runs"),
    )
    every = F.concat(F.array_compact(F.array_append("lines", F.col("whole"))), "runs")
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda m: m["license"]))), ",").alias("licenses"),
        F.array_max(F.transform(every, lambda m: m["dice"])).alias("best_dice"),
    )
