"""Licence scans: normalised units of text against templates by the Dice coefficient over
word bigrams. Column expressions only; every text is scanned where it lies, without a shuffle."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.spans import once

THRESHOLD = 0.8

# Notices and opening paragraphs of public licences (name, text).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_words(text: str) -> int:
    return len(re.sub("[^a-z0-9]+", " ", text.lower()).split())


def _bigrams(unit: Column) -> Column:
    """Word bigrams of a text in order: A-Z in lower case, anything but a-z and 0-9 parts words."""
    plain = F.trim(F.regexp_replace(F.translate(unit, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+", " "))
    return once(F.split(plain, " "), lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def find_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, n_units, found)``, one row per row of ``docs``.

    Units are the lines of a text and, if there are several, the whole text; beside them, for
    every template, the window of as many words as the template has, anywhere in the text and
    across its lines, that is most like it. found lists (unit, license, dice) of every unit and
    template whose Dice coefficient reaches ``threshold`` (above zero); unit 0 is the first
    line, the whole text comes after the lines, and the windows, one a template, are unit -1. A
    template is compared only where the two numbers of bigrams allow the threshold, with
    windows where the text has so many of its bigrams at all; a window begins at one of its
    bigrams (moved on to the next, it would lose none of them). Null and empty texts have one unit
    and no match; so have units of a single word. Further columns are ignored; an empty table
    gives an empty table."""
    known = [(name, template_bigrams(text), template_words(text) - 1) for name, text in templates]
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), F.array(*[F.lit(x) for x in b]).alias("bigrams"), F.lit(len(b)).alias("size"), F.lit(w).alias("window"))
        for n, b, w in known if b
    ])
    any_of = F.array(*[F.lit(x) for x in sorted({x for _, b, _ in known for x in b})])
    least = threshold / (2 - threshold)  # a share of the other's size that both must have

    def of_unit(unit: Column, at: Column) -> Column:
        def against(own: Column) -> Column:
            able = F.filter(table, lambda t: (F.size(own) >= t["size"] * least - 1e-9) & (t["size"] >= F.size(own) * least - 1e-9))
            return F.transform(able, lambda t: F.struct(
                at.alias("unit"), t["name"].alias("license"),
                (F.lit(2.0) * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + t["size"])).alias("dice")))

        return once(F.array_distinct(_bigrams(unit)), against)

    def windows(text: Column) -> Column:
        def best(own: Column, t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.array_contains(t["bigrams"], F.element_at(own, i)))
            return F.array_max(F.transform(starts, lambda i: once(
                F.array_distinct(F.slice(own, i, t["window"])),
                lambda w: F.lit(2.0) * F.size(F.array_intersect(w, t["bigrams"])) / (F.size(w) + t["size"]))))

        def of(own: Column) -> Column:
            return once(F.array_intersect(own, any_of), lambda there: F.transform(
                F.filter(table, lambda t: F.size(F.array_intersect(there, t["bigrams"])) >= t["size"] * least - 1e-9),
                lambda t: F.struct(F.lit(-1).alias("unit"), t["name"].alias("license"), best(own, t).alias("dice"))))

        return once(_bigrams(text), of)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    units = once(F.split(text, "\n", -1), lambda lines: F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), units.alias("units"), text.alias("_text"))
    every = F.concat(F.flatten(F.transform("units", of_unit)), windows(F.col("_text")))
    return rows.select(
        "doc_id", F.size("units").cast("long").alias("n_units"),
        F.filter(every, lambda m: m["dice"] >= threshold).alias("found"),
    )


def license_summary(docs: DataFrame, **parameters) -> DataFrame:
    """``(doc_id, n_units, n_matches, license, dice)``: the number of (unit, template)
    matches, and the best one's licence and coefficient, ties to the first name; null
    without a match."""
    best = F.element_at(F.array_sort(F.transform("found", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license")))), 1)
    return find_licenses(docs, **parameters).select(
        "doc_id", "n_units", F.size("found").cast("long").alias("n_matches"),
        F.when(F.size("found") > 0, best).alias("best"),
    ).select("doc_id", "n_units", "n_matches", F.col("best.license").alias("license"), F.round(-F.col("best.d"), 6).alias("dice"))


def summary_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same summary as DuckDB SQL."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    grams = """list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"""
    plain = "string_split(trim(regexp_replace(translate({}, '{}', '{}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    of = lambda c: plain.format(c, string.ascii_uppercase, string.ascii_lowercase)
    least = threshold / (2 - threshold)
    return f"""
    WITH t AS (SELECT name, row_number() OVER () AS id, len(w) - 1 AS n, list_distinct({grams}) AS b FROM (SELECT name, {of('body')} AS w FROM (VALUES {values}) v(name, body))),
    d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
    u AS (SELECT doc_id, CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END AS units FROM d),
    g AS (SELECT doc_id, list_distinct({grams}) AS a FROM (SELECT doc_id, {of('unit')} AS w FROM (SELECT doc_id, unnest(units) AS unit FROM u))),
    e AS (SELECT doc_id, {grams} AS a FROM (SELECT doc_id, {of('text')} AS w FROM d)),
    f AS (SELECT doc_id, a, id, name, b, n FROM (SELECT doc_id, a, list_distinct(a) AS s FROM e), t WHERE len(list_intersect(s, b)) >= len(b) * {least} - 1e-9),
    w AS (SELECT doc_id, id, name, b, list_distinct(a[i : i + n - 1]) AS x FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM f) WHERE list_contains(b, a[i])),
    m AS (SELECT doc_id, name, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t
          WHERE len(a) >= len(b) * {least} - 1e-9 AND len(b) >= len(a) * {least} - 1e-9
          UNION ALL SELECT doc_id, any_value(name), max(2.0 * len(list_intersect(x, b)) / (len(x) + len(b))) FROM w GROUP BY doc_id, id),
    k AS (SELECT doc_id, count(*) AS n_matches, min(struct_pack(d := -dice, license := name)) AS best FROM m WHERE dice >= {threshold} GROUP BY doc_id)
    SELECT u.doc_id, CAST(len(units) AS BIGINT) AS n_units, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches,
           best.license AS license, round(-best.d, 6) AS dice
    FROM u LEFT JOIN k ON u.doc_id = k.doc_id"""
