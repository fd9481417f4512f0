"""License scans by rules over sentences.

Sentences of a text are normalised and known ones are replaced by identifiers; others are 0. Rules, each a sequence of
identifiers, are tried in order; what a rule matches is used up. Texts are read twice: with every line end as the end
of a sentence, and, if they hold a word of a licence, with the lines of a paragraph joined, as notices are often
wrapped; the licences found in either count. The known sentences are cut from published notices by the same rules as
the texts. Made of SQL functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices by name, as published, in order of trial (a longer one before its parts).
NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A text with a known sentence has one of these words, whatever its case.
HINTS = "licen[sc]e|software|copyright|source code"


def sentences(text: str) -> list[str]:
    """Normalised sentences of a text whose lines are joined; the rules in SQL are the same."""
    t = re.sub("[.!?;:](?:[ \t-\r]+|$)", "\n", text)
    return [s for s in (x.strip() for x in re.sub("[^A-Za-z0-9\n]+", " ", t).lower().split("\n")) if s.strip("0123456789")]


SENTENCES = tuple(dict.fromkeys(s for _, notice in NOTICES for s in sentences(notice)))
#: Numbers count SENTENCES from 1.
RULES = tuple((name, tuple(SENTENCES.index(s) + 1 for s in sentences(notice))) for name, notice in NOTICES)


def _pattern(ids: tuple[int, ...]) -> str:
    return "".join(f",{i}," for i in ids)


def _used(rule: int) -> str:
    return f",R{rule},"


def _cut(t: str) -> str:
    """SQL of Spark: the normalised sentences of ``t``, ended by marks and line ends; bare numbers are none."""
    lines = rf"lower(regexp_replace(regexp_replace({t}, '[.!?;:](?:[ \\t-\\r]+|$)', '\n'), '[^A-Za-z0-9\\n]+', ' '))"
    return f"filter(transform(split({lines}, '\\n'), s -> trim(s)), s -> s <> '' AND translate(s, '0123456789', '') <> '')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_known, sentence_ids, licenses`` for each row.

    ``n_sentences``: of the text read line by line; ``sentence_ids``: identifiers of known sentences in order,
    comma-joined, of the text with joined lines if that has more of them; ``licenses``: names of the licences found in
    either, each once, sorted, comma-joined. A null text has no sentences and no licences; rows with equal or null ids
    each give a row; an empty table gives none; other columns do not matter.
    """
    known = "array(" + ", ".join(f"'{s}'" for s in SENTENCES) + ")"
    listed = ", ".join(f"'{s}'" for s in SENTENCES)
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    joined = _cut(r"regexp_replace(t, '([^\n])\n(?=[^\n])', '$1 ')")
    none = "CAST(array() AS array<string>)"
    df = df.selectExpr("doc_id", f"{_cut('t')} AS s", rf"CASE WHEN contains(t, '\n') AND t RLIKE '(?i){HINTS}' THEN {joined} ELSE {none} END AS j")
    # a list of this length is looked up by hash
    numbers = lambda x: f"CASE WHEN size({x}) = 0 THEN CAST(array() AS array<bigint>) ELSE transform({x}, x -> CASE WHEN x IN ({listed}) THEN array_position({known}, x) ELSE 0L END) END"
    df = df.selectExpr("doc_id", "size(s) AS n", f"{numbers('s')} AS p", f"{numbers('j')} AS p2")
    df = df.selectExpr("doc_id", "n", "p", "p2", "filter(p, i -> i > 0) AS k", "filter(p2, i -> i > 0) AS k2")
    # each identifier has a comma of its own on both sides, so neighbours meet as ',1,,2,'; a bar parts the two readings
    df = df.selectExpr("doc_id", "n", "CASE WHEN size(k2) > size(k) THEN k2 ELSE k END AS k", "CASE WHEN size(k) + size(k2) > 0 THEN concat(',', array_join(p, ',,'), ',|,', array_join(p2, ',,'), ',') ELSE '' END AS q0")
    for r, (_, ids) in enumerate(RULES):
        df = df.selectExpr("doc_id", "n", "k", f"CASE WHEN q{r} = '' THEN '' ELSE replace(q{r}, '{_pattern(ids)}', '{_used(r)}') END AS q{r + 1}")
    last = f"q{len(RULES)}"
    names = ", ".join(f"CASE WHEN contains({last}, '{_used(r)}') THEN '{name}' END" for r, (name, _) in enumerate(RULES))
    return df.selectExpr(
        "doc_id",
        "CAST(n AS LONG) AS n_sentences",
        "CAST(size(k) AS LONG) AS n_known",
        "array_join(k, ',') AS sentence_ids",
        f"CASE WHEN {last} = '' THEN '' ELSE array_join(array_sort(array_distinct(filter(array({names}), x -> x IS NOT NULL))), ',') END AS licenses",
    )


def scan_sql() -> str:
    """The same for DuckDB, over ``documents``."""
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    cut = lambda t: rf"list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace({t}, '[.!?;:](?:[ \t-\r]+|$)', chr(10), 'g'), '[^A-Za-z0-9\n]+', ' ', 'g')), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND translate(x, '0123456789', '') <> '')"
    numbers = lambda s: f"list_transform({s}, lambda x: coalesce(list_position({known}, x), 0))"
    steps = []
    for r, (_, ids) in enumerate(RULES):
        steps.append(f"r{r + 1} AS (SELECT doc_id, n, k, replace(q, '{_pattern(ids)}', '{_used(r)}') AS q FROM r{r})")
    last = f"r{len(RULES)}"
    names = ", ".join(f"CASE WHEN contains(q, '{_used(r)}') THEN '{name}' END" for r, (name, _) in enumerate(RULES))
    # a line end alone becomes a space; others are doubled, so that pairs of them are taken out whole
    joined = r"replace(replace(replace(t, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))"
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, {cut("t")} AS s, CASE WHEN contains(t, chr(10)) AND regexp_matches(t, '(?i){HINTS}') THEN {cut(joined)} ELSE [] END AS j FROM t),
        p AS (SELECT doc_id, len(s) AS n, {numbers("s")} AS p, {numbers("j")} AS p2 FROM s),
        k AS (SELECT doc_id, n, p, p2, list_filter(p, lambda i: i > 0) AS k, list_filter(p2, lambda i: i > 0) AS k2 FROM p),
        r0 AS (SELECT doc_id, n, CASE WHEN len(k2) > len(k) THEN k2 ELSE k END AS k,
                      CASE WHEN len(k) + len(k2) > 0 THEN ',' || coalesce(array_to_string(p, ',,'), '') || ',|,' || coalesce(array_to_string(p2, ',,'), '') || ',' ELSE '' END AS q FROM k),
        {", ".join(steps)}
        SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(len(k) AS BIGINT) AS n_known,
               coalesce(array_to_string(k, ','), '') AS sentence_ids,
               coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ','), '') AS licenses
        FROM {last}"""
