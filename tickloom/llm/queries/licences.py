"""Operator 2: licences of ``documents``, laid out as a file tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import licences
from tickloom.llm.registry import Tables, query

# Short forms of licence headers and of the first lines of licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = "regexp_extract_all(" + LOWERED + ", '[a-z0-9]+(?:[.+-][a-z0-9]+)*')"
SQL = f"""WITH t(no, licence, text) AS (VALUES {", ".join(f"({i}, '{n}', '{x}')" for i, (n, x) in enumerate(TEMPLATES))}),
    tt AS (SELECT no, licence, unnest({TERMS.format("text")}) AS term FROM t),
    d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, coalesce(length(text) <= 600 AND regexp_matches(text, '(?i)\\blicen[cs]ed?\\b'), false) AS short FROM documents),
    f AS (SELECT doc_id, text, short, concat_ws('/', source, lang, CASE WHEN short AND doc_id % 2 = 0 THEN NULL ELSE (doc_id // 64)::VARCHAR END) AS dir,
        CASE WHEN short THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name FROM d),
    n AS (SELECT count(*) AS n FROM f),
    df AS (SELECT term, count(*) AS k FROM (SELECT DISTINCT doc_id, unnest({TERMS.format("text")}) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY 1),
    idf AS (SELECT term, ln((1 + n) / (1 + coalesce(k, 0))) + 1 AS w FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
    tw AS (SELECT no, licence, term, count(*) * any_value(w) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
    tn AS (SELECT no, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY no)) AS w FROM tw),
    s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+')) AS piece FROM f UNION ALL SELECT doc_id, text FROM f WHERE short),
    p AS (SELECT doc_id, row_number() OVER () AS k, piece FROM s),
    c AS (SELECT doc_id, k, term, count(*) AS tf FROM (SELECT doc_id, k, unnest({TERMS.format("piece")}) AS term FROM p) GROUP BY ALL),
    v AS (SELECT doc_id, k, term, tf * coalesce(w, (SELECT ln(1 + n) + 1 FROM n)) AS x FROM c LEFT JOIN idf USING (term)),
    z AS (SELECT k, sqrt(sum(x * x)) AS size FROM v GROUP BY 1),
    sc AS (SELECT v.doc_id, licence, round(sum(x * w) / any_value(size), 6) AS score FROM v JOIN tn USING (term) JOIN z USING (k) GROUP BY v.doc_id, k, no, licence),
    own AS (SELECT doc_id, arg_min(licence, (-score, licence)) AS licence, max(score) AS score FROM sc WHERE score >= 0.6 GROUP BY 1),
    of_dir AS (SELECT dir AS ancestor, arg_min(licence, (-score, licence)) AS from_dir FROM f JOIN own USING (doc_id) WHERE short GROUP BY 1),
    near AS (SELECT dir, arg_max(from_dir, length(ancestor)) AS from_dir, arg_max(ancestor, length(ancestor)) AS origin
        FROM (SELECT DISTINCT dir FROM f) JOIN of_dir ON dir = ancestor OR starts_with(dir, ancestor || '/') OR ancestor = '' GROUP BY 1)
    SELECT doc_id, dir || '/' || name AS path, coalesce(licence, from_dir) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'own' WHEN from_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
        CASE WHEN licence IS NULL THEN origin END AS origin FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)"""


@query("op2_licence_scan", "op2", SQL)
def op2_licence_scan(t: Tables):
    """The tree: a folder per source and language with folders of 64 consecutive ids. A short text (at
    most 600 characters) with the word licence or license is a licence file, of a language's folder
    where the id is even and of an id folder where it is odd; the rest are text files."""
    short = (F.length("text") <= 600) & F.col("text").rlike(r"(?i)\blicen[cs]ed?\b")
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.when(short & (F.col("doc_id") % 2 == 0), F.lit(None)).otherwise(F.floor(F.col("doc_id") / 64).cast("string"))
    path = F.concat_ws("/", "source", "lang", folder, name)
    return licences.scan(t.documents.select("doc_id", path.alias("path"), "text"), TEMPLATES, keep=("doc_id",))
