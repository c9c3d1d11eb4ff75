"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A row with a licence word is cut into sentences; those with such a word are header candidates, and so are the sentences
of its paragraphs with the line ends joined, runs of up to ``LINES`` neighbouring lines and its comment blocks, so that
wrapped notices count; the whole text is a licence-file candidate. Whole texts and comment blocks also meet the complete
licence texts of licence_texts, from ``TEXT`` on; an SPDX tag names its licences itself, with score 1. Candidates become sparse vectors, term counts times the inverse document frequency of the term
among the templates (terms that no template has weigh most), and meet the templates' few hundred terms in a broadcast
join; the cosine is a sum by candidate and template. A header takes its best template from ``HEADER`` on; a text is a licence file from ``FILE`` on, or
from ``HEADER`` on if its name says so. Each directory takes its best licence file; each distinct directory looks for
the nearest ancestor, itself first, that has one, by joins on path prefixes; rows without a header licence inherit it.

Defined results: null and empty texts declare nothing but may inherit; null paths count as the root's; a row is known by
id and path together (nulls equal), so rows that repeat both share the best of their licences. Equal cosines go to the
licence first in alphabet, then to the first path; so do the licences of an SPDX expression. An SPDX id that no template has stays
as written; -only, -or-later and + are left out. The SQL knows the sentences and short notices alone. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import documents, text_of, written
from caselode.llm.licence_texts import TEXTS

HEADER, FILE = 0.5, 0.5
#: Least cosine to a complete text, where everyday words weigh more than in a notice, and most lines of a wrapped notice.
TEXT, LINES = 0.8, 4

#: SPDX ids and the notices usual for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal public domain dedication license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Words without which a sentence is no candidate, and names of licence files.
TRIGGER = "licen[cs]|copyright|permission is hereby|spdx"
FILE_NAME = "(?i)^(licen[cs]e|copying|notice)(\\.(txt|md))?$"
#: Comment blocks: lines that begin with a marker, or what stands between two; and SPDX expressions.
BLOCK = r"(?m)(?:^[ \t]*+(?:#|//|--|;|%|\*|dnl\b|rem\b)[^\n]*+\n?)++|/\*(?:[^*]|\*(?!/))*+|<!--(?:[^-]|-(?!->))*+"
SPDX_ID = r"[(]*[A-Za-z0-9][A-Za-z0-9.+-]*+[)]*"
SPDX = rf"(?i)SPDX-License-Identifier[ \t]*:[ \t]*({SPDX_ID}(?:[ \t]+(?:and|or|with)[ \t]+{SPDX_ID})*+)"


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def notices() -> list[tuple[str, Counter]]:
    return [(name, Counter(terms(t))) for name, t in TEMPLATES]


def complete() -> list[tuple[str, Counter]]:
    """Licence and bag of terms of the complete texts."""
    return [(name, Counter({w: int(n) for w, _, n in (x.partition(":") for x in bag.split())})) for name, bag in TEXTS.items()]


def template_vectors(named: list[tuple[str, Counter]] | None = None) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """idf by term, that of all other terms, and (template, licence, term, weight) rows of unit vectors."""
    named = named or notices()
    bags = [b for _, b in named]
    seen = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(seen.items())}
    rows = []
    for i, (name, bag) in enumerate(named):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        rows += [(i, name, w, n * idf[w] / norm) for w, n in sorted(bag.items())]
    return idf, math.log(1 + len(bags)) + 1, rows


def candidates(rows: DataFrame) -> DataFrame:
    """id, path, seg (0: the whole text, 1 on: a header candidate, below 0: a comment block) and its text."""
    low = F.lower("text")
    marked = rows.where(low.rlike(TRIGGER)).select("id", "path", low.alias("low"), F.split(low, "[\r\n]+").alias("lines"))
    split = lambda text: F.split(F.regexp_replace(text, r"([.!?;])[ \t\r\n\f]+", "$1\n"), "[\r\n]+")
    # paragraphs end at lines without a letter or digit; a NUL stands for their ends while line ends become blanks
    joined = F.regexp_replace(F.regexp_replace("low", r"\n[^\p{L}\p{N}\n]*+\n", "\0"), r"[\r\n]+", " ")
    wrapped = F.flatten(F.transform(F.split(joined, "\0"), split))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(TRIGGER))
    run = lambda i, n, up: F.array_join(F.slice("lines", F.greatest(F.lit(1), i - up), F.least(F.lit(n), n + i - up - 1)), " ")
    runs = F.flatten(F.transform(at, lambda i: F.array(*[run(i, n, up) for n in range(2, LINES + 1) for up in range(n)])))
    headers = F.array_distinct(F.filter(F.concat(split(F.col("low")), wrapped, runs), lambda s: s.rlike(TRIGGER)))
    blocks = F.array_distinct(F.filter(F.regexp_extract_all("low", F.lit(BLOCK), F.lit(0)), lambda s: s.rlike(TRIGGER)))
    cut = marked.select("id", "path", "low", headers.alias("headers"), blocks.alias("blocks"))
    part = lambda seg, text: F.struct(seg.cast("int").alias("seg"), text.alias("part"))
    parts = F.concat(F.array(part(F.lit(0), F.col("low"))), F.transform("headers", lambda p, i: part(i + 1, p)), F.transform("blocks", lambda p, i: part(-i - 1, p)))
    return cut.select("id", "path", F.explode(parts).alias("c")).select("id", "path", "c.*")


def tags(rows: DataFrame) -> DataFrame:
    """id, path, licence and score 1 of every licence that an SPDX tag names."""
    same = F.create_map(*[F.lit(x) for name in sorted({n for n, _ in TEMPLATES} | set(TEXTS)) for x in (name.lower(), name)])
    found = rows.where(F.col("text").rlike("(?i)spdx")).select("id", "path", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("x"))
    plain = F.regexp_replace("x", r"(?i)[ \t]+with[ \t]+[^ \t()]+", "")
    ids = found.select("id", "path", F.explode(F.split(plain, r"(?i)[ \t()]+(?:and|or)[ \t()]+")).alias("x"))
    name = F.regexp_replace(F.regexp_replace("x", "^[(]+|[.)-]+$", ""), "(?i)(-only|-or-later|[+])$", "")
    return ids.select("id", "path", F.coalesce(same[F.lower(name)], name).alias("licence"), F.lit(1.0).alias("score")).distinct()


def cosines(found: DataFrame, named: list[tuple[str, Counter]]) -> DataFrame:
    """id, path, seg, licence and score: the best template's cosine for each candidate."""
    spark = found.sparkSession
    idf, other, vectors = template_vectors(named)
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    template = spark.createDataFrame(vectors, "template int, licence string, term string, weight double")
    key = ["id", "path", "seg"]
    counted = found.select(*key, F.explode(F.regexp_extract_all("part", F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    per = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("terms"))
    dots = per.select(*key, "norm", F.explode("terms").alias("t")).join(F.broadcast(template), F.col("t.term") == F.col("term"))
    scores = dots.groupBy(*key, "norm", "template", "licence").agg(F.sum(F.col("t.w") * F.col("weight")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 4)
    return scores.groupBy(*key).agg(F.min(F.struct(-score, "licence")).alias("best")).select(*key, F.col("best.licence"), (-F.col("best.col1")).alias("score"))


def directory(path: Column) -> Column:
    """The path without its last part; the root's is empty."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, path, licence, score, how (header, file, inherited or none) and from_path."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), text_of(text_col).alias("text"))
    found = candidates(rows)
    best = cosines(found, notices())
    whole = cosines(found.where("seg <= 0"), complete()).where(F.col("score") >= TEXT)
    columns = ["id", "path", "licence", "score"]
    headers = best.where((F.col("seg") != 0) & (F.col("score") >= HEADER)).select(*columns).union(whole.where("seg < 0").select(*columns)).union(tags(rows))
    header = headers.groupBy("id", "path").agg(F.min(F.struct(-F.col("score"), "licence")).alias("h"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    file = best.where((F.col("seg") == 0) & (F.col("score") >= F.when(name.rlike(FILE_NAME), HEADER).otherwise(FILE))).select(*columns).union(whole.where("seg = 0").select(*columns)).distinct()
    declared = file.groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct(-F.col("score"), "licence", "path")).alias("f"))
    keys = rows.select("id", "path").withColumn("dir", directory(F.col("path")))
    parts = F.split("dir", "/")
    up = keys.select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = up.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("above"))
    near = written(above.join(declared, "above").groupBy("dir").agg(F.max_by("f", "depth").alias("f")), "near")
    own = header.withColumnsRenamed({"id": "h_id", "path": "h_path"})
    joined = keys.join(own, keys.id.eqNullSafe(own.h_id) & (keys.path == own.h_path), "left").join(near, "dir", "left")
    how = F.when(F.col("h").isNotNull(), "header").when(F.col("f.path") == F.col("path"), "file").when(F.col("f").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("h.licence", "f.licence").alias("licence"), (-F.coalesce("h.col1", "f.col1")).alias("score"),
        how.alias("how"), F.when(F.col("h").isNotNull(), F.col("path")).otherwise(F.col("f.path")).alias("from_path"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, whose paths are source/lang/doc_id."""
    return scan(documents(spark, sf_dir), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sql() -> str:
    """The same in DuckDB's SQL."""
    idf, other, vectors = template_vectors()
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    return f"""
WITH rows_ AS (SELECT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(doc_id::VARCHAR, '')) AS path, lower(coalesce(text, '')) AS low FROM documents),
idf(term, idf) AS (VALUES {values(sorted(idf.items()))}),
template(template, licence, term, weight) AS (VALUES {values(vectors)}),
marked AS (SELECT * FROM rows_ WHERE regexp_matches(low, '{TRIGGER}')),
segments AS (
  SELECT doc_id, path, 0 AS seg, low AS part FROM marked
  UNION ALL
  SELECT DISTINCT doc_id, path, 1, part FROM (SELECT doc_id, path, unnest(regexp_split_to_array(regexp_replace(low, '([.!?;])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')) AS part FROM marked)
  WHERE regexp_matches(part, '{TRIGGER}')),
counted AS (SELECT doc_id, path, seg, part, term, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(part, '[a-z0-9]+')) AS term FROM segments) GROUP BY ALL),
weighed AS (SELECT c.*, tf * coalesce(i.idf, {other!r}) AS w FROM counted c LEFT JOIN idf i USING (term)),
norms AS (SELECT doc_id, path, seg, part, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT w.doc_id, w.path, w.seg, w.part, t.template, t.licence, sum(w.w * t.weight) AS dot FROM weighed w JOIN template t USING (term) GROUP BY ALL),
scores AS (SELECT d.doc_id, d.path, d.seg, d.licence, round(dot / norm, 4) AS score FROM dots d JOIN norms n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.path = n.path AND d.seg = n.seg AND d.part = n.part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path, seg ORDER BY score DESC, licence) AS place FROM scores),
header AS (SELECT * FROM ranked WHERE seg = 1 AND place = 1 AND score >= {HEADER}),
file AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS above FROM ranked WHERE seg = 0 AND place = 1 AND score >= {FILE}),
declared AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY above ORDER BY score DESC, licence, path) AS first FROM file) WHERE first = 1),
near AS (
  SELECT r.doc_id, r.path, f.licence, f.score, f.path AS from_path, row_number() OVER (PARTITION BY r.doc_id, r.path ORDER BY length(f.above) DESC) AS nearest
  FROM rows_ r JOIN declared f ON starts_with(r.path, f.above || '/'))
SELECT r.doc_id, r.path, coalesce(h.licence, n.licence) AS licence, coalesce(h.score, n.score) AS score,
  CASE WHEN h.licence IS NOT NULL THEN 'header' WHEN n.from_path = r.path THEN 'file' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN h.licence IS NOT NULL THEN r.path ELSE n.from_path END AS from_path
FROM rows_ r LEFT JOIN header h ON r.doc_id IS NOT DISTINCT FROM h.doc_id AND r.path = h.path
LEFT JOIN near n ON r.doc_id IS NOT DISTINCT FROM n.doc_id AND r.path = n.path AND n.nearest = 1
"""


OP2_SQL = sql()
