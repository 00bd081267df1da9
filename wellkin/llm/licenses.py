"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences; a sentence is brought to a normal form (ASCII lower case, every
run of other characters one blank) and looked up among the known license sentences.  The
identifiers found, in text order, form a sequence; a license rule is an ordered list of
identifiers and matches where they follow each other in that sequence.

Defined results: null and empty texts have no sentences and no license; repeated sentences
appear repeatedly in the sequence; a rule that matches twice is reported once; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus

#: Known sentences in normal form, by identifier.  Fixed values: public license wordings.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this"
    " software and associated documentation files the software to deal in the software without"
    " restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all"
    " copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-ref-the": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under"
    " the terms of the gnu general public license as published by the free software foundation"
    " either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any"
    " warranty without even the implied warranty of merchantability or fitness for a particular"
    " purpose",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without"
    " modification are permitted provided that the following conditions are met",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights": "all rights reserved",
}

#: License rules: identifiers that follow each other in a text's sequence.
RULES = (
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-grant")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-ref-the", "apache2-use")),
    ("Apache-2.0", ("apache2-use", "apache2-obtain")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl3-ref-2",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD", ("bsd-redistribute", "bsd-as-is")),
    ("MPL-2.0", ("mpl2-ref",)),
    ("all-rights-reserved", ("all-rights",)),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at a line end, or at . ! ? ; : before white space or the end.
_ENDS = r"[.!?;:]+([ \t\r\n]|$)"
_MARK = "\n"
#: Every known sentence has one of these words, so a text without them needs no cutting.
TRIGGERS = ("license", "copyright", "warranty", "permission", "redistribut", "reserved")


def sentences(text: Column) -> Column:
    """Sentences in normal form, in text order, empty ones included."""
    cut = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _ENDS, _MARK)
    plain = F.regexp_replace(cut, "[^a-z0-9\n]+", " ")
    return F.transform(F.split(plain, _MARK), lambda s: F.trim(s))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in text order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    # Most sentences are dropped by their length before any lookup.
    lengths = sorted({len(s) for s in SENTENCES.values()})
    candidate = F.filter(sentences(text), lambda s: F.length(s).isin(lengths))
    found = F.filter(F.transform(candidate, lambda s: known[s]), lambda i: i.isNotNull())
    low = F.lower(text)
    possible = reduce(or_, [F.contains(low, F.lit(word)) for word in TRIGGERS])
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def licenses(sequence: Column) -> Column:
    """Names of the licenses whose rule matches an identifier sequence, sorted."""
    joined = F.concat(F.lit("|"), F.array_join(sequence, "|"), F.lit("|"))
    hits = [
        F.when(joined.contains("|" + "|".join(ids) + "|"), F.lit(name)) for name, ids in RULES
    ]
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda n: n.isNotNull())))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses, both joined by commas."""
    found = docs.select("doc_id", identifiers(F.col("text")).alias("ids"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(licenses(F.col("ids")), ",").alias("licenses"),
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '|{'|'.join(ids)}|')" for name, ids in RULES)
    return rf"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r,
    string_split(regexp_replace(regexp_replace(
      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '{_ENDS}', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS s
  FROM documents),
sentence AS (SELECT doc_id, r, unnest(list_transform(s, lambda x: trim(x))) AS s,
  generate_subscripts(s, 1) AS place FROM cut),
known(s, id) AS (VALUES {known}),
rules(license, ids) AS (VALUES {rules}),
found AS (
  SELECT r, any_value(doc_id) AS doc_id, count(id) AS n_sentences,
    coalesce(string_agg(id, '|' ORDER BY place) FILTER (id IS NOT NULL), '') AS ids
  FROM sentence LEFT JOIN known USING (s) GROUP BY r)
SELECT doc_id, n_sentences, replace(ids, '|', ',') AS sentence_ids,
  coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM rules
    WHERE contains('|' || found.ids || '|', rules.ids)), '') AS licenses
FROM found"""


ORACLE = {"op2_licenses": _oracle()}
