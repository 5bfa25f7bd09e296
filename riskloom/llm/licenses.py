"""Licence recognition by sentences, in Spark expressions only.

A text is cut into sentences, each in a normal form of lower-case words. Known sentences give
identifiers; a text becomes the sequence of its identifiers, and ordered rules take runs of them
as a licence. A rule uses up the sentences it takes, so that longer rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licences: identifier -> pattern of the normal form. First fit counts.
SENTENCES = {
    "mit_grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit_notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis_caps": r"the software is provided as is without warranty of any kind express or implied",
    "mit_liability": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    "isc_grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_asis": r"the software is provided as is and the author disclaims all warranties with regard to this software",
    "bsd_grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": r"redistributions of source code must retain the above copyright notice",
    "bsd_binary": r"redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": r"neither the name of .* may be used to endorse or promote products derived from this software",
    "bsd_advert": r"all advertising materials mentioning features or use of this software must display",
    "bsd_asis": r"this software is provided by .* as is and any express or implied warranties",
    "apache2_under": r"(licensed|released|distributed) under the apache (software )?license v(ersion)? ?2( 0)?",
    "apache2_may": r"you may not use this file except in compliance with the license",
    "apache2_copy": r"you may obtain a copy of the license at",
    "apache2_asis": r"software distributed under the license is distributed on an as is basis",
    "agpl3_under": r"gnu affero general public license (as published by the free software foundation )?(either )?v(ersion )?3",
    "lgpl3_under": r"gnu lesser general public license (as published by the free software foundation )?(either )?v(ersion )?3",
    "lgpl21_under": r"gnu lesser general public license (as published by the free software foundation )?(either )?v(ersion )?2 1",
    "gpl3_under": r"gnu general public license (as published by the free software foundation )?(either )?v(ersion )?3",
    "gpl2_under": r"gnu general public license (as published by the free software foundation )?(either )?v(ersion )?2",
    "gpl_free": r"this program is free software you can redistribute it and or modify",
    "gpl_hope": r"this (program|library) is distributed in the hope that it will be useful",
    "gpl_copy": r"you should have received a copy of the gnu general public license",
    "mpl2_under": r"(subject to the terms of|licensed under) the mozilla public license v(ersion)? ?2 0",
    "epl2_under": r"(made available|licensed) under the (terms of the )?eclipse public license v?(ersion )?2 0",
    "cc0_under": r"(creative commons zero|cc0 1 0|cc0 public domain dedication)",
    "ccbyncnd4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by nc nd|creative commons attribution non ?commercial no ?deriv(ative)?s)( 4 0)?",
    "ccbyncsa4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by nc sa|creative commons attribution non ?commercial share ?alike)( 4 0)?",
    "ccbync4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by nc|creative commons attribution non ?commercial)( 4 0)?",
    "ccbysa4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by sa|creative commons attribution share ?alike)( 4 0)?",
    "ccbynd4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by nd|creative commons attribution no ?deriv(ative)?s)( 4 0)?",
    "ccby4_under": r"(licensed|released|available|distributed) under (a |the )?(cc by|creative commons attribution)( 4 0)?",
    "mit_under": r"(licensed|released|distributed|available) under (the )?(terms of the )?mit license",
    "bsd3_under": r"(licensed|released|distributed) under (the )?(3 clause bsd|bsd 3 clause|new bsd) license",
    "bsd2_under": r"(licensed|released|distributed) under (the )?(2 clause bsd|bsd 2 clause|simplified bsd) license",
    "isc_under": r"(licensed|released|distributed) under (the )?isc license",
    "unlicense_free": r"this is free and unencumbered software released into the public domain",
    "all_rights": r"all rights reserved",
    "copyright_line": r"^copyright (c )?([0-9]{4}|by )",
}
#: Licence and the identifiers it takes in order, tried from the first rule to the last.
RULES = [
    ("MIT", "mit_grant mit_notice asis_caps mit_liability"), ("MIT", "mit_grant mit_notice asis_caps"), ("MIT", "mit_grant mit_notice"),
    ("BSD-4-Clause", "bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse"), ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_endorse bsd_asis"),
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_endorse"), ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary bsd_asis"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary"), ("ISC", "isc_grant isc_asis"), ("ISC", "isc_grant"),
    ("Apache-2.0", "apache2_under apache2_may apache2_copy apache2_asis"), ("Apache-2.0", "apache2_under apache2_may apache2_copy"),
    ("Apache-2.0", "apache2_under"), ("GPL-3.0-or-later", "gpl_free gpl3_under"), ("GPL-2.0-or-later", "gpl_free gpl2_under"),
    ("AGPL-3.0", "agpl3_under"), ("LGPL-3.0", "lgpl3_under"), ("LGPL-2.1", "lgpl21_under"), ("GPL-3.0", "gpl3_under"), ("GPL-2.0", "gpl2_under"),
    ("MPL-2.0", "mpl2_under"), ("EPL-2.0", "epl2_under"), ("CC0-1.0", "cc0_under"), ("CC-BY-NC-ND-4.0", "ccbyncnd4_under"),
    ("CC-BY-NC-SA-4.0", "ccbyncsa4_under"), ("CC-BY-NC-4.0", "ccbync4_under"), ("CC-BY-SA-4.0", "ccbysa4_under"), ("CC-BY-ND-4.0", "ccbynd4_under"),
    ("CC-BY-4.0", "ccby4_under"), ("MIT", "mit_under"), ("BSD-3-Clause", "bsd3_under"), ("BSD-2-Clause", "bsd2_under"), ("ISC", "isc_under"),
    ("Unlicense", "unlicense_free"),
]
# Words of which every known sentence has one; other sentences are not looked at further.
GATE_WORDS = (
    "license", "licence", "copyright", "warrant", "permission", "redistribut", "rights reserved", "free software", "unencumbered",
    "advertising materials", "neither the name", "hope that it", "cc0", "creative commons", "under cc by", "under a cc by", "under the cc by",
)
GATE = "|".join(GATE_WORDS)
# The same for a whole text before it is cut: plain search is much cheaper than a pattern.
TEXT_WORDS = (
    "license", "licence", "copyright", "warrant", "permission", "redistribut", "rights", "software", "unencumbered", "advertising", "neither",
    "hope", "cc0", "creative",
)
# Two words of a normal form may stand apart by anything but letters and digits.
TEXT_PATTERN = "cc[^a-z0-9]+by"
# Ends of sentences: closing punctuation before white space, a blank line, or a line end before a capitalised word.
ENDS = r"[.!?;]+\s+|\n\s*\n|\n(?=[A-Z][a-z])"


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _identifier(sentence: Column) -> Column:
    out = None
    for name, pattern in SENTENCES.items():
        hit = sentence.rlike(pattern if pattern.startswith("^") else rf"\b(?:{pattern})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; empty for a null text."""
    gated = F.filter(F.transform(F.split(text, ENDS), normal_form), lambda s: s.rlike(GATE))
    known = F.filter(F.transform(gated, _identifier), lambda x: x.isNotNull())
    lower = F.lower(text)
    hit = reduce(lambda x, y: x | y, [F.contains(lower, F.lit(w)) for w in TEXT_WORDS]) | (F.contains(lower, F.lit("cc")) & lower.rlike(TEXT_PATTERN))
    return F.when(hit, known).otherwise(F.array().cast("array<string>"))


def licences(sequence: Column) -> Column:
    """struct<rest, found>: licences whose rules match runs of the sequence, in rule order, and the identifiers that none took."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(ids.split()) + "|").alias("run")) for name, ids in RULES])
    joined = F.concat(F.lit("|"), F.array_join(F.transform(sequence, lambda x: F.concat(x, F.lit("|"))), ""))
    start = F.struct(joined.alias("rest"), F.array().cast("array<string>").alias("found"))
    take = lambda acc, rule: F.when(
        F.contains(acc["rest"], rule["run"]),
        F.struct(F.replace(acc["rest"], rule["run"], F.lit("|")).alias("rest"), F.array_union(acc["found"], F.array(rule["name"])).alias("found"))).otherwise(acc)
    return F.aggregate(rules, start, take)


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences, licenses and status of every row of ``docs``
    (doc_id, text; other columns are ignored).

    sentences holds the identifiers in order and licenses the names in rule order, both joined by
    one blank. status is ``none`` without a known sentence, ``known`` if a rule matched and ``unknown``
    otherwise. Null and empty texts have none. A licence named twice is listed once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.col("text")).alias("ids"))
    found = F.when(F.size("ids") > 0, licences(F.col("ids"))["found"]).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("found", found)
    status = F.when(F.size("ids") == 0, "none").when(F.size("found") > 0, "known").otherwise("unknown")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentences"),
        F.array_join("found", " ").alias("licenses"), status.alias("status"))


def duckdb_sql() -> str:
    """The same in DuckDB, over the table documents."""
    case = " ".join(
        "WHEN regexp_matches(s, '{}') THEN '{}'".format(p if p.startswith("^") else rf"\b(?:{p})\b", n) for n, p in SENTENCES.items())
    ends = "[.!?;]+[ \\t\\n\\x0B\\f\\r]+|\\n[ \\t\\n\\x0B\\f\\r]*\\n"
    steps = "joined"
    sql_steps = []
    for i, (name, ids) in enumerate(RULES):
        run = "|" + "|".join(ids.split()) + "|"
        sql_steps.append(f"s{i} AS (SELECT doc_id, ids, replace(rest, '{run}', '|') AS rest, CASE WHEN contains(rest, '{run}') AND NOT list_contains(found, '{name}') "
                         f"THEN list_append(found, '{name}') ELSE found END AS found FROM {steps})")
        steps = f"s{i}"
    return f"""
WITH cut AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\n([A-Z][a-z])', '. \\1', 'g'), '{ends}') AS parts FROM documents),
normal AS (SELECT doc_id, [trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) for x in coalesce(parts, [])] AS parts FROM cut),
known AS (SELECT doc_id, [CASE {case} END for s in parts if regexp_matches(s, '{GATE}')] AS ids FROM normal),
kept AS (SELECT doc_id, [x for x in ids if x IS NOT NULL] AS ids FROM known),
joined AS (SELECT doc_id, ids, '|' || coalesce(list_aggregate([x || '|' for x in ids], 'string_agg', ''), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM kept),
{", ".join(sql_steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentences, coalesce(array_to_string(found, ' '), '') AS licenses,
  CASE WHEN len(ids) = 0 THEN 'none' WHEN len(found) > 0 THEN 'known' ELSE 'unknown' END AS status FROM {steps}"""
