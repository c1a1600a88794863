"""Licence scan by sentence rules, in native expressions only.

Comment marks are stripped, wrapped lines joined, and a text is cut into sentences at sentence ends and blank lines. Each
sentence is normalised and looked up in a table of known licence sentences: first whole, then line by line, then by the phrases it
holds. The identifiers, in text order, are matched against ordered licence rules: a rule that matches takes its identifiers out of
the sequence, so that a longer licence wins over the shorter ones within it. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked

#: Known sentences, already normalised (lower case, letters, digits, dots, dashes and single spaces).
SENTENCES = {
    "GplLine": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3", "gnu general public license version 3 29 june 2007"],
    "Gpl2Line": ["gnu general public license version 2 june 1991", "licensed under the gnu general public license version 2"],
    "LgplLine": ["gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 2.1 february 1999"],
    "AgplLine": ["gnu affero general public license version 3 19 november 2007"],
    "CcByNc": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CcBySa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CcBy": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "Cc0Line": ["cc0 1.0 universal", "creative commons cc0 1.0 universal", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "MitLine": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "mit license", "the mit license", "the mit license mit"],
    "ApacheLine": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "apache license version 2.0 january 2004", "apache license 2.0"],
    "ApacheMayNot": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license-2.0"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "MitGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdNoEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "GplFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Gpl2Free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "LgplFree": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "AgplFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "MplForm": ["this source code form is subject to the terms of the mozilla public license v", "mozilla public license version 2.0"],
    "UnlicenseFree": ["this is free and unencumbered software released into the public domain"],
    "UnlicenseAnyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "ZlibAsIs": ["this software is provided as-is without any express or implied warranty"],
    "ZlibGrant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "BoostLine": ["boost software license - version 1.0 - august 17th 2003", "distributed under the boost software license version 1.0"],
    "AllRights": ["all rights reserved"],
    "PublicDomain": ["this work is in the public domain", "released into the public domain"],
}
#: Phrases by which a sentence counts that isn't known whole, in order of precedence.
PHRASES = (
    ("spdx-license-identifier apache-2.0", "ApacheLine"), ("spdx-license-identifier mit", "MitLine"), ("spdx-license-identifier agpl-3.0", "AgplLine"), ("spdx-license-identifier lgpl-", "LgplLine"), ("spdx-license-identifier gpl-2.0", "Gpl2Line"),
    ("spdx-license-identifier gpl-3.0", "GplLine"), ("spdx-license-identifier mpl-2.0", "MplForm"), ("spdx-license-identifier isc", "IscGrant"), ("spdx-license-identifier bsd-3-clause", "Bsd3Line"), ("spdx-license-identifier bsd-2-clause", "Bsd2Line"),
    ("spdx-license-identifier cc0-1.0", "Cc0Line"), ("spdx-license-identifier unlicense", "UnlicenseFree"), ("spdx-license-identifier zlib", "ZlibGrant"), ("spdx-license-identifier bsl-1.0", "BoostLine"),
    ("under the mit license", "MitLine"), ("under the terms of the mit license", "MitLine"), ("under the apache license version 2.0", "ApacheLine"), ("under the apache license 2.0", "ApacheLine"), ("under apache 2.0", "ApacheLine"),
    ("under the gnu affero general public license", "AgplLine"), ("under the gnu lesser general public license", "LgplLine"), ("under the gnu general public license version 2", "Gpl2Line"), ("under the gnu general public license version 3", "GplLine"),
    ("under the gnu general public license v2", "Gpl2Line"), ("under the gnu general public license v3", "GplLine"), ("under the mozilla public license", "MplForm"), ("under the isc license", "IscGrant"), ("under the boost software license", "BoostLine"),
    ("under the zlib license", "ZlibGrant"), ("under the unlicense", "UnlicenseFree"), ("under the 3-clause bsd license", "Bsd3Line"), ("under the bsd 3-clause license", "Bsd3Line"), ("under the 2-clause bsd license", "Bsd2Line"), ("under the bsd 2-clause license", "Bsd2Line"),
    ("under cc by-nc 4.0", "CcByNc"), ("under cc by-sa 4.0", "CcBySa"), ("under cc by 4.0", "CcBy"), ("under cc0 1.0", "Cc0Line"), ("into the public domain", "PublicDomain"), ("all rights reserved", "AllRights"),
)
#: Licences and the identifiers that must follow one another, in order of precedence.
RULES = (
    ("Apache-2.0", ("ApacheLine", "ApacheMayNot", "ApacheCopy", "ApacheAsIs")), ("Apache-2.0", ("ApacheLine", "ApacheMayNot", "ApacheCopy")), ("MIT", ("MitLine", "MitGrant", "MitNotice", "AsIs")), ("MIT", ("MitGrant", "MitNotice", "AsIs")), ("MIT", ("MitGrant", "MitNotice")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse")), ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")), ("BSD-3-Clause", ("Bsd3Line",)), ("BSD-2-Clause", ("Bsd2Line",)), ("ISC", ("IscGrant",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope")), ("AGPL-3.0-or-later", ("AgplFree",)), ("AGPL-3.0", ("AgplLine",)), ("LGPL-2.1-or-later", ("LgplFree",)), ("LGPL", ("LgplLine",)), ("GPL-3.0-or-later", ("GplFree", "GplHope")), ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope")), ("GPL-2.0-or-later", ("Gpl2Free",)), ("GPL-2.0", ("Gpl2Line",)), ("GPL-3.0", ("GplLine",)), ("MPL-2.0", ("MplForm",)), ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")), ("Unlicense", ("UnlicenseFree",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")), ("Zlib", ("ZlibGrant",)), ("BSL-1.0", ("BoostLine",)), ("CC0-1.0", ("Cc0Line",)), ("CC-BY-NC-4.0", ("CcByNc",)), ("CC-BY-SA-4.0", ("CcBySa",)), ("CC-BY-4.0", ("CcBy",)), ("Apache-2.0", ("ApacheLine",)), ("MIT", ("MitLine",)),
    ("Public-Domain", ("PublicDomain",)), ("Proprietary", ("AllRights",)),
)
#: What is replaced in the lower-cased text between two line ends, in turn: line ends and blanks made alike, marks of comments and quotes at the ends of a line,
#: the colon of a tag, the number of a list's item.
TIDY = (
    ("\\r\\n?|[\\x0B\\f]", "\n"), ("[\\t ]+", " "), ("\n ?(//+|/?[*]+/?|#+|;+|--+|<!--|>+|%+)? ?", "\n"), (" ?([*]+/|--+>|[*]+)? ?\n", "\n"),
    ("spdx-license-identifier ?: ?", "spdx-license-identifier "), ("\n[(]?([0-9]{1,2}|[a-z])[.)] ", "\n"),
)
#: Where one sentence ends and the next begins.
BREAK = "\n\n+|[.!?;:]+[ \n]+"
#: What every known sentence holds; texts without it are not cut at all.
HINT = "licen|rights[^a-z0-9.-]+reserved|public[^a-z0-9.-]+domain|permission|warrant|redistribut|copyright|obtain[^a-z0-9.-]+a[^a-z0-9.-]+copy|in[^a-z0-9.-]+compliance|under cc|cc0|anyone[^a-z0-9.-]+is[^a-z0-9.-]+free|unencumbered"


def known() -> dict[str, str]:
    return {s: k for k, sentences in SENTENCES.items() for s in sentences}


def normalised(sentence: Column) -> Column:
    return F.rtrim(F.trim(F.regexp_replace(sentence, "[^a-z0-9.-]+", " ")), F.lit(". "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array, in text order), licenses (array, in order of precedence, without repeats) of every
    whole text, of any length. Null or empty texts have empty arrays; repeated rows and null ids stay; an empty table gives an empty one;
    other columns are left out."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    text = F.concat(F.lit("\n"), F.lower("text"), F.lit("\n"))
    for pattern, by in TIDY:
        text = F.regexp_replace(text, pattern, by)

    def by_phrase(s: Column) -> Column:
        """Of a sentence that holds what all phrases hold."""
        said = F.coalesce(*(F.when(F.contains(s, F.lit(phrase)), F.lit(k)) for phrase, k in PHRASES))
        return F.when(F.contains(s, F.lit("under ")) | F.contains(s, F.lit("spdx-")) | F.contains(s, F.lit("public domain")) | F.contains(s, F.lit("rights reserved")), said)

    def ids_of(sentence: Column) -> Column:
        lines = F.filter(F.transform(F.split(sentence, "\n"), lambda line: table[normalised(line)]), lambda x: x.isNotNull())
        one = F.coalesce(table[normalised(sentence)], F.when(F.size(lines) == 0, by_phrase(normalised(sentence))))
        return F.when(one.isNotNull(), F.array(one)).otherwise(lines)

    found = F.when(F.lower("text").rlike(HINT), F.flatten(F.transform(F.filter(F.split(text, BREAK), lambda s: F.length(s) >= 9), ids_of)))
    out = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("sentence_ids"))
    out = out.withColumn("rest", F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")))
    hits = []
    for k, (license, ids) in enumerate(RULES):
        pattern = " " + "  ".join(ids) + " "
        out = out.withColumn(f"rule_{k}", F.contains("rest", F.lit(pattern))).withColumn("rest", F.when(F.col(f"rule_{k}"), F.replace("rest", F.lit(pattern), F.lit(" | "))).otherwise(F.col("rest")))
        hits.append(F.when(F.col(f"rule_{k}"), F.lit(license)))
    return out.select("doc_id", "sentence_ids", F.array_distinct(F.array_compact(F.array(*hits))).alias("licenses"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def report_sql() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"({quoted(s)}, {quoted(k)})" for s, k in known().items())
    steps, hits = [], {}
    for k, (license, ids) in enumerate(RULES):
        pattern = quoted(" " + "  ".join(ids) + " ")
        steps.append(f"r{k} AS (SELECT *, contains(rest_{k}, {pattern}) AS rule_{k}, replace(rest_{k}, {pattern}, ' | ') AS rest_{k + 1} FROM {f'r{k - 1}' if k else 'base'})")
        hits.setdefault(license, []).append(k)
    # the order of a licence is that of the first of its rules that matched
    pairs = ", ".join(f"{{'k': least({', '.join(f'CASE WHEN rule_{i} THEN {i} ELSE 999 END' for i in rules)}, 999), 'x': CASE WHEN {' OR '.join(f'rule_{i}' for i in rules)} THEN {quoted(license)} END}}" for license, rules in hits.items())
    tidy = "chr(10) || lower(text) || chr(10)"
    for pattern, by in TIDY:
        tidy = f"regexp_replace({tidy}, {quoted(pattern)}, {quoted(by)}, 'g')"
    clean = lambda c: f"rtrim(trim(regexp_replace({c}, '[^a-z0-9.-]+', ' ', 'g')), '. ')"
    phrase = "CASE " + " ".join(f"WHEN contains(s, {quoted(p)}) THEN {quoted(k)}" for p, k in PHRASES) + " END"
    return f"""WITH names(s, k) AS (VALUES {names}),
docs AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
cut AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT rid, string_split_regex({tidy}, {quoted(BREAK)}) AS parts FROM docs)),
whole AS MATERIALIZED (SELECT rid, pos, part, {clean("part")} AS s FROM cut WHERE length(part) >= 9),
exact AS (SELECT rid, pos, 0 AS line, k FROM whole JOIN names USING (s)),
left_over AS MATERIALIZED (SELECT * FROM whole ANTI JOIN exact USING (rid, pos)),
lines AS (SELECT rid, pos, line, k FROM (SELECT rid, pos, line, {clean("t")} AS s FROM (SELECT rid, pos, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT rid, pos, string_split(part, chr(10)) AS ls FROM left_over))) JOIN names USING (s)),
phrases AS (SELECT rid, pos, 0 AS line, {phrase} AS k FROM left_over ANTI JOIN lines USING (rid, pos)),
each AS (SELECT * FROM exact UNION ALL SELECT * FROM lines UNION ALL SELECT * FROM phrases WHERE k IS NOT NULL),
ids AS (SELECT rid, string_agg(k, ',' ORDER BY pos, line) AS ids, string_agg(k, '  ' ORDER BY pos, line) AS seq, count(*) AS n FROM each GROUP BY rid),
base AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(seq, '') || ' ' AS rest_0 FROM docs LEFT JOIN ids USING (rid)),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(list_transform(list_sort(list_filter([{pairs}], lambda p: p.x IS NOT NULL)), lambda p: p.x), ','), '') AS licenses FROM r{len(RULES) - 1}"""
