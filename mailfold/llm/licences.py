"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences after ``.``, ``;``, ``:``, ``!`` or ``?`` followed by
white space, and at line ends, unless the next line goes on in lower case (after
comment marks).  A sentence is normalised: A-Z lower-cased,
everything but letters and digits turned into single spaces, a leading comment
or list mark gone with it.  A normalised sentence that is known, or several that
are known when joined across single line ends (a notice may be wrapped before a
bracket, a capital or any mark), stands for a sentence identifier, the longest
first; the others stand for nothing.  A blank line is never joined.  The identifiers of a
document, in order, are matched against ordered rules: the rules are tried from
the longest and most specific to the shortest, and the identifiers that a rule
takes are used up, so "GPL version 3 or later" is not also "GPL version 3".
Identifiers left over are reported as unmatched.

Null and empty texts hold no sentence.  Every row is scanned by itself; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, let, require_columns

# Sentences of common licence notices (as people write them) and
# the identifier that each stands for.
SENTENCES = [
    ("MitRef", "Released under the MIT License."),
    ("MitRef", "Licensed under the MIT License."),
    ("MitRef", "This project is licensed under the MIT License."),
    ("MitRef", "The MIT License (MIT)"),
    ("MitRef", "MIT License"),
    ("MitRef", "SPDX-License-Identifier: MIT"),
    ("PermissionGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("NoticeIncluded", "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("AsIs", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("ApacheRef2", "Licensed under the Apache License, Version 2.0."),
    ("ApacheRef2", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("ApacheRef2", "This project is licensed under the Apache License, Version 2.0."),
    ("ApacheRef2", "Apache License, Version 2.0"),
    ("ApacheRef2", "SPDX-License-Identifier: Apache-2.0"),
    ("ApacheComply", "you may not use this file except in compliance with the License."),
    ("ApacheCopy", "You may obtain a copy of the License at"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License "
     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Gpl3Ref", "This work is licensed under the GNU General Public License, version 3."),
    ("Gpl3Ref", "Licensed under the GNU General Public License, version 3."),
    ("Gpl3Ref", "SPDX-License-Identifier: GPL-3.0-only"),
    ("Gpl3Plus", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("Gpl2Ref", "This work is licensed under the GNU General Public License, version 2."),
    ("Gpl2Ref", "Licensed under the GNU General Public License, version 2."),
    ("Gpl2Ref", "SPDX-License-Identifier: GPL-2.0-only"),
    ("Gpl2Plus", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("FreeSoftware", "This program is free software:"),
    ("FreeSoftware", "This program is free software;"),
    ("Gpl3Either", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version."),
    ("Gpl2Terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation;"),
    ("Gpl2Later", "either version 2 of the License, or (at your option) any later version."),
    ("GplHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("FreeLibrary", "This library is free software;"),
    ("Lgpl21Terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation;"),
    ("Lgpl21Later", "either version 2.1 of the License, or (at your option) any later version."),
    ("Lgpl3Either", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version."),
    ("Agpl3Either", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version."),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscRef", "SPDX-License-Identifier: ISC"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ZlibRef", "SPDX-License-Identifier: Zlib"),
    ("Epl2Ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0 which is available at"),
    ("Epl2Ref", "SPDX-License-Identifier: EPL-2.0"),
    ("LgplRef", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LgplRef", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AgplRef", "Licensed under the GNU Affero General Public License, version 3."),
    ("AgplRef", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MplRef", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("MplRef", "SPDX-License-Identifier: MPL-2.0"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer."),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission."),
    ("Bsd3Ref", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Bsd2Ref", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CcByRef", "Licensed under CC BY 4.0."),
    ("CcByRef", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CcBySaRef", "Licensed under CC BY-SA 4.0."),
    ("CcBySaRef", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CcByNcRef", "Licensed under CC BY-NC 4.0."),
    ("CcByNcRef", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CcByNdRef", "Licensed under CC BY-ND 4.0."),
    ("Cc0Ref", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work."),
    ("Cc0Ref", "Licensed under CC0 1.0."),
    ("PublicDomain", "This work is in the public domain."),
    ("PublicDomain", "This is free and unencumbered software released into the public domain."),
    ("AllRights", "All rights reserved."),
    ("NoDistribution", "Do not distribute."),
]
# Ordered rules, the licence and the identifier sequence that shows it.
RULES = [
    ("MIT", "PermissionGrant NoticeIncluded AsIs"),
    ("MIT", "PermissionGrant NoticeIncluded"),
    ("Apache-2.0", "ApacheRef2 ApacheComply ApacheCopy ApacheAsIs"),
    ("Apache-2.0", "ApacheRef2 ApacheComply ApacheCopy"),
    ("GPL-3.0-or-later", "FreeSoftware Gpl3Either GplHope"),
    ("GPL-3.0-or-later", "FreeSoftware Gpl3Either"),
    ("GPL-2.0-or-later", "FreeSoftware Gpl2Terms Gpl2Later GplHope"),
    ("GPL-2.0-or-later", "FreeSoftware Gpl2Terms Gpl2Later"),
    ("BSD-3-Clause", "AllRights BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "AllRights BsdGrant BsdSource BsdBinary"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary"),
    ("LGPL-2.1-or-later", "FreeLibrary Lgpl21Terms Lgpl21Later"),
    ("LGPL-2.1-or-later", "Lgpl21Terms Lgpl21Later"),
    ("LGPL-3.0-or-later", "FreeSoftware Lgpl3Either"),
    ("LGPL-3.0-or-later", "FreeLibrary Lgpl3Either"),
    ("LGPL-3.0-or-later", "Lgpl3Either"),
    ("AGPL-3.0-or-later", "FreeSoftware Agpl3Either"),
    ("AGPL-3.0-or-later", "Agpl3Either"),
    ("ISC", "IscGrant"),
    ("ISC", "IscRef"),
    ("Zlib", "ZlibGrant"),
    ("Zlib", "ZlibRef"),
    ("EPL-2.0", "Epl2Ref"),
    ("MIT", "MitRef"),
    ("Apache-2.0", "ApacheRef2"),
    ("GPL-3.0-or-later", "Gpl3Plus"),
    ("GPL-3.0-or-later", "Gpl3Either"),
    ("GPL-3.0-only", "Gpl3Ref"),
    ("GPL-2.0-or-later", "Gpl2Plus"),
    ("GPL-2.0-or-later", "Gpl2Terms Gpl2Later"),
    ("GPL-2.0-only", "Gpl2Ref"),
    ("LGPL-3.0-only", "LgplRef"),
    ("AGPL-3.0-only", "AgplRef"),
    ("MPL-2.0", "MplRef"),
    ("BSD-3-Clause", "Bsd3Ref"),
    ("BSD-2-Clause", "Bsd2Ref"),
    ("CC-BY-SA-4.0", "CcBySaRef"),
    ("CC-BY-NC-4.0", "CcByNcRef"),
    ("CC-BY-ND-4.0", "CcByNdRef"),
    ("CC-BY-4.0", "CcByRef"),
    ("CC0-1.0", "Cc0Ref"),
    ("LicenseRef-Public-Domain", "PublicDomain"),
    ("LicenseRef-Proprietary", "AllRights NoDistribution"),
    ("LicenseRef-Proprietary", "AllRights"),
]

#: A rule of these alone counts only where no rule before it did: a notice may begin with them.
ALONE = {"AllRights"}

NOT_WORD = r"[^a-z0-9]+"


def normalise_text(sentence: str) -> str:
    """The same in plain Python, for the tables of this module."""
    import re
    return re.sub(NOT_WORD, " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences(sentences=None) -> dict[str, str]:
    """Normalised sentence -> identifier; the table's own sentences are cut like texts are."""
    return {normalise_text(s): name for name, s in (sentences or SENTENCES)}


def marked(text: Column) -> Column:
    """The text normalised as a whole: each cut at a sentence's end is \\x01, each cut at a
    line end is a line feed, one stands before and after the text, and there are no blanks around them."""
    # "!" or ";" before a line is a comment mark and ends nothing
    marks = F.regexp_replace(F.translate(text, "\x01", " "), r"\n[\x20\t]*[!;]+[\x20\t]+", "\n!")
    ends = F.regexp_replace(marks, r"(?<=[.;:!?])[\x20\t-\r]+", "\x01")
    lines = F.regexp_replace(ends, r"\n(?=[\x20\t/*#;-]*[a-z])", " ")
    plain = F.regexp_replace(F.translate(lines, UPPER, LOWER), r"[^a-z0-9\n\x01]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), r"\x20?([\n\x01])\x20?", "$1")


def known_pattern(known) -> str:
    """Matches a known sentence in a marked text, with the mark before it."""
    ordered = sorted(filter(None, known), key=lambda s: (-len(s), s))
    return r"[\n\x01](?:" + "|".join(s.replace(" ", r"[\x20\n]") for s in ordered) + r")(?=[\n\x01])"


def cue_words(known) -> list[str]:
    """Single words, every known sentence holding one: a text without any is not cut at all.

    A word is never broken by normalising, so it stands in the text as it does in the sentence.
    """
    left, cues = set(filter(None, known)), []
    words = {w for s in left for w in s.split()}
    while left:
        # long words first: short ones are in most texts
        cues.append(max(words, key=lambda w: (any(w in s for s in left), min(len(w), 6),
                                              sum(w in s for s in left), w)))
        left = {s for s in left if cues[-1] not in s}
    return cues


def cued(text: Column, known) -> Column:
    return let(F.translate(text, UPPER, LOWER),
               lambda low: reduce(or_, (F.contains(low, F.lit(cue)) for cue in cue_words(known)), F.lit(False)))


def scan(docs: DataFrame, text: str = "text", keep=("doc_id",), sentences=None, rules=None) -> DataFrame:
    """``keep`` columns, n_sentences (known ones), sentence_ids, licences (sorted, once each),
    unmatched; the lists are joined by commas and null where there is nothing."""
    require_columns(docs, text, *keep)
    known = known_sentences(sentences)
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    pattern = F.lit(known_pattern(known))

    def identifiers(value):
        return F.transform(F.regexp_extract_all(marked(value), pattern, F.lit(0)),
                           lambda s: table[F.trim(F.translate(s, "\n\x01", "  "))])

    nothing = F.array().cast("array<string>")
    ids = F.when(cued(F.coalesce(text, F.lit("")), known), identifiers(F.col(text))).otherwise(nothing)
    found = docs.select(*(F.col(c) for c in keep), ids.alias("_ids"))

    def judge(ids):
        rest = F.concat(F.lit(","), F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit(","))), ","))
        start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
        ordered = F.array(*(F.struct(F.lit(licence).alias("licence"),
                                     F.lit("," + ",,".join(ids.split()) + ",").alias("ids"),
                                     F.lit(set(ids.split()) <= ALONE).alias("alone"))
                            for licence, ids in (rules or RULES)))
        return F.aggregate(ordered, start, lambda acc, rule: F.when(
            F.contains(acc["rest"], rule["ids"]) & (~rule["alone"] | (F.size(acc["found"]) == 0)),
            F.struct(F.replace(acc["rest"], rule["ids"], F.lit(",-,")).alias("rest"),
                     F.array_append(acc["found"], rule["licence"]).alias("found"))).otherwise(acc))

    # identifiers stand as ",A,,B,", each with its own commas; "-" is where a rule took some
    judged = F.when(F.size("_ids") > 0, judge(F.col("_ids")))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    left = F.filter(F.split(judged["rest"], ","), lambda i: ~i.isin("", "-"))
    return found.select(*keep, F.size("_ids").cast("long").alias("n_sentences"), joined(F.col("_ids")).alias("sentence_ids"),
                        joined(F.array_sort(F.array_distinct(judged["found"]))).alias("licences"),
                        joined(left).alias("unmatched"))


def scan_sql(table: str = "documents", sentences=None, rules=None) -> str:
    """DuckDB SQL for ``scan`` over ``table`` (doc_id, text).

    DuckDB's patterns cannot look ahead or behind, so every mark is doubled: a sentence takes
    one of the marks on either side and leaves one to its neighbours.  No text is left out beforehand.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = {s: i for s, i in known_sentences(sentences).items() if s}
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in names.items())
    ordered = sorted(names, key=lambda s: (-len(s), s))
    pattern = quote(r"[\n\x01](?:" + "|".join(s.replace(" ", r"(?:\x20|\n\n)") for s in ordered) + r")[\n\x01]")
    steps, licences, last = [], [], []
    for k, (licence, ids) in enumerate(rules or RULES):
        taken = quote("," + ",,".join(ids.split()) + ",")
        if set(ids.split()) <= ALONE:           # judged after the others; such rules stand at the end
            last.append((f"contains(r{k}, {taken}) AND NOT coalesce({' OR '.join(f'f{j}' for j in range(k)) or 'false'}, false)",
                         f"r{k}", taken, licence))
            continue
        steps.append(f"contains(r{k}, {taken}) AS f{k}, replace(r{k}, {taken}, ',-,') AS r{k + 1}")
        licences.append(f"CASE WHEN f{k} THEN {quote(licence)} END")
    if len(last) > 1:
        raise ValueError("SQL for at most one rule that counts alone")
    n = len(licences)
    rest = f"r{n}"
    if last:
        licences.append(f"CASE WHEN {last[0][0]} THEN {quote(last[0][3])} END")
        rest = f"CASE WHEN {last[0][0]} THEN replace({rest}, {last[0][2]}, ',-,') ELSE {rest} END"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(1), ' ') AS text FROM {table}),
ends AS (SELECT rid, regexp_replace(regexp_replace(text, '\n[\x20\t]*[!;]+[\x20\t]+', chr(10) || '!', 'g'),
                                    '([.;:!?])[\x20\t-\r]+', '\1' || chr(1), 'g') AS t FROM docs),
plain AS (SELECT rid, regexp_replace(translate(regexp_replace(t, '\n([\x20\t/*#;-]*[a-z])', ' \1', 'g'),
                                               '{UPPER}', '{LOWER}'), '[^a-z0-9\n\x01]+', ' ', 'g') AS t FROM ends),
marked AS (SELECT rid, regexp_replace(chr(10) || t || chr(10), '\x20?([\n\x01])\x20?', '\1\1', 'g') AS t FROM plain),
taken AS (SELECT rid, regexp_extract_all(t, {pattern}) AS m FROM marked),
sentences AS (SELECT rid, i, replace(substr(m[i], 2, len(m[i]) - 2), chr(10) || chr(10), ' ') AS s
              FROM taken, LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)),
ids AS (SELECT rid, list(id ORDER BY i) AS ids FROM sentences JOIN known ON s = sentence GROUP BY rid),
judged AS (SELECT rid, ids, ',' || array_to_string(ids, ',,') || ',' AS r0, {", ".join(steps)} FROM ids)
SELECT doc_id, coalesce(len(ids), 0) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       nullif(array_to_string(list_sort(list_distinct([{", ".join(licences)}])), ','), '') AS licences,
       nullif(array_to_string(list_filter(string_split({rest}, ','), lambda x: x NOT IN ('', '-')), ','), '') AS unmatched
FROM docs LEFT JOIN judged USING (rid)
"""
