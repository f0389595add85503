"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences (and, where a sentence isn't known, at colons that
end a line, then into its lines); a line without a letter or digit, such as the
' *' of a comment block, is a blank one, and a copyright line stands alone.  Each is normalised to lower-case words and looked up in a table of known
licence sentences.  A document thus becomes a short sequence of sentence
identifiers.  Licence rules are sequences of identifiers in order of precedence;
the leftmost match of the first rule that fits consumes its sentences, so a
three-clause licence is never reported as the two-clause one inside it.

No row leaves its partition: there is no join and no shuffle, and texts without
any of the anchor words that every known sentence contains are passed over by
one regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, as people write them.
SENTENCES: dict[str, str] = {
    "apache2_licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2_notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2_compliance": "you may not use this file except in compliance with the License.",
    "apache2_obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit_released": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2_work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_or_later": "This program is free software",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version.",
    "mpl2_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc_by_licensed": "Licensed under CC BY 4.0.",
    "cc_by_sa_licensed": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_licensed": "Licensed under CC BY-NC 4.0.",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense_domain": "This is free and unencumbered software released into the public domain.",
    "isc_grant_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd_author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_3_style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "boost_distributed": "Distributed under the Boost Software License, Version 1.0.",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "apache_title": "Apache License",
    "apache2_version": "Version 2.0, January 2004",
    "gpl_title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl_title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl_title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2_version_line": "Version 2, June 1991",
    "lgpl21_version_line": "Version 2.1, February 1999",
    "gpl3_version_line": "Version 3, 29 June 2007",
    "agpl3_version_line": "Version 3, 19 November 2007",
    "gpl3_licensed": "Licensed under the GNU General Public License v3.0.",
    "gpl2_licensed": "Licensed under the GNU General Public License v2.0.",
    "lgpl_library": "This library is free software",
    "lgpl_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21_version": "either version 2.1 of the License, or (at your option) any later version.",
    "version_3_or_later": "either version 3 of the License, or (at your option) any later version.",
    "lgpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2_title": "Mozilla Public License Version 2.0",
    "mpl11_subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "epl1_available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2_available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl_terms": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "eupl_licensed": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")",
    "ofl_licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "artistic2_title": "The Artistic License 2.0",
    "mit_file": "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
    "mit_use": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "cc_by_4": "This work is licensed under a Creative Commons Attribution 4.0 International Public License.",
    "cc_by_sa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc_by_nc_work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_nd_work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc_by_nc_sa_work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc_by_nc_nd_work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "public_domain": "This file is in the public domain.",
    "cc0_waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Licence and the sentences that declare it, in order of precedence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_author")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_3_style",)),
    ("MIT", ("mit_grant", "mit_condition", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_file",)),
    ("MIT", ("mit_use",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_and",)),
    ("0BSD", ("zero_bsd_grant",)),
    ("BSL-1.0", ("boost_distributed",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Zlib", ("zlib_warranty", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("Apache-2.0", ("apache_title", "apache2_version")),
    ("Apache-2.0", ("apache2_notice", "apache2_compliance", "apache2_obtain")),
    ("Apache-2.0", ("apache2_notice", "apache2_compliance")),
    ("Apache-2.0", ("apache2_notice",)),
    ("Apache-2.0", ("apache2_licensed",)),
    ("MIT", ("mit_released",)),
    ("MIT", ("mit_licensed",)),
    ("GPL-3.0-or-later", ("gpl3_or_later",)),
    ("GPL-2.0-or-later", ("gpl2_or_later", "gpl2_terms", "gpl2_version")),
    ("GPL-3.0-or-later", ("gpl2_or_later", "gpl2_terms", "version_3_or_later")),
    ("LGPL-2.1-or-later", ("lgpl_library", "lgpl_terms", "lgpl21_version")),
    ("LGPL-3.0-or-later", ("lgpl_library", "lgpl_terms", "version_3_or_later")),
    ("LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("GPL-3.0-only", ("gpl_title", "gpl3_version_line")),
    ("GPL-2.0-only", ("gpl_title", "gpl2_version_line")),
    ("LGPL-3.0-only", ("lgpl_title", "gpl3_version_line")),
    ("LGPL-2.1-only", ("lgpl_title", "lgpl21_version_line")),
    ("AGPL-3.0-only", ("agpl_title", "agpl3_version_line")),
    ("GPL-3.0-only", ("gpl3_licensed",)),
    ("GPL-2.0-only", ("gpl2_licensed",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-2.0-only", ("gpl2_work",)),
    ("MPL-2.0", ("mpl2_subject",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("MPL-1.1", ("mpl11_subject",)),
    ("EPL-1.0", ("epl1_available",)),
    ("EPL-2.0", ("epl2_available",)),
    ("CDDL-1.0", ("cddl_terms",)),
    ("EUPL-1.2", ("eupl_licensed",)),
    ("OFL-1.1", ("ofl_licensed",)),
    ("Artistic-2.0", ("artistic2_title",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_licensed",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_licensed",)),
    ("CC-BY-4.0", ("cc_by_licensed",)),
    ("CC-BY-4.0", ("cc_by_work",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_work",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_work",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_work",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_work",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_work",)),
    ("Unlicense", ("unlicense_domain",)),
    ("CC0-1.0", ("cc0_waived",)),
)
#: Where texts write names of their own into known sentences, full stops included: the words before
#: the name, the words after it, and what stands for both.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("neither the names? of", "nor the names? of (?:its|their|any|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("the names? of", "may not be used to endorse", "the name of the author may not be used to endorse"),
    ("to the extent possible under law", "waived all copyright", "to the extent possible under law the author has waived all copyright"),
)
#: The same at the end of a normalised sentence.
ENDINGS: tuple[tuple[str, str], ...] = (
    ("(governed by an? (?:bsd|mit) style license that can be found in) .{1,80}$", "$1 the license file"),
    ("(waived all copyright and related or neighboring rights to) .{1,200}$", "$1 this work"),
)
SPDX = "spdx license identifier "
#: Every known sentence contains one of these.
ANCHORS = ("licen", "permission", "redistribut", "warrant", "copyright", "free software", "public domain", "spdx", "eupl", "endorse", "january 2004", "june 1991", "february 1999", "june 2007", "november 2007")
SENTENCE_END = r"[.!?;]+[ \t\r\n]+|\n[^a-z0-9\n]*\n"
COLON_END = r":[ \t\r]*\n"
#: What may stand before a line's words: comment leaders, then a list mark in parentheses.
LIST_MARK = r"(?m)^[^a-z0-9\n]*(?:(?:dnl|rem)[ \t]+)?\(?[0-9a-z]{1,2}\)[ \t]+|^[ \t]*(?:dnl|rem)\b"
COPYRIGHT_LINE = r"(?m)^([^a-z0-9\n]*copyright[ \t]+(?:\(c\)|©|[0-9]{4})[^\n]*)$"
_NOT_WORD = "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(_NOT_WORD, " ", sentence.lower()).strip(" ")


def _pieces(sentence: str) -> list[str]:
    return [x for x in re.split(SENTENCE_END, sentence) if normalised(x)]


def sentence_table(sentences: dict[str, str], rules: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, str]:
    """Normalised sentence to identifier; ``SPDX-License-Identifier`` lines of the rules' licences too."""
    wrong = [x for x in sentences if not re.fullmatch("[a-z0-9_]+", x)]
    if wrong:
        raise ValueError(f"identifiers are lower-case letters, digits and underscores: {wrong[:3]}")
    out = {}
    for name, text in sentences.items():
        # an inner full stop cuts the sentence: its first part stands for it
        out[normalised(_pieces(text)[0])] = name
    # of an expression's licences each is looked up; "or later" belongs to a name
    return out | {SPDX + normalised(x).replace(" or later", " orlater"): f"spdx_{normalised(x).replace(' ', '_')}" for x, _ in rules}


def _all_rules(rules: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, str]:
    """Identifier sequence (each followed by a blank) to licence, in order of precedence."""
    out = {"".join(f"{x} " for x in ids): licence for licence, ids in rules}
    return out | {f"spdx_{normalised(x).replace(' ', '_')} ": x for x, _ in rules}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def scan_licences(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
    anchors: tuple[str, ...] = ANCHORS,
) -> DataFrame:
    """``id_col``, ``sentence_ids``, ``licenses``, ``n_licenses`` per row.

    ``sentence_ids``: identifiers of the known sentences in order, separated by
    blanks.  ``licenses``: the licences that rules find in that sequence, in
    order, separated by commas; where several rules fit, the first in their order
    is taken.  Names that a text puts into a known sentence (``NAMES``) and the
    operators of an SPDX expression do not hide it.  Null and empty texts, and
    texts that declare nothing, have empty strings and 0; texts of any length are
    read whole.  Null ids and repeated rows are kept, an empty table gives none;
    other columns are not read.
    """
    table, sequences = sentence_table(sentences, rules), _all_rules(rules)
    unseen = [x for x in table if not any(a in x for a in anchors)]
    if unseen:
        raise ValueError(f"known sentences without an anchor: {unseen[:3]}")
    known, licence_of = _map(table), _map(sequences)

    def norm(x: Column) -> Column:
        out = F.btrim(F.regexp_replace(x, _NOT_WORD, " "), F.lit(" "))
        for pattern, name in ENDINGS:
            out = F.regexp_replace(out, pattern, name)
        return out

    look = lambda x: F.try_element_at(known, norm(x))

    def line(x: Column) -> Column:
        """Identifiers of a line: one, or those of an SPDX expression."""
        words = F.replace(norm(x), F.lit(" or later"), F.lit(" orlater"))
        names = F.split(F.regexp_replace(words, f"^.*{SPDX}", ""), " (?:or|and|with) ")
        spdx = F.transform(names, lambda name: F.try_element_at(known, F.concat(F.lit(SPDX), name)))
        return F.when(x.contains("spdx"), spdx).otherwise(F.array(look(x)))

    known_or = lambda s, parts: F.when(look(s).isNotNull(), F.array(look(s))).otherwise(parts)
    lines = lambda s: known_or(s, F.flatten(F.transform(F.split(s, "\n"), line)))
    ids = lambda s: known_or(s, F.flatten(F.transform(F.split(s, COLON_END), lines)))
    clean = F.regexp_replace(F.regexp_replace("low", LIST_MARK, ""), COPYRIGHT_LINE, "$1\n")
    for before, after, name in NAMES:
        apart = lambda words: words.replace(" ", "[^a-z0-9]+")
        clean = F.regexp_replace(clean, rf"\b{apart(before)}\b[^;]{{1,250}}?\b{apart(after)}\b", name)
    found = F.filter(F.flatten(F.transform(F.split(clean, SENTENCE_END), ids)), lambda x: x.isNotNull())
    sequence = F.when(F.col("low").rlike("|".join(anchors)), F.array_join(found, " ")).otherwise("")
    rows = df.select(F.col(id_col), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).select(id_col, sequence.alias("sentence_ids"))
    matches = F.regexp_extract_all(F.concat("sentence_ids", F.lit(" ")), F.lit(r"\b(" + "|".join(sequences) + ")"), F.lit(1))
    licences = F.transform(matches, lambda x: F.element_at(licence_of, x))
    out = rows.withColumn("found", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(licences))
    return out.select(id_col, "sentence_ids", F.array_join("found", ",").alias("licenses"), F.size("found").alias("n_licenses"))


def scan_sql(sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    as_map = lambda values: "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in values.items()) + "}"
    sequences = _all_rules(rules)
    norm = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"""
WITH known AS (SELECT {as_map(sentence_table(sentences, rules))} AS ids, {as_map(sequences)} AS licences),
cut AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[.!?;]+[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n')) AS s,
         generate_subscripts(regexp_split_to_array(lower(coalesce(text, '')), '[.!?;]+[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n'), 1) AS pos, rid
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
),
looked AS (
  SELECT rid, pos, CASE WHEN ids[{norm('s')}] IS NOT NULL THEN [ids[{norm('s')}]]
         ELSE list_transform(string_split(s, chr(10)), lambda x: ids[{norm('x')}]) END AS found
  FROM cut, known
),
sequence AS (
  SELECT rid, string_agg(id, ' ' ORDER BY pos, k) AS sentence_ids
  FROM (SELECT rid, pos, unnest(found) AS id, generate_subscripts(found, 1) AS k FROM looked) WHERE id IS NOT NULL GROUP BY rid
),
matched AS (
  SELECT d.doc_id, coalesce(s.sentence_ids, '') AS sentence_ids,
         CASE WHEN s.sentence_ids IS NULL THEN [] ELSE list_transform(regexp_extract_all(s.sentence_ids || ' ', {quote("(" + "|".join(sequences) + ")")}, 1), lambda x: licences[x]) END AS found
  FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) d LEFT JOIN sequence s USING (rid), known
)
SELECT doc_id, sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, len(found)::INTEGER AS n_licenses FROM matched
"""
