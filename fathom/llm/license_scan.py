"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised as a whole: ASCII letters lower-cased, sentence ends turned into line breaks, everything else
that is no letter or digit into one space. It is cut into sentences three times: at line breaks as well, with all
lines joined, and with lines joined but for blank lines and copyright lines, since licence texts are wrapped and
headings have no full stop. Sentences that are known become identifiers, others
fall away, and the sequence of identifiers is matched against rules in order: a rule that matches takes its
identifiers, so that a more specific rule keeps a less specific one from matching them.

Everything is an expression on one row: one read, no shuffle. Texts without any word that all known sentences
have one of are not cut at all. Null texts have no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "[.!?:;]+([ \\t\\n\\r]+|\\z)"

# Sentences of public licence texts and notices, normalised, and their identifiers.
SENTENCES = {
    "all rights reserved": "reserved",
    "released under the mit license": "ref_mit",
    "licensed under the mit license": "ref_mit",
    "this project is licensed under the mit license": "ref_mit",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "licensed under the apache license version 2 0": "ref_apache2",
    "licensed under the apache license version 2 0 the license": "ref_apache2",
    "apache license version 2 0 january 2004": "ref_apache2",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "this work is licensed under the gnu general public license version 3": "ref_gpl3",
    "this work is licensed under the gnu general public license version 2": "ref_gpl2",
    "licensed under the gnu general public license version 3": "ref_gpl3",
    "licensed under the gnu general public license version 2": "ref_gpl2",
    "this program is free software": "gpl_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_terms",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_implied",
    "licensed under cc by nc 4 0": "ref_cc_by_nc4",
    "licensed under cc by 4 0": "ref_cc_by4",
    "licensed under cc by sa 4 0": "ref_cc_by_sa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ref_cc_by4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ref_cc_by_sa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ref_cc_by_nc4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_conditions",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "ref_mpl2",
    "this source code form is subject to the terms of the mozilla public license v": "ref_mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_free",
    "you should have received a copy of the gnu general public license along with this program": "gpl_copy",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_only_terms",
    "gnu general public license version 3 29 june 2007": "text_gpl3",
    "gnu general public license version 2 june 1991": "text_gpl2",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu_verbatim",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3_preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2_preamble",
    "this library is free software": "lgpl_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_head",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_head",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl_head",
    "either version 2 of the license or at your option any later version": "either_2",
    "either version 2 1 of the license or at your option any later version": "either_21",
    "either version 3 of the license or at your option any later version": "either_3",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_terms",
    "this library is distributed in the hope that it will be useful but without any warranty": "lgpl_hope",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl_copy",
    "gnu lesser general public license version 2 1 february 1999": "text_lgpl21",
    "gnu lesser general public license version 3 29 june 2007": "text_lgpl3",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_terms",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl_copy",
    "gnu affero general public license version 3 19 november 2007": "text_agpl3",
    "licensed under the gnu affero general public license version 3": "ref_agpl3",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl_obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl_obtain",
    "mozilla public license version 2 0": "text_mpl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "ref_epl2",
    "eclipse public license v 2 0": "text_epl2",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd_liability",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_damage",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising",
    "licensed under the bsd 3 clause license": "ref_bsd3",
    "licensed under the bsd 2 clause license": "ref_bsd2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd_plain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_bsd_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc_liability",
    "licensed under the isc license": "ref_isc",
    "boost software license version 1 0 august 17th 2003": "bsl_title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl_grant",
    "distributed under the boost software license version 1 0": "ref_bsl",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "the origin of this software must not be misrepresented": "zlib_origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib_altered",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql_grant",
    "this font software is licensed under the sil open font license version 1 1": "ref_ofl",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "ref_cc0",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "ref_cc_by_nc_sa4",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "ref_cc_by_nd4",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "ref_cc_by_nc_nd4",
    "licensed under cc by nc sa 4 0": "ref_cc_by_nc_sa4",
    "licensed under cc by nd 4 0": "ref_cc_by_nd4",
    "licensed under cc by nc nd 4 0": "ref_cc_by_nc_nd4",
    "this software is proprietary and confidential": "proprietary",
    "unauthorized copying of this file via any medium is strictly prohibited": "proprietary",
}
# Every known sentence holds one of these.
SIGNS = "licen|copyright|rights reserved|redistribut|free software|warrant|public domain|liable|permission|misrepresent|advertising materials|theory of liability|anyone is free|copy of the mpl|source distribution|proprietary|unauthorized copying"
# The same in texts that are not normalised yet.
RAW_SIGNS = SIGNS.replace(" ", "[^a-z0-9]+")
_BREAK = r"(?:\r?\n|\r(?!\n))"
BLANK = _BREAK + r"(?:[ \t\p{Punct}]*" + _BREAK + ")+"
NOTICE = r"(?:\A|(?<=[\n\r]))([^a-z0-9\n\r]*copyright[^a-z0-9\n\r]+(?:c[^a-z0-9\n\r]+)?[12][0-9]{3}[^\n\r]*)"

# (licence, sequence of identifiers as a pattern), more specific ones first. Sequences are written " id id id ".
RULES = [
    ("MIT", "( mit_title )?( copyright )?( reserved )? mit_grant  mit_notice ( mit_warranty )?( mit_liability )?"),
    ("BSD-4-Clause", " bsd_conditions  bsd_source  bsd_binary  bsd_advertising ( bsd_endorse )?( bsd_warranty )?( bsd_liability )?( bsd_damage )?"),
    ("BSD-3-Clause", " bsd_conditions  bsd_source  bsd_binary  bsd_endorse ( bsd_warranty )?( bsd_liability )?( bsd_damage )?| ref_bsd3 "),
    ("BSD-2-Clause", " bsd_conditions  bsd_source  bsd_binary ( bsd_warranty )?( bsd_liability )?( bsd_damage )?| ref_bsd2 "),
    ("ISC", "( copyright )? isc_grant ( isc_warranty )?( isc_liability )?"),
    ("0BSD", "( copyright )? zero_bsd_grant ( isc_warranty )?( isc_liability )?"),
    ("BSL-1.0", "( bsl_title )? bsl_grant | ref_bsl "),
    ("Zlib", "( zlib_warranty )?( zlib_liability )? zlib_grant ( zlib_origin )?( zlib_altered )?( zlib_notice )?"),
    ("PostgreSQL", "( copyright )? postgresql_grant "),
    ("Apache-2.0", " ref_apache2 ( apache_comply )?( apache_obtain )?( apache_basis )?( apache_see )?"),
    ("GPL-3.0-or-later", "( gpl_free )?( gpl3_terms | gpl_head  either_3 )( gpl_hope )?( gpl_implied )?"),
    ("GPL-2.0-or-later", "( gpl_free )?( gpl2_terms | gpl_head  either_2 )( gpl_hope )?( gpl_implied )?"),
    ("AGPL-3.0-or-later", "( gpl_free )?( agpl3_terms | agpl_head  either_3 )( gpl_hope )?( gpl_implied )?( agpl_copy )?"),
    ("LGPL-2.1-or-later", "( lgpl_free )?( lgpl21_terms | lgpl_head  either_21 )( lgpl_hope )?( gpl_implied )?( lgpl_copy )?"),
    ("LGPL-3.0-or-later", "( lgpl_free )?( lgpl3_terms | lgpl_head  either_3 )( lgpl_hope )?( gpl_implied )?( lgpl_copy )?"),
    ("AGPL-3.0", " text_agpl3 ( copyright )?( gnu_verbatim )?| ref_agpl3 "),
    ("LGPL-3.0", " text_lgpl3 ( copyright )?( gnu_verbatim )?"),
    ("LGPL-2.1", " text_lgpl21 ( copyright )?( gnu_verbatim )?"),
    ("GPL-3.0", "( gpl_free )? gpl3_only_terms ( gpl_hope )?( gpl_implied )?| text_gpl3 ( copyright )?( gnu_verbatim )?( gpl3_preamble )?| gpl3_preamble | ref_gpl3 "),
    ("GPL-2.0", "( gpl_free )? gpl2_only_terms ( gpl_hope )?( gpl_implied )?| text_gpl2 ( copyright )?( gnu_verbatim )?( gpl2_preamble )?| gpl2_preamble | ref_gpl2 "),
    ("MIT", " ref_mit | mit_title "),
    ("CC-BY-NC-4.0", " ref_cc_by_nc4 "),
    ("CC-BY-SA-4.0", " ref_cc_by_sa4 "),
    ("CC-BY-4.0", " ref_cc_by4 "),
    ("CC-BY-NC-SA-4.0", " ref_cc_by_nc_sa4 "),
    ("CC-BY-ND-4.0", " ref_cc_by_nd4 "),
    ("CC-BY-NC-ND-4.0", " ref_cc_by_nc_nd4 "),
    ("CC0-1.0", " ref_cc0 "),
    ("MPL-2.0", " ref_mpl2 ( mpl_obtain )?| text_mpl2 "),
    ("EPL-2.0", " ref_epl2 | text_epl2 "),
    ("OFL-1.1", " ref_ofl "),
    ("ISC", " ref_isc "),
    ("Unlicense", " unlicense ( unlicense_free )?"),
    ("proprietary", " proprietary "),
    ("all-rights-reserved", "( copyright )? reserved "),
    ("copyright-notice", " copyright "),
]


def _sequence(plain: Column, known: Column) -> Column:
    """Identifiers of the sentences of a normalised text, written " id id "."""
    lines = F.filter(F.split(plain, "\n"), lambda x: F.map_contains_key(known, x) | x.rlike("^copyright (c )?[12][0-9]{3}( |\\z)"))
    return F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(F.lit(" "), F.coalesce(F.element_at(known, x), F.lit("copyright")), F.lit(" "))), ""), F.lit(""))


def _rules(sequence: Column) -> Column:
    """Licences whose rules match, in rule order, each rule seeing what earlier ones have left; most texts have no identifier."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in RULES])
    none = F.array().cast("array<string>")

    def step(state: Column, rule: Column) -> Column:
        hit = F.regexp_count(state["rest"], rule["pattern"]) > 0
        names = F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.when(hit, F.regexp_replace(state["rest"], rule["pattern"], F.lit("|"))).otherwise(state["rest"]).alias("rest"), names.alias("names"))

    found = F.aggregate(rules, F.struct(sequence.alias("rest"), none.alias("names")), step, lambda state: state["names"])
    return F.when(sequence == "", none).otherwise(found)


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones, with lines cut), sentence_ids, licenses (sorted, comma-joined).

    docs needs doc_id and text.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)

    def normal(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, END, "\n"), "[^a-z0-9\n]+", " "), " ?\n ?", "\n")

    maybe = low.rlike(RAW_SIGNS)
    ended = F.regexp_replace(F.regexp_replace(low, NOTICE, "$1. "), BLANK, ". ")
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(maybe, _sequence(F.trim(normal(low)), known)).otherwise("").alias("s1"),
        F.when(maybe, _sequence(F.trim(normal(F.regexp_replace(low, "[\\n\\r]+", " "))), known)).otherwise("").alias("s2"),
        F.when(maybe & low.rlike(f"{BLANK}|{NOTICE}"), _sequence(F.trim(normal(F.regexp_replace(ended, "[\\n\\r]+", " "))), known)).otherwise("").alias("s3"),
    )
    names = F.array_sort(F.array_distinct(F.concat(*[_rules(F.col(s)) for s in ("s1", "s2", "s3")])))
    return cut.select(
        "doc_id",
        F.size(F.filter(F.split("s1", " +"), lambda x: x != "")).cast("long").alias("n_sentences"),
        F.array_join(F.filter(F.split("s1", " +"), lambda x: x != ""), ",").alias("sentence_ids"),
        F.array_join(names, ",").alias("licenses"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    quoted = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    rules, left = [], []
    for k, (name, pattern) in enumerate(RULES):
        rules.append(f"CASE WHEN regexp_matches(q{k}, '{pattern}') THEN '{name}' END")
        left.append(f"regexp_replace(q{k}, '{pattern}', '|', 'g') AS q{k + 1}")
    chain = "".join(f", r{k + 1} AS (SELECT *, {x} FROM r{k})" for k, x in enumerate(left))
    seq = "coalesce(array_to_string(list_transform(list_filter(string_split({0}, chr(10)), lambda x: map_contains(known, x) OR regexp_matches(x, '^copyright (c )?[12][0-9]{{3}}( |\\z)')), lambda x: ' ' || coalesce(known[x], 'copyright') || ' '), ''), '')"
    normal = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '" + END + "', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ')"
    return f"""
WITH k AS (SELECT MAP {{{quoted}}} AS known),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN regexp_matches(low, '{SIGNS}') THEN {seq.format(normal.format("low"))} ELSE '' END AS s1,
  CASE WHEN regexp_matches(low, '{SIGNS}') THEN {seq.format(normal.format("regexp_replace(low, '[\\n\\r]+', ' ', 'g')"))} ELSE '' END AS s2 FROM d, k),
r0 AS (SELECT rid, q0 FROM (SELECT rid, s1 AS q0 FROM s UNION ALL SELECT rid, s2 FROM s)){chain},
f AS (SELECT rid, list_filter([{", ".join(rules)}], lambda x: x IS NOT NULL) AS names FROM r{len(RULES)}),
g AS (SELECT rid, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS licenses FROM f GROUP BY rid)
SELECT doc_id, len(list_filter(string_split_regex(s1, ' +'), lambda x: x <> ''))::BIGINT AS n_sentences,
  array_to_string(list_filter(string_split_regex(s1, ' +'), lambda x: x <> ''), ',') AS sentence_ids, licenses
FROM s JOIN g USING (rid)"""
