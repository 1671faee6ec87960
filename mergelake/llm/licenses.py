"""License scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences (ends of line, or a full stop, question or exclamation mark, colon or semicolon
before white space), which are normalised and looked up among known licence sentences. The identifiers found, in
order, are matched against ordered rules; a rule that matches takes its identifiers out before the next is tried.
Wrapped licence texts are found by a second cut in which ends of line are blanks and blank lines end sentences. Every step is an expression of
one row, so there is nothing to shuffle and no group that could be large.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, every run of other ASCII characters one blank).
SENTENCES = {
    "mitName": ("mit license", "the mit license", "the mit license mit", "mit licence"),
    "mitRef": (
        "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license",
        "this project is licensed under the mit license see the license file for details", "distributed under the mit license", "license mit", "spdx license identifier mit",
    ),
    "mitPermission": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "asIsSoftware": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "noLiability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apacheRef": (
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0",
        "licensed under the apache license 2 0", "apache license version 2 0", "distributed under the apache license version 2 0", "license apache 2 0", "spdx license identifier apache 2 0",
    ),
    "apacheUse": ("you may not use this file except in compliance with the license",),
    "apacheCopy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"),
    "apacheAsIs": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "apacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl3Ref": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu general public license v3 0", "licensed under the gpl version 3",
        "gnu general public license version 3", "released under the gnu general public license version 3", "license gpl 3 0", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later",
    ),
    "gpl2Ref": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"),
    "gpl3Free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2Free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gplUseful": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gplSee": ("see the gnu general public license for more details",),
    "lgplRef": ("licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license"),
    "agplRef": ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"),
    "bsdRedistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsdEndorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd3Ref": ("licensed under the bsd 3 clause license", "bsd 3 clause license", "released under the bsd 3 clause license", "licensed under the 3 clause bsd license", "spdx license identifier bsd 3 clause"),
    "bsd2Ref": ("licensed under the bsd 2 clause license", "bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "bsdRef": ("licensed under the bsd license", "released under the bsd license", "bsd license"),
    "mplRef": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"),
    "iscPermission": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "iscRef": ("licensed under the isc license", "isc license", "released under the isc license"),
    "ccByRef": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons attribution 4 0 international license", "licensed under the creative commons attribution license"),
    "ccBySaRef": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 3 0", "content is available under cc by sa 3 0 unless otherwise noted", "content is available under cc by sa 3 0 unless otherwise noted license"),
    "ccByNcRef": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "ccByNdRef": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "ccByNcSaRef": ("licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    "ccByNcNdRef": ("licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "cc0Ref": ("licensed under cc0 1 0", "released under cc0 1 0 universal license", "this work is dedicated to the public domain under the cc0 license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "allRights": ("all rights reserved",),
    # What the cut leaves of sentences that run across a colon, a semicolon or a full stop: see PARTS.
    "spdxIs": ("spdx license identifier",),
    "licenseIs": ("license",),
    "mitTag": ("mit",),
    "apacheTag": ("apache 2 0",),
    "gpl3Tag": ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"),
    "gpl2Tag": ("gpl 2 0 only", "gpl 2 0 or later"),
    "agplTag": ("agpl 3 0 only",),
    "bsd3Tag": ("bsd 3 clause",),
    "bsd2Tag": ("bsd 2 clause",),
    "mplTag": ("mpl 2 0",),
    "mplForm": ("this source code form is subject to the terms of the mozilla public license v",),
    "mplVersion": ("2 0",),
    "gplFree": ("this program is free software",),
    "gplTerms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "gplFreeTerms": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "gpl3Terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2Terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl3Either": ("either version 3 of the license or at your option any later version",),
    "gpl2Either": ("either version 2 of the license or at your option any later version",),
    "gplHope": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "gplEven": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
}

# The parts that may stand for an identifier, as the usual punctuation has its sentence cut.
PARTS = {
    "mitRef": (("spdxIs", "mitTag"), ("licenseIs", "mitTag")), "apacheRef": (("spdxIs", "apacheTag"), ("licenseIs", "apacheTag")), "gpl3Ref": (("spdxIs", "gpl3Tag"), ("licenseIs", "gpl3Tag")),
    "gpl2Ref": (("spdxIs", "gpl2Tag"),), "agplRef": (("spdxIs", "agplTag"),), "bsd3Ref": (("spdxIs", "bsd3Tag"),), "bsd2Ref": (("spdxIs", "bsd2Tag"),), "mplRef": (("spdxIs", "mplTag"), ("mplForm", "mplVersion")),
    "gpl3Free": (("gplFree", "gpl3Terms"), ("gplFree", "gplTerms", "gpl3Either"), ("gplFreeTerms", "gpl3Either")),
    "gpl2Free": (("gplFree", "gpl2Terms"), ("gplFree", "gplTerms", "gpl2Either"), ("gplFreeTerms", "gpl2Either")),
    "gplUseful": (("gplHope", "gplEven"),),
}


def _spelled(rules: tuple) -> tuple:
    """Each rule, followed by the same rule with parts in place of identifiers."""
    return tuple((name, tuple(chain.from_iterable(way))) for name, ids in rules for way in product(*[((x,), *PARTS.get(x, ())) for x in ids]))


# Rules in the order in which they are tried: licence, then the sentence identifiers that follow each other.
RULES = _spelled((
    ("MIT", ("mitName", "mitPermission", "mitNotice", "asIsSoftware", "noLiability")), ("MIT", ("mitPermission", "mitNotice", "asIsSoftware", "noLiability")), ("MIT", ("mitPermission", "mitNotice")),
    ("Apache-2.0", ("apacheRef", "apacheUse", "apacheCopy", "apacheAsIs", "apacheSee")), ("Apache-2.0", ("apacheRef", "apacheUse", "apacheCopy")),
    ("GPL-3.0-or-later", ("gpl3Free", "gplUseful", "gplSee")), ("GPL-3.0-or-later", ("gpl3Free",)), ("GPL-2.0-or-later", ("gpl2Free", "gplUseful", "gplSee")), ("GPL-2.0-or-later", ("gpl2Free",)),
    ("BSD-3-Clause", ("bsdRedistribution", "bsdSource", "bsdBinary", "bsdEndorse")), ("BSD-2-Clause", ("bsdRedistribution", "bsdSource", "bsdBinary")), ("ISC", ("iscRef", "iscPermission")), ("ISC", ("iscPermission",)),
    ("MIT", ("mitRef",)), ("MIT", ("mitName",)), ("Apache-2.0", ("apacheRef",)), ("GPL-3.0", ("gpl3Ref",)), ("GPL-2.0", ("gpl2Ref",)), ("LGPL", ("lgplRef",)), ("AGPL-3.0", ("agplRef",)),
    ("BSD-3-Clause", ("bsd3Ref",)), ("BSD-2-Clause", ("bsd2Ref",)), ("BSD", ("bsdRef",)), ("MPL-2.0", ("mplRef",)), ("ISC", ("iscRef",)),
    ("CC-BY-NC-SA-4.0", ("ccByNcSaRef",)), ("CC-BY-NC-ND-4.0", ("ccByNcNdRef",)), ("CC-BY-NC-4.0", ("ccByNcRef",)), ("CC-BY-ND-4.0", ("ccByNdRef",)), ("CC-BY-SA", ("ccBySaRef",)), ("CC-BY-4.0", ("ccByRef",)), ("CC0-1.0", ("cc0Ref",)),
    ("Unlicense", ("unlicense",)), ("All-rights-reserved", ("allRights",)),
))

#: Every known sentence holds one of these, so a text whose normal form is without them needs no cutting.
TRIGGERS = ("licen", "copyright", "redistribut", "warranty", "the software", "hereby granted", "public domain", "rights reserved", "general public", "available under", "free software", "mit", "apache 2 0", "gpl", "bsd", "mpl", "2 0")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = r"[.!?:;]+(?:[ \t\r\f\x0B]+|$)|\n"


def _identifiers(text: Column) -> Column:
    """The known identifiers of a text, in order."""
    pairs = [F.lit(x) for name, known in SENTENCES.items() for s in known for x in (s, name)]
    cut = F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), _END, "\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.try_element_at(F.create_map(*pairs), F.trim(F.regexp_replace(s, _OTHER, " ")))), lambda x: x.isNotNull())


def _unwrapped(text: Column) -> Column:
    """Ends of line become blanks, but for blank lines, which stay ends of line."""
    marked = F.regexp_replace(text, r"\n[ \t\r]*\n[ \t\r\n]*", "\x01")
    return F.translate(marked, "\n\r\x01", "  \n")


def _matched(sequence: Column) -> Column:
    """struct(licenses, rest): the rules that a sequence such as <a><b> satisfies, and what they leave of it."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in ids)).alias("ids")) for name, ids in RULES])
    none = F.struct(F.lit(None).cast("array<string>").alias("licenses"), sequence.alias("rest"))
    start = F.struct(F.array().cast("array<string>").alias("licenses"), sequence.alias("rest"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.when(hit, F.struct(F.array_union(state["licenses"], F.array(rule["name"])).alias("licenses"), F.replace(state["rest"], rule["ids"], F.lit("")).alias("rest"))).otherwise(state)

    return F.when(F.length(sequence) > 0, F.aggregate(rules, start, step)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``sentence_ids`` (of the cut by lines, joined by blanks), ``licenses``
    (found by either cut, each once, in alphabetical order, joined by commas), ``n_licenses`` and ``n_unmatched``
    (identifiers of the cut by lines that no rule takes). A part of a sentence, such as a line of ``MIT`` alone, is
    an identifier too, but gives no licence without the part that goes before it.

    Null, empty and unlicensed texts give empty strings and zeros. Repeated rows and ids are scanned each for itself;
    null ids stay null. Other columns are ignored.
    """
    normal = F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), _OTHER, " ")
    worth = F.exists(F.array(normal), lambda n: reduce(or_, [F.contains(n, F.lit(t)) for t in TRIGGERS]))
    none = F.array().cast("array<string>")
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), worth.alias("_worth"))
    cut = rows.select(
        id_col,
        F.when(F.col("_worth"), _identifiers(F.col("_text"))).otherwise(none).alias("ids"),
        F.when(F.col("_worth"), _identifiers(_unwrapped(F.col("_text")))).otherwise(none).alias("wrapped"),
    )
    tagged = cut.select(id_col, "ids", *(F.array_join(F.transform(c, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias(f"{c}_tags") for c in ("ids", "wrapped")))
    found = tagged.select(id_col, "ids", _matched(F.col("ids_tags")).alias("m"), _matched(F.col("wrapped_tags")).alias("w"))
    licenses = F.array_sort(F.array_union(F.coalesce("m.licenses", none), F.coalesce("w.licenses", none)))
    return found.select(
        id_col, F.array_join("ids", " ").alias("sentence_ids"), F.array_join(licenses, ",").alias("licenses"), F.size(licenses).cast("long").alias("n_licenses"),
        F.coalesce(F.length("m.rest") - F.length(F.replace(F.col("m.rest"), F.lit("<"), F.lit(""))), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL over ``documents``, built from the same sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(name)})" for name, ss in SENTENCES.items() for s in ss)
    rules = [(name, "".join(f"<{x}>" for x in ids)) for name, ids in RULES]
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

    def cut(name: str, text: str) -> str:
        norm = r"trim(regexp_replace(piece, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
        pieces = rf"string_split(regexp_replace({text}, '[.!?:;]+(?:[ \t\r\f\x0B]+|$)|\n', chr(10), 'g'), chr(10))"
        return f"""{name}_s AS (SELECT rid, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS i FROM d),
        {name} AS (SELECT rid, string_agg('<' || k.id || '>', '' ORDER BY i) AS tags, string_agg(k.id, ' ' ORDER BY i) AS ids FROM {name}_s JOIN known k ON k.s = {norm} GROUP BY rid)"""

    def chain(name: str) -> tuple[str, str]:
        steps, at = [], f"{name}_0"
        steps.append(f"{name}_0 AS (SELECT rid, tags AS r0, ids FROM {name})")
        for i, (_, tags) in enumerate(rules):
            steps.append(f"{name}_{i + 1} AS (SELECT *, replace(r{i}, {quote(tags)}, '') AS r{i + 1} FROM {at})")
            at = f"{name}_{i + 1}"
        hits = ", ".join(f"CASE WHEN r{i + 1} <> r{i} THEN {quote(rules[i][0])} END" for i in range(len(rules)))
        steps.append(f"{name}_f AS (SELECT rid, ids, [{hits}] AS ls, r{len(rules)} AS rest FROM {at})")
        return ",\n".join(steps), f"{name}_f"

    a, fa = chain("lines")
    b, fb = chain("wrapped")
    return f"""WITH known(s, id) AS (VALUES {known}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS t FROM documents),
        {cut("lines", "t")}, {cut("wrapped", r"translate(regexp_replace(t, '\n[ \t\r]*\n[ \t\r\n]*', chr(1), 'g'), chr(10) || chr(13) || chr(1), '  ' || chr(10))")}, {a}, {b}
        SELECT doc_id, coalesce({fa}.ids, '') AS sentence_ids, array_to_string(l, ',') AS licenses, CAST(len(l) AS BIGINT) AS n_licenses,
               CAST(coalesce(len({fa}.rest) - len(replace({fa}.rest, '<', '')), 0) AS BIGINT) AS n_unmatched
        FROM (SELECT d.doc_id, {fa}.ids, {fa}.rest, list_sort(list_distinct(coalesce({fa}.ls, []) || coalesce({fb}.ls, []))) AS l
              FROM d LEFT JOIN {fa} USING (rid) LEFT JOIN {fb} USING (rid)) {fa}"""
