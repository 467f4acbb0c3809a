"""Licence recognition by sentences and rules (operator 5); DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words; a known
licence sentence becomes its identifier and all others drop out. The sequence
of identifiers is then matched against the rules in order: a rule names
identifiers that follow each other (other known sentences may lie between),
and the sentences a rule has used are gone for the later, weaker rules.

Sentences are cut twice: once at line ends too (notices on a line of their
own), once with lines joined (wrapped licence texts). A rule counts when either
sequence matches.

A colon ends a sentence, but a sentence that is only a tag (``License:``,
``SPDX-License-Identifier:``) also counts with its value as one sentence.

Everything is a projection of the row: no shuffle, so a frequent licence or
source makes no hot task. Null and empty texts have no licences. Repeated rows
each get their result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import narrow

# Known sentences, normalised, by identifier. Wordings of the public licences.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                "distributed under the mit license", "spdx license identifier mit", "license mit", "the mit license", "mit license"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions "
                   "of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the "
              "warranties of merchantability fitness for a particular purpose and noninfringement",),
    "apache2_ref": ("licensed under the apache license version 2 0", "released under the apache license version 2 0",
                    "this work is licensed under the apache license version 2 0", "spdx license identifier apache 2 0",
                    "licensed under the apache license version 2 0 the license", "apache license version 2 0"),
    "apache2_comply": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at",),
    "apache2_as_is": ("unless required by applicable law or agreed to in writing software distributed under the license is "
                      "distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl3_ref": ("this work is licensed under the gnu general public license version 3",
                 "licensed under the gnu general public license version 3", "released under the gnu general public license version 3",
                 "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
    "gpl2_ref": ("this work is licensed under the gnu general public license version 2",
                 "licensed under the gnu general public license version 2", "released under the gnu general public license version 2",
                 "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"),
    "gpl3_grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 3 of the license or at your option any "
                   "later version",),
    "gpl2_grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 2 of the license or at your option any "
                   "later version",),
    "gpl_no_warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the "
                        "implied warranty of merchantability or fitness for a particular purpose",),
    "lgpl_ref": ("licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only",
                 "licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only"),
    "agpl_ref": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"),
    "bsd_permit": ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
                   "following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
                   "disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission",),
    "bsd_ref": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause",
                "licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "mpl2_ref": ("licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0",
                 "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies",),
    "cc_by_ref": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0",
                  "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc_by_sa_ref": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0",
                     "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_nc_ref": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0",
                     "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0_ref": ("this work is licensed under cc0 1 0", "licensed under cc0 1 0", "released under the cc0 1 0 license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved", "copyright all rights reserved"),
}

# Rules in order of precedence: (licence, kind, identifiers that follow each other).
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "permissive", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", "permissive", ("bsd_permit", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", "permissive", ("bsd_permit", "bsd_source", "bsd_binary")),
    ("Apache-2.0", "permissive", ("apache2_ref", "apache2_comply", "apache2_copy", "apache2_as_is")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_grant", "gpl_no_warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_grant", "gpl_no_warranty")),
    ("GPL-3.0", "copyleft", ("gpl3_grant",)),
    ("GPL-2.0", "copyleft", ("gpl2_grant",)),
    ("GPL-3.0", "copyleft", ("gpl3_ref",)),
    ("GPL-2.0", "copyleft", ("gpl2_ref",)),
    ("AGPL-3.0", "copyleft", ("agpl_ref",)),
    ("LGPL", "copyleft", ("lgpl_ref",)),
    ("Apache-2.0", "permissive", ("apache2_ref",)),
    ("MIT", "permissive", ("mit_ref",)),
    ("BSD", "permissive", ("bsd_ref",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("MPL-2.0", "copyleft", ("mpl2_ref",)),
    ("CC-BY-NC-4.0", "restricted", ("cc_by_nc_ref",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_ref",)),
    ("CC-BY-4.0", "permissive", ("cc_by_ref",)),
    ("CC0-1.0", "public-domain", ("cc0_ref",)),
    ("Unlicense", "public-domain", ("unlicense",)),
    ("all-rights-reserved", "restricted", ("reserved",)),
)

#: Every known sentence holds one of these, so texts without any need no cutting.
CUES = ("licens", "permission", "warrant", "redistribut", "copyright", "compliance with", "rights reserved", "unencumbered")
#: What the operator looks for: one word of each cue, since a notice may be wrapped or hyphenated between words.
CUE_WORDS = tuple(max(cue.split(), key=len) for cue in CUES)
SENTENCE_END = r"[.!?;:]+(?:\s+|$)"
LINE_END = r"[.!?;:]*\s*(?:\n\s*|$)|[.!?;:]+\s+"
#: A tag's colon becomes TAG_MARK; a sentence that is only a tag then starts the next one too, after VALUE_MARK.
TAG_MARK, VALUE_MARK = "\x01", "\x02"
TAG = r"(license(?:[ -]identifier)?)\s*:\s+"
TAG_NAMES = "(license|spdx license identifier)"


def normalised(text: Column, end: str) -> Column:
    """Array of the text's sentences as lower-case words (letters and digits) with single spaces."""
    marked = F.regexp_replace(F.regexp_replace(text, TAG, "$1" + TAG_MARK), end, "|")
    plain = F.regexp_replace(marked, f"[^a-z0-9|{TAG_MARK}]+", " ")
    tagged = F.regexp_replace(plain, f"(?<=^|[|{TAG_MARK}]|[|{TAG_MARK}] |^ ){TAG_NAMES} ?{TAG_MARK} ?", f"$1|{VALUE_MARK}$1 ")
    return F.transform(F.split(F.translate(tagged, TAG_MARK, "|"), r"\|"), lambda s: F.trim(s))


def identifiers(sentences: Column) -> Column:
    """The known sentences' numbers in order, each written ``,number;``."""
    number = {name: i for i, name in enumerate(SENTENCES)}
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, f",{number[name]};")])

    def found(s: Column) -> Column:
        value = F.regexp_replace(s, f"^{VALUE_MARK}{TAG_NAMES} ", "")
        return F.when(F.startswith(s, F.lit(VALUE_MARK)), F.coalesce(F.try_element_at(known, F.translate(s, VALUE_MARK, "")),
                                                                     F.try_element_at(known, value))).otherwise(F.try_element_at(known, s))

    return F.array_join(F.transform(sentences, lambda s: F.coalesce(found(s), F.lit(""))), "")


def rule_pattern(names: tuple[str, ...]) -> str:
    number = {name: i for i, name in enumerate(SENTENCES)}
    return "(?:,[0-9]+;)*?".join(f",{number[n]};" for n in names)


def with_matches(rows: DataFrame, sequence: str, rules) -> DataFrame:
    """Adds ``sequence``_rules: numbers of the rules that match, in order, each using up its sentences."""
    found = f"{sequence}_rules"
    rows = rows.withColumn(found, F.array().cast("array<int>"))
    for i, (_, _, names) in enumerate(rules):
        pattern = rule_pattern(names)
        rows = rows.withColumn("hit", (F.col(sequence) != "") & F.col(sequence).rlike(pattern)) \
            .withColumn(found, F.when(F.col("hit"), F.concat(found, F.array(F.lit(i)))).otherwise(F.col(found))) \
            .withColumn(sequence, F.when(F.col("hit"), F.regexp_replace(sequence, pattern, "")).otherwise(F.col(sequence)))
    return rows.drop("hit")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_sentences, licenses, kinds, n_licenses) for each row.

    ``n_sentences``: known sentences found (the larger of the two cuts);
    ``licenses`` and ``kinds``: sorted, comma-joined, empty if none.
    """
    rows = narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase + TAG_MARK + VALUE_MARK, string.ascii_lowercase + "  ")
    rows = rows.select("doc_id", lowered.alias("text"))
    cued = F.lit(False)
    for word in CUE_WORDS:
        cued |= F.contains("text", F.lit(word))
    rows = rows.select("doc_id", F.when(cued, F.col("text")).otherwise(F.lit("")).alias("text"))
    rows = rows.select("doc_id", *[F.when(F.col("text") == "", F.lit("")).otherwise(identifiers(normalised(F.col("text"), end))).alias(name)
                                   for name, end in (("lines", LINE_END), ("joined", SENTENCE_END))])
    count = F.greatest(*[F.length(F.regexp_replace(c, "[^;]", "")) for c in ("lines", "joined")])
    rows = rows.withColumn("n_sentences", count.cast("bigint"))
    for sequence in ("lines", "joined"):
        rows = with_matches(rows, sequence, RULES)
    both = F.array_union("lines_rules", "joined_rules")
    named = lambda field: F.sort_array(F.array_distinct(F.transform(
        both, lambda i: F.element_at(F.array(*[F.lit(r[field]) for r in RULES]), i + 1))))
    return rows.select("doc_id", "n_sentences", F.array_join(named(0), ",").alias("licenses"),
                       F.array_join(named(1), ",").alias("kinds"), F.size(named(0)).cast("bigint").alias("n_licenses"))
