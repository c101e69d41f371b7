"""Licence scan by sentence rules.

A text is cut into pieces at line ends and punctuation, each is normalised
(letters and digits in lower case, one space between; comment marks go with the
other signs). Known licence sentences are found where they are a piece, or
pieces in a row that only single line ends, ``;`` or ``:`` part, so that a
licence is the same however its lines are wrapped; what is left of a document
is the sequence of the sentences' identifiers. Licence rules are
ordered identifier sequences: a rule matches where its identifiers follow one
another in that sequence (unknown sentences between them, such as copyright
lines, don't count). All of it is expressions on the row: no shuffle, no UDF.

Defined cases: a null or empty text has no sentences and no licence;
``n_sentences`` counts pieces; of known sentences that overlap, the one that
begins first is taken, then the longest; repeated
sentences repeat in the sequence; input columns named like an output are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm import frames

#: Normalised licence sentences by identifier, from the public licence texts.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is "
                   "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation "
                 "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                 "permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to "
                "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                  "the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                  "the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-free": "this library is free software",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
                   "the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
                    "the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
                   "the free software foundation either version 3 of the license or at your option any later version",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter "
                  "it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
                 "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
                 "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
                 "software is furnished to do so all subject to the following",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                   "promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                 "granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
#: The same for sentences that hold a name (*, 1 to 12 words).
NAMED = {
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or "
                   "promote products derived from this software without specific prior written permission",
}
#: Licence rules as ordered sentence identifiers.
RULES = [
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-header", "apache-compliance"]),
    ("Apache-2.0", ["apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache-asis", "apache-see"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("Unlicense", ["unlicense"]),
]
#: a sentence ends at one of these before a blank; a piece of one also at these, and at a line's end
SENTENCE_END, PIECE_END = r"[.!?][\x20\x09-\x0D]+", r"[;:][\x20\x09\x0B-\x0D]*[\x20\x09-\x0D]"


def pieces(text: Column) -> Column:
    """The normalised text: a line per piece, and an empty line (or several)
    where a sentence ends: at its punctuation before a blank, and at a line
    that has no letter or digit."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "\n\n")
    plain = F.lower(F.regexp_replace(F.regexp_replace(cut, PIECE_END, "\n"), "[^A-Za-z0-9\n]+", " "))
    return F.trim(F.regexp_replace(plain, " ?\n ?", "\n"))


def known_pattern(known: dict[str, str], named: dict[str, str]) -> str:
    """Matches whole known sentences, the longest first: each is a piece, or
    pieces that follow one another in one sentence."""
    each = sorted({*known.values(), *named.values()}, key=lambda x: (-len(x), x))
    return "(?m)^(?:" + "|".join(sentence_pattern(x, "[ \\n]") for x in each) + ")$"


def sentence_pattern(sentence: str, blank: str = " ") -> str:
    """A sentence whose names are any 1 to 12 words; with "Inc." a name may hold a sentence's end."""
    gap = blank if blank == " " else "[ \\n]{1,2}"
    return sentence.replace(" ", blank).replace(f"*{blank}", f"(?:[a-z0-9]+{gap}){{1,12}}?")


def scan(docs: DataFrame, text: str = "text", known: dict[str, str] = SENTENCES,
         rules: list[tuple[str, list[str]]] = RULES, named: dict[str, str] = NAMED) -> DataFrame:
    """``docs`` with ``n_sentences`` (pieces), ``sentence_ids`` (array, in the order of
    the text) and ``licences`` (array, in the order of the rules). A rule that
    is the beginning of a longer matching one of another licence is dropped:
    three of four BSD sentences are not a licence of their own."""
    out = frames.without(docs, ["n_sentences", "sentence_ids", "licences"])
    ids = F.create_map(*[F.lit(x) for k, v in known.items() for x in (v, k)])
    found = F.regexp_extract_all("_p", F.lit(known_pattern(known, named)), 0)
    cut = out.withColumn("_p", pieces(out[text])) \
        .withColumn("sentence_ids", F.transform(F.transform(found, lambda x: F.regexp_replace(x, "\n+", " ")), lambda x: F.coalesce(
            F.try_element_at(ids, x), *[F.when(F.rlike(x, F.lit(f"^{sentence_pattern(v)}$")), k) for k, v in named.items()])))
    path = F.concat(F.lit("/"), F.array_join("sentence_ids", "/"), F.lit("/"))
    found = []
    for name, steps in rules:
        here = "/" + "/".join(steps) + "/"
        longer = [r for other, r in rules if other != name and len(r) > len(steps) and r[:len(steps)] == steps]
        rest = path
        for r in longer:
            rest = F.replace(rest, F.lit("/" + "/".join(r) + "/"), F.lit("/"))
        found.append(F.when(F.contains(rest, F.lit(here)), name))
    return cut.withColumn("n_sentences", F.regexp_count("_p", F.lit("[^\\n]+")).cast("long")) \
        .withColumn("licences", F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>"))
                    .otherwise(F.array_distinct(F.array_compact(F.array(*found))))) \
        .select(*[F.col(f"`{c}`") for c in out.columns], "n_sentences", "sentence_ids", "licences")
