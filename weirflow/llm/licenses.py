"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) with marks where a sentence
may begin or end: full stops and blank lines, which no sentence goes over, and single line ends,
colons and semicolons, which a sentence may hold inside, as wrapped licence texts do.  What
stands between two marks and is a known licence sentence gives its identifier; of two that begin
at one mark, the longer.  A holder's name within a sentence is left open.  The identifiers of a
document, in order, are then matched against the licence rules: sequences of identifiers, tried
in their order; what a rule matched is used up, so a longer rule hides the shorter ones in it.
Between the sentences of a sequence any text may stand that holds no known sentence.

``SENTENCES`` and ``RULES`` are the one-line forms, those of the query's SQL; ``PUBLISHED`` and
``PUBLISHED_RULES`` are the licences' own wording.  SQL cuts at every line end and knows the
former only, so the two agree on texts whose known sentences stand on one line each.

Defined results: a null text has no sentences; a document without known sentences has the
licence 'none', one whose sentences make up no rule 'unknown'; licences are listed in the order
of the rules.  Whole texts are scanned; rows are independent, so nothing is shuffled, repeated
rows have equal results and an empty table an empty one.  Columns other than text and those kept
are not read; kept ones may have any name but sentence_ids and license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheLic",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "this software is released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITPerm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "GPLv3",
    "this work is licensed under the gnu general public license version 2": "GPLv2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPLFree",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLHope",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "licensed under cc by 4 0": "CCBY4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDUse",
    "redistributions of source code must retain the above copyright notice": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDBinary",
    "all rights reserved": "AllRights",
}
#: Licence and its sequence of identifiers, in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("ApacheLic", "ApacheUse", "ApacheCopy", "ApacheSee")),
    ("Apache-2.0", ("ApacheLic",)),
    ("MIT", ("MITPerm", "MITNotice", "AsIs")),
    ("MIT", ("MITRef",)),
    ("BSD", ("BSDUse", "BSDSource", "BSDBinary")),
    ("GPL", ("GPLFree", "GPLHope")),
    ("GPL-3.0", ("GPLv3",)),
    ("GPL-2.0", ("GPLv2",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("proprietary", ("AllRights",)),
)
# Normalised sentences as the licences' own texts and notices have them.
_GPL_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_GPL_LATER = "of the license or at your option any later version"
PUBLISHED = {
    "licensed under the apache license version 2 0 the license": "ApacheLic",
    "apache license version 2 0 january 2004": "ApacheLic",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITPerm",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSourceText",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinaryText",
    "gnu general public license version 3 29 june 2007": "GPLv3",
    "gnu general public license version 2 june 1991": "GPLv2",
    f"{_GPL_FREE} as published by the free software foundation either version 3 {_GPL_LATER}": "GPLFree3",
    f"{_GPL_FREE} as published by the free software foundation either version 2 {_GPL_LATER}": "GPLFree2",
    f"{_GPL_FREE} version 3 as published by the free software foundation": "GPLFree3",
    f"{_GPL_FREE} version 2 as published by the free software foundation": "GPLFree2",
    f"{_GPL_FREE} as published by the free software foundation version 3": "GPLFree3",
    f"{_GPL_FREE} as published by the free software foundation version 2": "GPLFree2",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLHope",
}
# More licences by their own wording.  A star is a holder's name of up to twelve words.
PUBLISHED |= {
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDName",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission of *": "BSDName",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCPerm",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCPerm",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCAsIs",
    "this source code form is subject to the terms of the mozilla public license v": "MPLForm",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPLCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPLCopy",
    "mozilla public license version 2 0": "MPLTitle",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "distributed under the boost software license version 1 0": "Boost",
    "boost software license version 1 0 august 17th 2003": "Boost",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPerm",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3",
    "gnu lesser general public license version 2 1 february 1999": "LGPL2.1",
    "gnu affero general public license version 3 19 november 2007": "AGPL3",
}


def _gnu_notices(short: str, name: str, program: str, versions: tuple[str, ...]) -> dict[str, str]:
    """The notices of a GNU licence, of a version only or of it and later ones."""
    free = f"this {program} is free software you can redistribute it and or modify it under the terms of the gnu {name} general public license"
    by = "as published by the free software foundation"
    number = {v: v.replace(".", " ") for v in versions}
    return {t: f"{short}Free{v}" for v in versions for t in (f"{free} {by} either version {number[v]} {_GPL_LATER}", f"{free} version {number[v]} {by}", f"{free} {by} version {number[v]}")}


PUBLISHED |= _gnu_notices("LGPL", "lesser", "library", ("2.1", "3")) | _gnu_notices("LGPL", "lesser", "program", ("2.1", "3")) | _gnu_notices("AGPL", "affero", "program", ("3",))
PUBLISHED["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "GPLHope"
# Identifiers of the public list of licences that a file may name, and the licence here.
NAMED = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "ISC": "ISC", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "BSL-1.0": "BSL-1.0", "Zlib": "Zlib",
    "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD-3-Clause",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
PUBLISHED |= {"spdx license identifier " + n.lower().replace("-", " ").replace(".", " "): f"Named{n}" for n in NAMED}
#: Tried before the rules of the same licence; their identifiers come from ``PUBLISHED``.
PUBLISHED_RULES = (
    ("BSD-3-Clause", ("AllRights", "BSDUse", "BSDSourceText", "BSDBinaryText", "BSDName")),
    ("BSD-3-Clause", ("BSDUse", "BSDSourceText", "BSDBinaryText", "BSDName")),
    ("BSD", ("AllRights", "BSDUse", "BSDSourceText", "BSDBinaryText")),
    ("BSD", ("BSDUse", "BSDSourceText", "BSDBinaryText")),
    ("GPL-3.0", ("GPLFree3", "GPLHope")),
    ("GPL-3.0", ("GPLFree3",)),
    ("GPL-2.0", ("GPLFree2", "GPLHope")),
    ("GPL-2.0", ("GPLFree2",)),
    ("LGPL-3.0", ("LGPLFree3", "GPLHope")),
    ("LGPL-3.0", ("LGPLFree3",)),
    ("LGPL-3.0", ("LGPL3",)),
    ("LGPL-2.1", ("LGPLFree2.1", "GPLHope")),
    ("LGPL-2.1", ("LGPLFree2.1",)),
    ("LGPL-2.1", ("LGPL2.1",)),
    ("AGPL-3.0", ("AGPLFree3", "GPLHope")),
    ("AGPL-3.0", ("AGPLFree3",)),
    ("AGPL-3.0", ("AGPL3",)),
    ("ISC", ("ISCPerm", "ISCAsIs")),
    ("ISC", ("ISCPerm",)),
    ("MPL-2.0", ("MPLForm", "MPLCopy")),
    ("MPL-2.0", ("MPLForm",)),
    ("MPL-2.0", ("MPLTitle",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("Boost",)),
    ("Zlib", ("ZlibAsIs", "ZlibPerm")),
    *((licence, (f"Named{n}",)) for n, licence in NAMED.items()),
)
_OWN = [name for name, _ in RULES]
#: The rules of licences that ``RULES`` does not have, then those of each licence in the order of ``RULES``.
ALL_RULES = (
    *(p for p in PUBLISHED_RULES if p[0] not in _OWN),
    *(r for k, rule in enumerate(RULES) for r in (*(p for p in PUBLISHED_RULES if p[0] == rule[0] and rule[0] not in _OWN[:k]), rule)),
)
#: Every known sentence holds one of these.
KEYWORDS = "licen|permi|warrant|redistribut|copyright|rights|public domain|copy of the mpl"
#: Steps of normalising in order: a full stop or blank line becomes ``|``, a colon, semicolon or
#: line end ``/``, other characters a space, and neighbouring marks one (``|`` if any is).
STEPS = (
    (r"[.!?](?=[ \t\r\n])|\n[ \t\r]*+(?=\n)|\r[ \t]*+(?=\r)", "|"),
    (r"[;:](?=[ \t])|[\r\n]", "/"),
    (r"[^a-z0-9|/]+", " "),
    (r" ?/[ /]*+", "/"),
    (r"[ /]?\|[ /|]*+", "|"),
)


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    sentences = PUBLISHED | SENTENCES
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    low = F.lower(text)
    marked = F.concat(F.lit("\n\n"), F.translate(low, "|/", "--"), F.lit("\n\n"))
    for pattern, mark in STEPS:
        marked = F.regexp_replace(marked, pattern, mark)
    # a name's words end at a mark of the sentence or go over line ends, not over full stops
    name = r"[a-z0-9]+(?:[ /][a-z0-9]+){0,11}"
    spread = {t: t.replace(" ", "[ /]").replace("*", name) for t in sentences}
    either = "|".join(spread[t] for t in sorted(sentences, key=len, reverse=True))
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[|/])(?:{either})(?=[|/])"), F.lit(0))

    def known_as(sentence: Column) -> Column:
        plain = F.translate(sentence, "/", " ")
        for t in sorted((t for t in sentences if "*" in t), key=len):
            plain = F.regexp_replace(plain, "^" + t.replace("*", f"(?:{name.replace('[ /]', ' ')})") + "$", t)
        return known[plain]

    ids = F.transform(found, known_as)
    return F.when(low.rlike(KEYWORDS), ids).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of ``docs`` with sentence_ids (comma-separated) and license."""
    ids = "_" * (1 + max((len(k) - len(k.lstrip("_")) for k in keep), default=0)) + "ids"  # no kept column's name
    found = docs.select(*keep, sentence_ids(F.col("text")).alias(ids))
    # each identifier stands between two marks of its own, so neighbours can be used up one by one
    joined = F.concat(F.lit(";"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit(";"))), ";"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f";{i};" for i in sequence)).alias("wanted")) for name, sequence in ALL_RULES))
    start = F.struct(joined.alias("rest"), F.array().cast("array<string>").alias("names"))

    def use_up(state: Column, rule: Column) -> Column:
        used = F.struct(F.replace(state["rest"], rule["wanted"], F.lit("#")).alias("rest"), F.concat(state["names"], F.array(rule["name"])).alias("names"))
        return F.when(F.contains(state["rest"], rule["wanted"]), used).otherwise(state)

    licences = F.array_join(F.array_distinct(F.aggregate(rules, start, use_up)["names"]), ",")
    verdict = F.when(F.size(ids) == 0, F.lit("none")).when(licences != "", licences).otherwise(F.lit("unknown"))
    return found.select(*keep, F.array_join(ids, ",").alias("sentence_ids"), verdict.alias("license"))
