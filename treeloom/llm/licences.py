"""Licence recognition by sentences and rules.

Text is read as sentences. A sentence, normalised to its lower-case words, is
looked up in a table of known licence sentences and becomes that sentence's
identifier; ``*`` in the table stands for one to twelve words (names, years).
The sequence of a text's identifiers is then held against licence rules, each
an ordered list of identifiers. Longer rules go first, and a sentence that one
rule has used is not used again.

A sentence begins at the start of the text or of a line, or after a mark of
punctuation and white space; bullets, comment signs and quotes before it don't
count. It may run over line breaks, and ends where a known sentence ends before
punctuation, a line break or the end of the text.

Defined results for odd input: a null or empty text has no licence; very long
texts are scanned whole; where several known sentences fit, the longest counts,
and of equal rules the one listed first; a rule found several times is
reported once for each time; repeated rows get equal results; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import table, tidy

#: Public licence sentences by identifier.
SENTENCES = {
    "copyright": "copyright * all rights reserved",
    "mit-short": "released under the mit license",
    "mit-short-licensed": "licensed under the mit license",
    "mit-short-distributed": "distributed under the mit license",
    "mit-short-project": "this project is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-short": "licensed under the isc license",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-short-the-license": "licensed under the apache license version 2 0 the license",
    "apache-short-project": "this project is licensed under the apache license version 2 0",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-short-2": "licensed under the bsd 2 clause license",
    "bsd-short-3": "licensed under the bsd 3 clause license",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-short-licensed": "licensed under the gnu general public license version 3",
    "gpl2-short": "this work is licensed under the gnu general public license version 2",
    "gpl2-short-licensed": "licensed under the gnu general public license version 2",
    "gpl3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-free-software": "this program is free software",
    "gpl3-terms-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3-terms-or-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-short": "licensed under the gnu affero general public license version 3",
    "lgpl3-short": "licensed under the gnu lesser general public license version 3",
    "lgpl21-short": "licensed under the gnu lesser general public license version 2 1",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope-half": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-merchantability": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-long": "to the extent possible under law * has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-short": "distributed under the boost software license version 1 0",
}

#: Fixed values: (licence, identifiers in order), most specific first among rules of one length.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache-short-the-license", "apache-compliance", "apache-copy", "apache-basis", "apache-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("GPL-3.0-or-later", ("gpl-free-software", "gpl3-terms-or-later", "gpl-hope-half", "gpl-merchantability", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-free-software", "gpl2-terms-or-later", "gpl-hope-half", "gpl-merchantability", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-or-later", "gpl-hope", "gpl-details")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("GPL-3.0-or-later", ("gpl-free-software", "gpl3-terms-or-later")),
    ("GPL-2.0-or-later", ("gpl-free-software", "gpl2-terms-or-later")),
    ("AGPL-3.0-or-later", ("gpl-free-software", "agpl3-terms-or-later")),
    ("GPL-3.0-or-later", ("gpl3-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-or-later",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("Apache-2.0", ("apache-short-the-license",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-short-project",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-licensed",)),
    ("MIT", ("mit-short-distributed",)),
    ("MIT", ("mit-short-project",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-short",)),
    ("BSD-2-Clause", ("bsd-short-2",)),
    ("BSD-3-Clause", ("bsd-short-3",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("gpl3-short-licensed",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("GPL-2.0-only", ("gpl2-short-licensed",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("LGPL-3.0-only", ("lgpl3-short",)),
    ("LGPL-2.1-only", ("lgpl21-short",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC0-1.0", ("cc0-long",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("BSL-1.0", ("boost-short",)),
)

WORD = re.compile(r"[^\W_]+")
#: What may stand between the words of a sentence: no blank line.
MARKS = re.compile(r"[\W_]*")
#: Signs that may stand before a sentence on its line.
DECORATION = " \t\r\x0b\x0c#/*-;%>|\"'()[]<!.:+=~`0123456789•“”‘’«»"
WILD = 12


class Phrases:
    """The known sentences as a tree of words."""

    def __init__(self, sentences: dict[str, str]) -> None:
        self.tree: dict = {}
        for name, text in sentences.items():
            node = self.tree
            for w in text.split():
                node = node.setdefault(w, {})
            node[""] = name
        heads = {tuple(t.split()[:2]) for t in sentences.values()}
        options = sorted(a + r"[\W_]+" + ("" if b == "*" else b + r"(?![^\W_])") for a, b in heads)
        self.head = re.compile(r"(?<![^\W_])(?:" + "|".join(options) + ")", re.IGNORECASE)

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(end, identifier) of the longest known sentence that begins at ``at``."""
        best: tuple[int, str] | None = None
        todo = [(at, self.tree, 0)]
        while todo:
            place, node, wild = todo.pop()
            if "" in node and ended(text, place) and (best is None or place > best[0]):
                best = (place, node[""])
            found = WORD.search(text, place)
            if found is None or (place > at and "\n\n" in text[place : found.start()]):
                continue
            word = found[0].lower()
            if word in node:
                todo.append((found.end(), node[word], 0))
            if "*" in node:
                todo.append((found.end(), node["*"], 1))
            if 0 < wild < WILD:
                todo.append((found.end(), node, wild + 1))
        return best


def ended(text: str, at: int) -> bool:
    """Whether a sentence may end at ``at``: before punctuation, a line break or the end."""
    rest = text[at : at + 3]
    mark = rest.lstrip(" \t\"')]”’»")
    return len(text) <= at or not mark or mark[0] in "\n\r.;:!?," and (len(mark) == 1 or mark[0] in "\n\r" or mark[1] in " \t\r\n\"')]”’»")


def begins(text: str, at: int) -> bool:
    """Whether a sentence may begin at ``at``."""
    while at and text[at - 1] in DECORATION:
        if text[at - 1] in ".;:!?" and text[at : at + 1].isspace():
            return True
        at -= 1
    return at == 0 or text[at - 1] == "\n" or (text[at - 1] in ".;:!?")


@dataclass(frozen=True)
class Found:
    identifier: str
    start: int
    end: int


def identified(text: str, phrases: Phrases) -> list[Found]:
    """The known sentences of ``text`` in order."""
    out, free = [], 0
    for head in phrases.head.finditer(text):
        at = head.start()
        if at < free or not begins(text, at):
            continue
        if found := phrases.longest(text, at):
            out.append(Found(found[1], at, found[0]))
            free = found[0]
    return out


def recognised(found: list[Found], rules=RULES) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, sentences) for each rule that the sequence satisfies, in order of start."""
    places: dict[str, list[int]] = {}
    for i, f in enumerate(found):
        places.setdefault(f.identifier, []).append(i)
    out = []
    for licence, wanted in sorted(rules, key=lambda r: -len(r[1])):
        if not all(w in places for w in wanted):
            continue
        used: set[int] = set()
        cursor = [0] * len(wanted)  # each only moves on, so a rule costs one sweep
        while True:
            taken, at = [], -1
            for k, name in enumerate(wanted):
                here = places[name]
                while cursor[k] < len(here) and (here[cursor[k]] <= at or here[cursor[k]] in used):
                    cursor[k] += 1
                if cursor[k] == len(here):
                    break
                at = here[cursor[k]]
                taken.append(at)
            if len(taken) < len(wanted):
                break
            used.update(taken)
            out.append((licence, found[taken[0]].start, found[taken[-1]].end, len(taken)))
        for name in set(wanted):
            places[name] = [i for i in places[name] if i not in used]
            if not places[name]:
                del places[name]
    return sorted(out, key=lambda x: (x[1], x[0]))


SCAN = "struct<licences:array<string>,matches:array<struct<licence:string,start:bigint,end:bigint,sentences:bigint>>,sentences:array<string>>"


def licences(text: Column, sentences: dict[str, str] = SENTENCES, rules=RULES) -> Column:
    """A struct of the distinct licences in order of name, the matches with their character spans, and all sentence identifiers."""

    @tidy
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        phrases = Phrases(sentences)
        match = pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.int64())])
        kind = pa.struct([("licences", pa.list_(pa.string())), ("matches", pa.list_(match)), ("sentences", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for t in batch:
                found = identified(t.as_py() or "", phrases)
                got = recognised(found, rules)
                rows.append({
                    "licences": sorted({g[0] for g in got}),
                    "matches": [dict(zip(("licence", "start", "end", "sentences"), g, strict=True)) for g in got],
                    "sentences": [f.identifier for f in found],
                })
            yield pa.array(rows, kind)

    return F.arrow_udf(scan, SCAN)(text.cast("string"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", licences(F.col("text")).alias("s")).select("doc_id", "s.*")
