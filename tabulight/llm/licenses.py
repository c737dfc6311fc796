"""License scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences, sentences are normalised (lower case, runs of other characters than letters and digits become one
space) and looked up among the known sentences of licences. A document is then a sequence of sentence identifiers, and a licence is
recognised where its rule, an ordered list of identifiers, occurs in that sequence; other sentences may lie between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Public licence texts (or the notices that their authors recommend), normalised sentence by sentence.
SENTENCES = {
    "apache-2-short": "licensed under the apache license version 2 0",
    "apache-2-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                      "without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-title": "mit license",
    "mit-the-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                 "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                 "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
                 "do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                    "merchantability fitness for a particular purpose and noninfringement",
    "gpl-3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-3-licensed": "licensed under the gnu general public license version 3",
    "gpl-3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                      "published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                      "published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                    "merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                 "conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
                  "in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                 "from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
                 "the above copyright notice and this permission notice appear in all copies",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-4-short": "licensed under cc by nc 4 0",
    "cc-by-4-short": "licensed under cc by 4 0",
    "cc-by-sa-4-short": "licensed under cc by sa 4 0",
    "cc0-short": "licensed under cc0 1 0",
    "cc-by-4-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# The licences and the sentence sequences that show them.
RULES = (
    ("Apache-2.0", ("apache-2-short",)),
    ("Apache-2.0", ("apache-2-grant", "apache-2-copy", "apache-2-basis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("CC-BY-4.0", ("cc-by-4-short",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC0-1.0", ("cc0-short",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-warranty")),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-3.0-only", ("gpl-3-licensed",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-warranty")),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("Unlicense", ("unlicense-grant",)),
)
# Every known sentence has one of these words; where a text has none, no sentence of it is looked up.
CUES = ("licen", "permi", "redistribut", "warrant", "copyright", "domain", "free", "2")

#: A sentence ends with a stop, question or exclamation mark, colon or semicolon before white space, or with a blank line.
#: Other line ends are white space: licence texts are wrapped.
SENTENCE_END = r"[.!?:;]+[ \t\r\n]+|\n[ \t\r\n]*\n"
#: A notice often stands on a line of its own, between lines without stops: so texts are also cut at all line ends.
LINE_END = rf"{SENTENCE_END}|\n"
OTHER = "[^a-z0-9]+"

GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

{}Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
# Notices that a sentence end cuts within, as their authors write them. The blank lines of the Apache notice hold a sign
# where it is a comment, and then they end no sentence: the address is part of one.
NOTICES = (
    ("Apache-2.0", "apache-2-notice", APACHE.format("")),
    ("Apache-2.0", "apache-2-notice", APACHE.format("http://www.apache.org/licenses/LICENSE-2.0\n\n").replace("\n", "\n# ")),
    ("Apache-2.0", "apache-2-notice", APACHE.format("https://www.apache.org/licenses/LICENSE-2.0\n\n").replace("\n", "\n# ")),
    ("GPL-2.0-or-later", "gpl-2-notice", GPL.format(";", ";", 2)),
    ("GPL-2.0-or-later", "gpl-2-notice", GPL.format(";", ",", 2)),
    ("GPL-3.0-or-later", "gpl-3-notice", GPL.format(":", ",", 3)),
    ("GPL-3.0-or-later", "gpl-3-notice", GPL.format(";", ";", 3)),
    ("MPL-2.0", "mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def normalised(notice: str) -> list[str]:
    """The sentences of a notice, cut and normalised as those of a document."""
    found = (re.sub(OTHER, " ", part.lower()).strip() for part in re.split(SENTENCE_END, notice))
    return [words for words in found if words]


def with_notices(sentences: dict[str, str], rules: tuple, notices: tuple) -> tuple[dict[str, str], tuple]:
    """Sentences and rules, and an identifier for each further sentence of the notices, and their sequences as rules."""
    names, more = {words: name for name, words in sentences.items()}, []
    for licence, name, notice in notices:
        parts = normalised(notice)
        for words in parts:
            taken = sum(n.startswith(f"{name}-") for n in names.values())
            names.setdefault(words, f"{name}-{taken + 1}")
        more.append((licence, tuple(names[words] for words in parts)))
    return {name: words for words, name in names.items()}, (*rules, *more)


SENTENCES, RULES = with_notices(SENTENCES, RULES, NOTICES)


def identifiers(text: Column, cut: str, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for name, words in sentences.items() for x in (words, name)))
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " "))
    return F.array_compact(F.transform(F.split(text, cut), lambda s: F.element_at(known, normal(s))))


def pattern(rule: tuple[str, ...]) -> str:
    """Finds the identifiers of a rule in this order, others between them allowed, in a sequence with spaces around each."""
    return ".*".join(f" {i} " for i in rule)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", sentences: dict[str, str] = SENTENCES,
         rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """One row per document: ``doc_id``, ``sentences`` and ``line_sentences`` (identifiers in order, by either cut), ``licenses``
    (names in alphabetical order, of the rules that match either sequence).

    A null or empty text has none of them: empty arrays. Keys may be null or repeated; each row is a document. Whole texts are
    read, without a shuffle. An empty table gives an empty one; other columns are not read.
    """
    cue = F.lower(text).rlike("|".join(CUES))
    none = F.array().cast("array<string>")
    marked = docs.select(F.col(key).alias("doc_id"), *(
        F.coalesce(F.when(cue, identifiers(F.col(text), cut, sentences)), none).alias(name)
        for name, cut in (("sentences", SENTENCE_END), ("line_sentences", LINE_END))))
    sequence = F.concat(*(part for name in ("sentences", "line_sentences") for part in (F.lit(" "), F.array_join(name, "  "), F.lit(" \n"))))
    hits = []
    for name in sorted({n for n, _ in rules}):
        either = "|".join(pattern(ids) for n, ids in rules if n == name)            # a dot stops at the end of a sequence
        hits.append(F.when(sequence.rlike(either), F.lit(name)))
    licences = F.when(F.size("sentences") + F.size("line_sentences") > 0, F.array_compact(F.array(*hits)))
    return marked.withColumn("licenses", F.coalesce(licences, none))


def scan_sql(sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> str:
    """DuckDB SQL for ``scan`` of ``documents``, arrays joined by commas."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    cut = lambda s: "E'" + s.replace("\\", "\\\\") + "'"
    known = "MAP {" + ", ".join(f"{text(words)}: {text(name)}" for name, words in sentences.items()) + "}"
    found = lambda at: f"""list_filter(list_transform(string_split_regex(coalesce(text, ''), {cut(at)}),
        lambda s: {known}[trim(regexp_replace(lower(s), '{OTHER}', ' ', 'g'))]), lambda s: s IS NOT NULL)"""  # noqa: E731
    hits = ", ".join(
        f"CASE WHEN regexp_matches(seq, {text('|'.join(pattern(ids) for n, ids in rules if n == name))}) THEN '{name}' END" for name in sorted({n for n, _ in rules}))
    return f"""
        WITH marked AS (SELECT doc_id, {found(SENTENCE_END)} AS a, {found(LINE_END)} AS b FROM documents),
        joined AS (SELECT *, ' ' || array_to_string(a, '  ') || ' ' || chr(10) || ' ' || array_to_string(b, '  ') || ' ' || chr(10) AS seq FROM marked)
        SELECT doc_id, array_to_string(a, ',') AS sentences, array_to_string(b, ',') AS line_sentences,
               array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS licenses FROM joined"""
