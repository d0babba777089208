"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences; a sentence is normalised (lower case, everything but a-z and 0-9 to single
blanks) and looked up among known licence sentences.  Known sentences that the cut itself parts (at a blank
line or an abbreviation) are looked for as their pieces, one right after the other.  A sentence that runs
over lines and is unknown is tried line by line.  The known sentences' identifiers, in order of the text,
are matched against ordered rules: each rule is a sequence of identifiers; what a rule matches is taken out
before the next rule.

Defined cases: a null or empty text has no sentences; repeated rows give repeated results; identifiers
that no rule takes give the licence ``unknown``; an empty table gives an empty result; extra columns are
ignored; everything works on whole texts, row by row, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text

#: Identifier -> known sentence (normalised by the rule above when compared).
SENTENCES = {
    "agpl3_name": "GNU Affero General Public License, version 3",
    "apache2_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                     "except in compliance with the License",
    "apache2_limits": "See the License for the specific language governing permissions and limitations under the License",
    "apache2_name": "Licensed under the Apache License, Version 2.0",
    "apache2_warranty": "Unless required by applicable law or agreed to in writing, software distributed under the "
                        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                        "either express or implied",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
                  "the following disclaimer",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
           "to this work",
    "cc_by4": "Licensed under CC BY 4.0",
    "cc_by_nc4": "Licensed under CC BY-NC 4.0",
    "cc_by_sa4": "Licensed under CC BY-SA 4.0",
    "gpl3_name": "This work is licensed under the GNU General Public License, version 3",
    "gpl_copy": "You should have received a copy of the GNU General Public License along with this program",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                 "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                 "subject to the following conditions:",
    "mit_name": "Released under the MIT License",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the Software",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}
#: Identifier -> the known sentence with the blank line that its standard notice has.
BROKEN = {"apache2_copy": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"}
#: Licence -> identifiers in order; longer rules come first.
RULES = [
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_warranty", "apache2_limits")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_copy")),
    ("BSD-3-Clause", ("bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("AGPL-3.0", ("agpl3_name",)),
    ("Apache-2.0", ("apache2_name",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC0-1.0", ("cc0",)),
    ("GPL-3.0", ("gpl3_name",)),
    ("MIT", ("mit_name",)),
    ("MPL-2.0", ("mpl2",)),
    ("proprietary", ("reserved",)),
]
#: Sentence ends (RE2 and Java read them alike): a mark and white space, or a blank line.
SENTENCE_RE = r"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09\x0B-\x0D]*\n"


def normalise(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).strip()


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {" ".join(normalise(s).split()): k for k, s in sentences.items()}


def cut_sentences(sentences: dict[str, str]) -> dict[int, list[str]]:
    """Number of pieces -> normalised first pieces, of the known sentences that the cut parts."""
    out: dict[int, list[str]] = {}
    for text in [*sentences.values(), *(s for k, s in BROKEN.items() if k in sentences)]:
        pieces = [p for p in re.split(SENTENCE_RE, text) if normalise(p)]
        if len(pieces) > 1:
            out.setdefault(len(pieces), []).append(" ".join(normalise(pieces[0]).split()))
    return out


def _norm(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), F.lit("[^a-z0-9]+"), F.lit(" ")))


def licence_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, sentence_ids (in order, comma-joined) and
    licences (in order of the rules, comma-joined)."""
    known = known_sentences(sentences)
    keys, shortest = list(known), min(map(len, known))
    named = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = F.filter(F.split("text", SENTENCE_RE), lambda s: s.rlike("[A-Za-z0-9]"))
    joined = F.col("parts")
    for n, heads in cut_sentences(sentences).items():  # the other pieces are no known sentences by themselves

        def whole(s: Column, k: Column) -> Column:
            run = F.array_join(F.slice("parts", k + 1, F.lit(n)), " ")
            long_enough = F.length(s) >= min(map(len, heads))
            return F.when(long_enough & _norm(s).isin(heads) & _norm(run).isin(keys), run).otherwise(s)

        joined = F.transform(joined, whole)
    whole_or_lines = F.flatten(F.transform(F.filter("joined", lambda s: F.length(s) >= shortest), lambda s: F.when(
        F.instr(s, "\n") > 0, F.when(_norm(s).isin(keys), F.array(s)).otherwise(F.split(s, "\n"))).otherwise(F.array(s))))
    ids = F.transform(F.filter(F.transform("tried", _norm), lambda s: s.isin(keys)), lambda s: named[s])
    found = id_text(docs).withColumn("parts", parts).withColumn("joined", joined).withColumn("tried", whole_or_lines).select(
        "doc_id", F.size("parts").cast("long").alias("n_sentences"), ids.alias("ids")).select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("_left"))
    hits = []
    for k, (name, sequence) in enumerate(rules):  # ",a,,b," holds the sequence a, b; what is taken becomes "-"
        pattern = "," + ",,".join(sequence) + ","
        found = found.withColumn(f"_hit{k}", F.contains(F.col("_left"), F.lit(pattern))) \
            .withColumn("_left", F.replace(F.col("_left"), F.lit(pattern), F.lit("-")))
        hits.append(F.when(F.col(f"_hit{k}"), F.lit(name)))
    hits.append(F.when(F.col("_left").rlike("[a-z]"), F.lit("unknown")))
    licences = F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",")
    return found.select("doc_id", "n_sentences", "n_known", "sentence_ids", licences.alias("licences"))
