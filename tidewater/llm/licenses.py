"""Licence recognition by sentence rules.

The word sequence of a text is searched for known licence sentences, whatever line breaks, comment
leaders and punctuation stand between the words, and a document's sequence of known identifiers is
matched against ordered rules.  A known sentence starts and ends where the text has a cut: a sentence
end or a line end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices

# Wording of public licences and notices, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    4: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
       "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    5: "See the License for the specific language governing permissions and limitations under the License",
    6: "SPDX-License-Identifier: Apache-2.0",
    10: "Released under the MIT License",
    11: "Licensed under the MIT License",
    12: "The MIT License",
    13: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    14: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    15: "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    16: "SPDX-License-Identifier: MIT",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    23: "See the GNU General Public License for more details",
    24: "SPDX-License-Identifier: GPL-3.0-or-later",
    30: "Licensed under CC BY-NC 4.0",
    31: "Licensed under CC BY 4.0",
    32: "Licensed under CC BY-SA 4.0",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    34: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    44: "SPDX-License-Identifier: BSD-3-Clause",
}
# Rule, licence, and the sentences that it needs in this order.
RULES = [
    ("apache-notice", "Apache-2.0", (1,)), ("apache-header", "Apache-2.0", (2, 3, 4, 5)), ("apache-spdx", "Apache-2.0", (6,)),
    ("mit-release", "MIT", (10,)), ("mit-notice", "MIT", (11,)), ("mit-text", "MIT", (13, 14, 15)),
    ("mit-titled", "MIT", (12, 13, 14, 15)), ("mit-spdx", "MIT", (16,)),
    ("gpl3-notice", "GPL-3.0", (20,)), ("gpl3-header", "GPL-3.0", (21, 22, 23)), ("gpl3-spdx", "GPL-3.0", (24,)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", (30,)), ("cc-by-nc-long", "CC-BY-NC-4.0", (34,)),
    ("cc-by-notice", "CC-BY-4.0", (31,)), ("cc-by-long", "CC-BY-4.0", (33,)), ("cc-by-sa-notice", "CC-BY-SA-4.0", (32,)),
    ("bsd2-text", "BSD-2-Clause", (40, 41, 42)), ("bsd3-text", "BSD-3-Clause", (40, 41, 42, 43)),
    ("bsd3-spdx", "BSD-3-Clause", (44,)),
]

#: A line that neither ends a sentence nor is followed by a capital goes on in the next one.
WRAP = r"([^.!?:;\s])[ \t]*\r?\n[ \t]*([a-z(])"
CUT = r"[.!?]+\s+|\s*\n\s*"
#: Up to this many other known sentences may stand between two of a rule.
GAP = 2
SLICE_BYTES = 4 << 20


def _normal(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _tables() -> tuple[tuple[str, ...], re.Pattern, dict[str, list[tuple[int, re.Pattern]]]]:
    """A word of each known sentence, its longest; the first two words of all; and by these the sentences, longest first."""
    gap = "[^a-z0-9]+"
    words = {sid: _normal(s).split() for sid, s in SENTENCES.items()}
    long = tuple(sorted({max(w, key=len) for w in words.values()}))
    heads: dict[str, list[tuple[int, re.Pattern]]] = {}
    for sid, w in sorted(words.items(), key=lambda x: (-len(x[1]), x[0])):
        heads.setdefault(" ".join(w[:2]), []).append((sid, re.compile(gap.join(w) + "(?![a-z0-9])")))
    return long, re.compile("|".join(h.replace(" ", gap) for h in sorted(heads))), heads


_LONG, _HEAD, _BY_HEAD = _tables()
_WRAP, _CUT, _WORD = re.compile(WRAP, re.ASCII), re.compile(CUT, re.ASCII), re.compile("[a-z0-9]")


def known_sentences(text: str) -> list[tuple[int, int]]:
    """(at, sid) of the known sentences of a text in order, the longest at a place; ``at`` counts the cuts before it."""
    low = text.lower()
    if not any(w in low for w in _LONG):
        return []
    low = _WRAP.sub(r"\1 \2", text).lower()
    cuts = [m.span() for m in _CUT.finditer(low)]
    starts, ends = [a for a, _ in cuts], [b for _, b in cuts]
    out, here = [], 0
    while (head := _HEAD.search(low, here)) is not None:
        a = head.start()
        here = a + 1
        at = bisect_right(ends, a)
        if _WORD.search(low, ends[at - 1] if at else 0, a):
            continue
        for sid, whole in _BY_HEAD[_normal(head.group())]:
            found = whole.match(low, a)
            if found is None:
                continue
            b = found.end()
            k = bisect_left(starts, b)
            if not _WORD.search(low, b, starts[k] if k < len(starts) else len(low)):
                out.append((at, sid))
                here = b
                break
    return out


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, sid) of every known sentence."""
    kept = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                out = [(k, at, sid) for k, t in enumerate(part.column(1).to_pylist()) for at, sid in known_sentences(t)]
                if out:
                    k, at, sid = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(k)), pa.array(at, pa.int32()), pa.array(sid, pa.int32())], ["id", "at", "sid"])

    return kept.mapInArrow(run, f"id {kind}, at int, sid int")


def rule_patterns() -> list[tuple[str, str, int, str]]:
    """(rule, licence, sentences, pattern) where the pattern matches a sequence written as |1|2|3|."""
    step = rf"([0-9]+\|){{0,{GAP}}}"
    return [(name, licence, len(ids), r"\|" + step.join(rf"{i}\|" for i in ids)) for name, licence, ids in RULES]


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: id, ``license``, ``rule`` (of that licence's matching rules the
    one with most sentences, then by name), ``sentences`` (in the rule), ``first`` (number of the
    document's first known sentence among its cuts, from 0) and ``sequence`` (the known sentences in order).

    Null and empty texts match nothing.  Rows that repeat an id are read as one document of all their
    sentences.  Rows without an id are left out, as nothing names them.  An empty table gives an empty
    result; other columns are ignored."""
    hits = _hits(docs, id_col, text_col).distinct()
    line = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("at", "sid"))), lambda x: x["sid"].cast("string")))
    seen = hits.groupBy("id").agg(F.concat(F.lit("|"), line, F.lit("|")).alias("sequence"), F.min("at").alias("first"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("license"), F.lit(n).alias("sentences"), F.lit(p).alias("p"))
                      for r, x, n, p in rule_patterns()])
    found = (seen.select("id", "sequence", "first", F.explode(rules).alias("r"))
             .where(F.expr("sequence rlike r.p")).select("id", "sequence", "first", "r.rule", "r.license", "r.sentences"))
    best = F.min(F.struct((-F.col("sentences")).alias("less"), "rule"))
    return (found.groupBy("id", "license", "sequence", "first").agg(best.alias("best"))
            .select(F.col("id").alias(id_col), "license", F.col("best.rule").alias("rule"),
                    (-F.col("best.less")).alias("sentences"), "first", "sequence"))


def oracle() -> str:
    """The same result in DuckDB SQL over the table documents, for sentences that no line break cuts: it looks up whole cuts."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {text(_normal(s))})" for k, s in SENTENCES.items())
    rules = ", ".join(f"({text(r)}, {text(x)}, {n}, {text(p)})" for r, x, n, p in rule_patterns())
    return f"""
WITH known(sid, sentence) AS (VALUES {known}),
rules(rule, license, sentences, p) AS (VALUES {rules}),
parts AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, {text(WRAP)}, '\\1 \\2', 'g'), {text(CUT)}) AS s
          FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS raw FROM parts),
hits AS (SELECT DISTINCT doc_id, pos, sid
         FROM (SELECT doc_id, pos, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM cut) JOIN known USING (sentence)),
seen AS (SELECT doc_id, '|' || string_agg(CAST(sid AS VARCHAR), '|' ORDER BY pos, sid) || '|' AS sequence, min(pos) AS first
         FROM hits GROUP BY doc_id),
found AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY sentences DESC, rule) AS k
          FROM seen, rules WHERE regexp_matches(sequence, p))
SELECT doc_id, license, rule, sentences, CAST(first AS INTEGER) AS first, sequence FROM found WHERE k = 1
"""
