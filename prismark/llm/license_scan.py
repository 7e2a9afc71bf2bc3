"""Licence scans by sentence rules (native: DataFrame functions only).

A text is normalised (A-Z lower-cased, everything but a-z and 0-9 made one space, line ends kept) and cut
into sentences by stops before white space, by blank lines and by line ends. Known licence sentences are
recognised in one ordered pass: a known sentence begins where a sentence or line begins, ends where one
ends, and may be wrapped over lines; those that licences print with a stop inside (``INNER_STOPS``) may
hold stops too. Of sentences that begin at one place the one with the most words counts, and the search
goes on behind it, so a wrapped sentence counts once and each stands where it stands in the text, as often
as it does. Signs that begin a line, such as those of comments, drop out when the text is normalised.

The identifiers, in order, are then matched against ordered licence rules, each a sequence of identifiers
that must follow one another with no other known sentence between; a rule takes what it matches, so a
later, more general rule does not count it again.

Everything is done within a row: no join, no shuffle. Texts that lack every word of a small set, of which
each known sentence has one, are left out before they are normalised; they can have no known sentence.

Defined results: null and empty texts have no sentences and no licences; repeated rows are scanned each;
null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm import common

# Sentences of public licences and of usual licence notes, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-note",
    "licensed under the mit license": "mit-note",
    "this project is licensed under the mit license": "mit-note",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "spdx license identifier mit": "mit-spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-note",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "released under the apache license version 2 0": "apache-note",
    "apache license version 2 0": "apache-title",
    "spdx license identifier apache 2 0": "apache-spdx",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-obtain",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-obtain-url",
    "http www apache org licenses license 2 0": "apache-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-note",
    "licensed under the gnu general public license version 3": "gpl3-note",
    "released under the gnu general public license version 3": "gpl3-note",
    "licensed under the gnu general public license version 2": "gpl2-note",
    "spdx license identifier gpl 3 0 only": "gpl3-spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3-spdx",
    "spdx license identifier gpl 2 0 only": "gpl2-spdx",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl-version-3",
    "version 2 june 1991": "gpl-version-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under the gnu lesser general public license version 3": "lgpl3-note",
    "licensed under the gnu affero general public license version 3": "agpl3-note",
    "licensed under cc by 4 0": "cc-by-note",
    "licensed under cc by sa 4 0": "cc-by-sa-note",
    "licensed under cc by nc 4 0": "cc-by-nc-note",
    "licensed under cc by nd 4 0": "cc-by-nd-note",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-note",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-note",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-note",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-note",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-note",
    "released under cc0": "cc0-note",
    "cc0 1 0 universal": "cc0-note",
    "licensed under the bsd 3 clause license": "bsd3-note",
    "licensed under the bsd 2 clause license": "bsd2-note",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-terms",
    "licensed under the mozilla public license version 2 0": "mpl-note",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "all rights reserved": "reserved",
}
#: Rules in order: name, licence, identifiers.
RULES = [
    ("mit-full", "MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("mit-short", "MIT", ["mit-grant", "mit-notice"]),
    ("apache-header", "Apache-2.0", ["apache-head", "apache-compliance", "apache-obtain", "apache-url", "apache-basis", "apache-see"]),
    ("apache-header-url", "Apache-2.0", ["apache-head", "apache-compliance", "apache-obtain-url", "apache-basis", "apache-see"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl3-terms", "gpl-hope", "gpl-details"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl2-terms", "gpl-hope", "gpl-details"]),
    ("gpl3-title", "GPL-3.0-only", ["gpl-title", "gpl-version-3"]),
    ("gpl2-title", "GPL-2.0-only", ["gpl-title", "gpl-version-2"]),
    ("bsd3-full", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd2-full", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("zlib-full", "Zlib", ["zlib-warranty", "zlib-grant"]),
    ("unlicense-full", "Unlicense", ["unlicense-domain", "unlicense-free"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("mpl-terms", "MPL-2.0", ["mpl-terms"]),
    ("mpl-note", "MPL-2.0", ["mpl-note"]),
    ("mit-note", "MIT", ["mit-note"]),
    ("mit-spdx", "MIT", ["mit-spdx"]),
    ("mit-title", "MIT", ["mit-title"]),
    ("apache-head", "Apache-2.0", ["apache-head"]),
    ("apache-note", "Apache-2.0", ["apache-note"]),
    ("apache-spdx", "Apache-2.0", ["apache-spdx"]),
    ("apache-title", "Apache-2.0", ["apache-title"]),
    ("gpl3-note", "GPL-3.0-only", ["gpl3-note"]),
    ("gpl3-spdx", "GPL-3.0-only", ["gpl3-spdx"]),
    ("gpl2-note", "GPL-2.0-only", ["gpl2-note"]),
    ("gpl2-spdx", "GPL-2.0-only", ["gpl2-spdx"]),
    ("lgpl3-note", "LGPL-3.0-only", ["lgpl3-note"]),
    ("agpl3-note", "AGPL-3.0-only", ["agpl3-note"]),
    ("cc-by", "CC-BY-4.0", ["cc-by-note"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["cc-by-sa-note"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["cc-by-nc-note"]),
    ("cc-by-nd", "CC-BY-ND-4.0", ["cc-by-nd-note"]),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-note"]),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd-note"]),
    ("cc0", "CC0-1.0", ["cc0-note"]),
    ("bsd3-note", "BSD-3-Clause", ["bsd3-note"]),
    ("bsd2-note", "BSD-2-Clause", ["bsd2-note"]),
]
#: Sentences that their licences print with a stop before white space inside.
INNER_STOPS = {"gpl3-terms", "gpl2-terms", "gpl-hope", "mpl-terms"}
MARK = "\x01"


def telling_words(sentences: list[str], letters: int = 7) -> list[str]:
    """A small set of words, long ones where there are any, of which every sentence holds one; chosen greedily."""
    left, out = list(sentences), []
    while left:
        words = {w for s in left for w in s.split()}
        words = {w for w in words if len(w) >= letters} or words
        out.append(max(sorted(words), key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if out[-1] not in s]
    return out


def _pattern(sentences: dict[str, str]) -> str:
    """A known sentence, as group 1, between boundaries; the sentences with the most words come first."""
    ordered = sorted(sentences, key=lambda s: (-len(s.split()), s))
    inside = lambda s: f"[ \\n{MARK}]+" if sentences[s] in INNER_STOPS else "[ \\n]+"
    return f"(?:^|[\\n{MARK}]) ?({'|'.join(inside(s).join(s.split()) for s in ordered)})(?= ?[\\n{MARK}])"


def _matched(sequence: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    """A map literal's worth of counts: for each rule in order how often it takes its identifiers from the sequence ' a  b  c '."""
    counts = []
    for _, _, ids in rules:
        pattern = "  ".join(ids)
        taken = F.replace(sequence, F.lit(f" {pattern} "), F.lit(" # "))
        counts.append(((F.length(sequence) - F.length(taken)) / F.lit(len(pattern) - 1)).cast("bigint"))
        sequence = taken
    return F.array(*counts)


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """One row per text with a known sentence: doc_id, sentence_ids, rules (name:count, in rule order), licences (sorted, distinct)."""
    telling = telling_words(list(sentences))
    # in a lambda, so that a text is lower-cased once; whatever lower() does beyond A-Z, it leaves these words' letters as they are
    maybe = F.exists(F.array(F.lower(F.col(text_column))), lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in telling]))
    text = F.translate(F.col(text_column), common.UPPER + MARK, common.LOWER + "\x02")  # MARK is kept for the ends of sentences
    own = docs.where(maybe).select(F.col(id_column).alias("doc_id"), text.alias("text"))
    stops = F.regexp_replace(F.concat("text", F.lit("\n")), "[.!?;:]+[ \t\r\n]+", MARK)
    clean = F.regexp_replace(F.regexp_replace(stops, f"[^a-z0-9\n{MARK}]+", " "), "\n ?(?:\n ?)+", MARK)
    found = F.regexp_extract_all(clean, F.lit(_pattern(sentences)), F.lit(1))
    own = own.select("doc_id", found.alias("found")).where(F.size("found") > 0)
    identifiers = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    ids = F.transform("found", lambda s: F.element_at(identifiers, F.regexp_replace(s, f"[ \n{MARK}]+", " ")))
    own = own.select("doc_id", ids.alias("sentence_ids"))
    own = own.withColumn("counts", _matched(F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")), rules))
    names = F.array(*[F.lit(n) for n, _, _ in rules])
    licences = F.array(*[F.lit(x) for _, x, _ in rules])
    found = F.filter(F.arrays_zip(F.col("counts").alias("n"), names.alias("rule"), licences.alias("licence")), lambda r: r["n"] > 0)
    own = own.withColumn("found", found)
    return own.select(
        "doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join(F.transform("found", lambda r: F.concat_ws(":", r["rule"], r["n"].cast("string"))), " ").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda r: r["licence"]))), " ").alias("licences"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Word by word: every text is a table of words, each with what stands behind it (0 nothing, 1 a line's end, 2 a stop or blank line); sentences join on their first word."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"([{', '.join(q(w) for w in k.split())}], {q(v)}, {2 if v in INNER_STOPS else 1})" for k, v in SENTENCES.items())
    steps, last = [], "s0"
    for i, (_, _, ids) in enumerate(RULES):
        pattern = "  ".join(ids)
        steps.append(f"r{i} AS (SELECT *, replace({last}, ' {pattern} ', ' # ') AS s{i + 1}, ((length({last}) - length(replace({last}, ' {pattern} ', ' # '))) // {len(pattern) - 1})::BIGINT AS n{i} FROM {'base' if not i else f'r{i - 1}'})")
        last = f"s{i + 1}"
    found = ", ".join(f"{{'n': n{i}, 'rule': {q(n)}, 'licence': {q(x)}}}" for i, (n, x, _) in enumerate(RULES))
    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10), '[a-z0-9]+|[.!?;:]+[ \\t\\r\\n]+|\\n') AS x FROM documents),
u AS (SELECT r, unnest(x) AS token, generate_subscripts(x, 1) AS i FROM t),
v AS (SELECT r, i, token, regexp_matches(token, '^[a-z0-9]') AS is_word FROM u),
n AS (SELECT *, (sum(is_word::INT) OVER (PARTITION BY r ORDER BY i))::BIGINT AS p FROM v),
w AS (SELECT r, p, max(token) FILTER (is_word) AS word, CASE WHEN bool_or(NOT is_word AND token <> chr(10)) OR count(*) FILTER (token = chr(10)) > 1 THEN 2 WHEN count(*) > 1 THEN 1 ELSE 0 END AS behind FROM n WHERE p > 0 GROUP BY r, p),
l AS (SELECT r, list(word ORDER BY p) AS words, list(behind ORDER BY p) AS behind FROM w GROUP BY r),
k(words, id, most) AS (VALUES {known}),
m AS (SELECT w.r, w.p AS a, w.p + len(k.words) - 1 AS b, k.id FROM w JOIN k ON w.word = k.words[1] JOIN l ON l.r = w.r
  WHERE (w.p = 1 OR l.behind[w.p - 1] > 0) AND l.words[w.p : w.p + len(k.words) - 1] = k.words AND l.behind[w.p + len(k.words) - 1] > 0
  AND (len(k.words) = 1 OR list_max(l.behind[w.p : w.p + len(k.words) - 2]) <= k.most)),
g AS (SELECT DISTINCT r, 0::BIGINT AS a, 0::BIGINT AS b, '' AS id FROM m UNION ALL
  (SELECT m.r, m.a, m.b, m.id FROM g JOIN m ON m.r = g.r AND m.a > g.b QUALIFY row_number() OVER (PARTITION BY m.r ORDER BY m.a, m.b DESC) = 1)),
j AS (SELECT r, list(id ORDER BY a) AS ids FROM g WHERE a > 0 GROUP BY r),
base AS (SELECT t.doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS s0 FROM j JOIN t USING (r)),
{", ".join(steps)},
f AS (SELECT doc_id, ids, list_filter([{found}], lambda r: r.n > 0) AS found FROM r{len(RULES) - 1})
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids, array_to_string(list_transform(found, lambda r: r.rule || ':' || r.n), ' ') AS rules,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda r: r.licence))), ' ') AS licences FROM f
"""


OP5_SQL = _sql()
