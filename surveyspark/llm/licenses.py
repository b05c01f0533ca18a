"""Licence scan with a positional index of rare words, in DataFrame functions only.

1. Document frequency, over all documents, of every word of the templates.
2. Per template, the rarest words (highest IDF) are its index entries: word -> (template, position).
3. Each file takes those of its words that are entries, highest IDF first; a
   template of which it has enough words, among them the rarest one of the key
   phrases, is a candidate.  A template with a key word that no document has
   gets no postings.
4. Candidates' postings are intersected by relative position (place in the file
   minus place in the template): enough hits must agree on one.
5. Only then the template's key phrases are looked for; with all of them it
   gives its label.  Versions are templates of their own.

Null and empty texts have no words and no labels; rows are handled one by one,
so ids may be null or repeated; other columns of the input take no part.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.tables import documents

#: Fixed by the contract: phrases and their labels, and what lies between words (after lower-casing A-Z).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices and conditions of licences in common use, with phrases that each must contain.
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            ("permission is hereby granted free of charge",)),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               ("apache license",)),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
            ("gnu general public license",)),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
             ("gnu lesser general public license",)),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer.",
            ("redistribution and use in source and binary forms",)),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            ("mozilla public license",)),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.",
            ("permission to use copy modify",)),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software",
                  ("free and unencumbered software released into the public domain",)),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
              "license, visit http://creativecommons.org/licenses/by/4.0/",
              ("creative commons attribution",)),
    "mit-terms": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                  "Software. The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited "
                  "to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors "
                  "or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
                  "otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
                  ("substantial portions of the software",)),
    "apache-2.0": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License.",
                   ("without warranties or conditions of any kind", "governing permissions and limitations under the license")),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
                ("gnu general public license", "version 2 of the license")),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                ("gnu general public license", "version 3 of the license")),
    "lgpl-2.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public "
                 "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
                 ("gnu library general public license", "version 2 of the license")),
    "lgpl-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
                 ("gnu lesser general public license", "version 2 1 of the license")),
    "lgpl-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 ("gnu lesser general public license", "version 3 of the license")),
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 ("gnu affero general public license", "version 3 of the license")),
    "bsd-terms": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the "
                  "copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the "
                  "implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright "
                  "holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
                  ("redistributions in binary form must reproduce the above copyright notice",)),
    "bsd-3": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission.",
              ("endorse or promote products derived from this software without specific prior written permission",)),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this "
                 "license, visit http://creativecommons.org/licenses/by-sa/4.0/",
                 ("creative commons attribution sharealike",)),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of "
                 "this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
                 ("creative commons attribution noncommercial",)),
    "cc0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
            "neighboring rights to this work.",
            ("waived all copyright and related or neighboring rights",)),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
             ("to alter it and redistribute it freely subject to the following restrictions",)),
    "boost": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
              "documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to "
              "prepare derivative works of the Software",
              ("any person or organization obtaining a copy of the software",)),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
            "available at https://www.eclipse.org/legal/epl-2.0/",
            ("eclipse public license",)),
}
#: Index entries for each template, and aligned hits that a candidate needs.
RARE_WORDS = 12
LEAST_HITS = 4
#: Relative positions are packed beside the template's number; a file may have up to 2^40 words.
SHIFT = 1 << 41


def template_words() -> dict[str, list[str]]:
    return {k: re.sub(NOT_WORD, " ", t.lower()).split() for k, (t, _) in TEMPLATES.items()}


def normal(text: F.Column) -> F.Column:
    """Lower-cased words joined by one space, with a space at each end ('' if there is no word).

    U+212A is the one character outside A-Z whose lower case is in a-z; it is set aside first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    body = F.trim(F.regexp_replace(plain, NOT_WORD, " "))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def spaces(s: F.Column) -> F.Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def of_template(codes: str, n: int) -> F.Column:
    return F.filter(codes, lambda c: F.shiftright(c, 41) == n)


def rare_words(words: DataFrame) -> tuple[dict[str, list[str]], dict[str, tuple[int, str]]]:
    """(the rarest words of each template among those that the documents have, however common; the order of all template
    words by IDF); counts are of template words only (a few hundred rows)."""
    per_template = template_words()
    vocabulary = sorted({w for ws in per_template.values() for w in ws})
    found = words.select(F.explode(F.array_intersect("__words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    df = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: (n, w) for w, n in df.items()}
    return {k: sorted((w for w in set(ws) if w in df), key=order.__getitem__)[:RARE_WORDS] for k, ws in per_template.items()}, order


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, found_labels (arrays), score."""
    base = documents(docs, id_col, text_col).select(F.col(f"`{id_col}`"), normal(F.col(f"`{text_col}`")).alias("__norm"))
    words = base.withColumn("__words", F.split(F.trim("__norm"), " "))
    rare, order = rare_words(words)
    labels = list(TEMPLATES)
    needed = {label: " ".join(TEMPLATES[label][1]).split() for label in labels}
    live = [label for label in labels if all(w in order for w in needed[label]) and len(rare[label]) >= LEAST_HITS]
    key = {label: min(needed[label], key=order.__getitem__) for label in live}
    postings: dict[str, list[int]] = {}
    for n, label in enumerate(labels):
        for at, w in enumerate(template_words()[label]):
            if label in key and w in rare[label]:
                postings.setdefault(w, []).append(n * SHIFT + SHIFT // 2 - at)
    entries = sorted({*postings, *key.values()}, key=order.__getitem__)
    postings = postings or {"": [0]}
    index = F.create_map(*[x for w, p in postings.items() for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in p]))])

    # the file's entries, highest IDF first, and whether some template has LEAST_HITS of them
    words = words.withColumn("__rare", F.array_intersect(F.array(*map(F.lit, entries or [""])), "__words"))
    sets = dict.fromkeys((key[label], tuple(rare[label])) for label in live)
    some = reduce(lambda a, b: a | b, [F.array_contains("__rare", w) & (F.size(F.array_intersect("__rare", F.array(*map(F.lit, ws)))) >= LEAST_HITS) for w, ws in sets], F.lit(False))
    # aligned hits: the same code (template, place in file - place in template) at least LEAST_HITS times
    ready = (F.size("__rare") >= LEAST_HITS) & some
    words = words.withColumn("__posts", F.when(ready, F.transform("__rare", lambda w: F.element_at(index, w))))   # one look-up for each word of the file
    hits = F.transform("__words", lambda w, i: F.transform(F.get("__posts", F.array_position("__rare", w).cast("int") - 1), lambda p: p + i))
    hits = F.sort_array(F.flatten(F.filter(hits, lambda a: a.isNotNull())))
    words = words.withColumn("__codes", F.when(F.col("__posts").isNotNull(), hits).otherwise(F.array().cast("array<bigint>")))
    best = F.filter("__codes", lambda c, i: (i >= LEAST_HITS - 1) & (c == F.get("__codes", i - (LEAST_HITS - 1))))
    words = words.withColumn("__aligned", F.array_distinct(best))
    words = words.withColumn("__hit", F.when(F.size("__aligned") > 0, F.filter("__codes", lambda c: F.array_contains("__aligned", c))).otherwise(F.col("__aligned")))
    shares, accepted = [], []
    for label in live:
        n = labels.index(label)
        phrases = reduce(lambda a, b: a & b, [F.contains("__norm", F.lit(f" {p} ")) for p in TEMPLATES[label][1]])
        ok = F.exists("__aligned", lambda c: F.shiftright(c, 41) == n) & phrases
        accepted.append(F.when(ok, F.lit(label)))
        size = sum(w in rare[label] for w in template_words()[label])
        hit = F.size(of_template("__hit", n))
        shares.append(F.when(ok, F.least(F.lit(1.0), hit / F.lit(float(max(size, 1))))).otherwise(F.lit(0.0)))
    # most files have no aligned hits at all
    met = F.size("__aligned") > 0
    found = F.when(met, F.array_sort(F.array_compact(F.array(*accepted, F.lit(None).cast("string"))))).otherwise(F.array().cast("array<string>"))
    score = F.when(met, F.greatest(*shares, F.lit(0.0), F.lit(0.0))).otherwise(F.lit(0.0))

    here = {p: F.contains("__norm", F.lit(f" {p} ")) for p in PHRASES}
    doubled = F.replace("__norm", F.lit(" "), F.lit("  "))  # so that places one after the other share no space

    def places(p: str) -> F.Column:
        found = " " + p.replace(" ", "  ") + " "
        gone = F.length(doubled) - F.length(F.replace(doubled, F.lit(found), F.lit("")))
        return F.when(here[p], (gone / F.lit(len(found))).cast("long")).otherwise(F.lit(0).cast("long"))

    n_words = spaces(F.col("__norm")) - F.when(F.col("__norm") != "", 1).otherwise(0)
    first = [F.when(here[p], spaces(F.substring_index("__norm", f" {p} ", 1))) for p in PHRASES]
    last = [F.when(here[p], n_words - (spaces(F.substring_index("__norm", f" {p} ", -1))) - len(p.split())) for p in PHRASES]
    return words.select(
        F.col(f"`{id_col}`"), n_words.cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, map(places, PHRASES)).alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(here[p], F.lit(v)) for p, v in PHRASES.items()])))).alias("base_labels"),
        found.alias("found_labels"), score.alias("score"))


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(
        F.col(f"`{id_col}`"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "found_labels")), ",").alias("labels"), "score")
