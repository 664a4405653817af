"""License scans with DataFrame functions only: a positional rare-token index over licence templates.

A template is a label, the words of a licence notice and a mandatory key phrase among them. The document frequency of every word of a
key phrase is counted over the whole corpus, and each template is posted under its ``ANCHORS`` words of highest IDF, with the place
of each relative to the phrase's first word. A file's words are looked up in that index; each hit of an anchor gives the place where
the phrase would begin. The places that all anchors of a template agree on are intersected, and a place holds if the words of
the key phrase stand there one after another. What share of the whole notice stands around it is the match's coverage. The index has
some hundred entries, whatever the corpus, and travels as literals; texts are read twice (statistics, scan) and never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    key: str
    text: str
    base: bool = False

    @property
    def at(self) -> int:
        """Place of the key phrase among the template's words."""
        words, key = self.text.split(), self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# fixed values: the phrases and labels that the contract names, then the notices of well-known licences
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied"),
    Template("apache-2", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Template("lgpl", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty"),
    Template("lgpl", "gnu library general public license", "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("agpl", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software"),
    Template("zlib", "altered source versions must be plainly marked as such", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    Template("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    Template("cc-by", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
    Template("bsl-1", "boost software license", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"),
    Template("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"),
    Template("cddl", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    Template("artistic-2", "the artistic license 2 0", "this library is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    Template("ofl-1.1", "sil open font license", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at http scripts sil org ofl"),
    Template("eupl", "european union public licence", "licensed under the eupl version 1 2 the european union public licence you may not use this work except in compliance with the licence"),
    Template("psf-2", "python software foundation license version 2", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python software foundation license version 2"),
    Template("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Documents, and documents with each word of ``vocabulary``, over all rows."""
    held = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), _literal(vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = {r["w"]: r["n"] for r in held.collect()}
    return docs.count(), {v: found.get(v, 0) for v in vocabulary}


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text", anchors: int = ANCHORS) -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: array of (template, label, base, word, coverage), one for each place of a key phrase.

    ``word`` is where the phrase starts among the text's words, ``coverage`` the share of the template's words that stand at
    their relative places. Null and empty texts have 0 words and no places. Texts are read whole, however long; every row gives
    one, repeated rows and null ids too. Other columns are kept; ``n_words`` and ``places`` are replaced where ``docs`` has them.
    """
    docs = docs.drop("n_words", "places")
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    total, df = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in df.items()}
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for k, t in enumerate(templates):
        key = t.key.split()
        # the rarest words of the phrase, by their first place in it; of words alike, the earlier
        rare = sorted({w: key.index(w) for w in reversed(key)}.items(), key=lambda x: (-idf[x[0]], x[1]))[: max(1, anchors)]
        for turn in range(max(1, anchors)):
            # a phrase of fewer words has its last anchor stand for the missing ones
            w, i = rare[min(turn, len(rare) - 1)]
            postings.setdefault(w, []).append((k, i, turn))
    entry = lambda x: F.struct(F.lit(x[0]).alias("t"), F.lit(x[1]).alias("i"), F.lit(x[2]).alias("turn"))
    index = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*map(entry, at)))])
    keys = F.array(*[_literal(t.key.split()) for t in templates])
    texts = F.array(*[_literal(t.text.split()) for t in templates])
    offsets = F.array(*[F.lit(t.at) for t in templates])
    labels, base = _literal([t.label for t in templates]), F.array(*[F.lit(t.base) for t in templates])
    rare_words = list(postings)

    w = F.col("_w")
    hits = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(rare_words), F.struct(i.alias("p"), x.alias("w")))))
    # (template, start) as one number, and the anchor that says so
    wide = 1 << 40
    said = F.flatten(F.transform(F.col("_hits"), lambda h: F.transform(F.filter(F.element_at(index, h["w"]), lambda a: h["p"] >= a["i"]), lambda a: F.struct(a["turn"].alias("turn"), (a["t"].cast("long") * wide + (h["p"] - a["i"])).alias("at")))))
    by_anchor = lambda turn: F.transform(F.filter(F.col("_said"), lambda x: x["turn"] == turn), lambda x: x["at"])
    agreed = by_anchor(0)
    for turn in range(1, max(1, anchors)):
        agreed = F.array_intersect(agreed, by_anchor(turn))
    starts = F.transform(agreed, lambda x: F.struct(F.floor(x / wide).cast("int").alias("t"), F.pmod(x, F.lit(wide)).cast("int").alias("s")))
    holds = lambda c: F.slice(w, c["s"] + 1, F.size(keys[c["t"]])) == keys[c["t"]]

    def coverage(c: Column) -> Column:
        text, begin = texts[c["t"]], c["s"] - offsets[c["t"]]
        same = F.filter(F.sequence(F.lit(0), F.size(text) - 1), lambda j: F.when((begin + j >= 0) & (begin + j < F.size(w)), F.get(w, begin + j) == F.get(text, j)).otherwise(False))
        return F.size(same) / F.size(text)

    found = F.transform(F.filter(F.col("_starts"), holds), lambda c: F.struct(c["t"].alias("template"), labels[c["t"]].alias("label"), base[c["t"]].alias("base"), c["s"].cast("long").alias("word"), coverage(c).alias("coverage")))
    out = docs.withColumn("_w", words(F.col(text_col))).withColumn("_hits", hits).withColumn("_said", said).withColumn("_starts", starts)
    return out.select(*docs.columns, F.size("_w").cast("long").alias("n_words"), found.alias("places"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows."""
    base = F.filter("places", lambda p: p["base"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    at = F.transform(base, lambda p: p["word"])
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), score.alias("score"))


def oracle() -> str:
    """The same in DuckDB's SQL, by looking at every place of every text."""
    quoted = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    rows = ", ".join(f"('{t.label}', {quoted(t.key)}, {quoted(t.text)}, {t.at}, {str(t.base).lower()})" for t in TEMPLATES)
    return rf"""
with t(label, key, body, shift, base) as (values {rows}),
d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
hit as (
  select r, label, base, w, body, shift, unnest(list_filter(range(0, len(w) - len(key) + 1), lambda i: w[i + 1 : i + len(key)] = key)) as word from d, t),
place as (
  select r, label, base, word, cast(len(list_filter(range(1, len(body) + 1), lambda j: word - shift + j >= 1 and word - shift + j <= len(w) and w[cast(greatest(word - shift + j, 1) as bigint)] = body[j])) as double) / len(body) as coverage from hit),
agg as (
  select r, count(*) filter (where base) as n_base, min(word) filter (where base) as first_word, max(word) filter (where base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from place group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0e0) as score
from d left join agg using (r)
"""
