"""Operator 5: licence scan by a positional index of rare words.

Each template's rarest words (highest IDF among the templates) are indexed with their
positions.  The index words of a text look up their postings; a posting and the word's
place give the place where the template would start.  Places of a template within ``SLACK``
words of each other are one start, so a few words put in or left out (a name, a year, a
list mark) do no harm.  A start with enough distinct rare words is a candidate, and it is
reported when the key phrase stands where that start puts it, give or take ``SLACK`` words, and
no phrase that the template excludes begins there too (attribution is not share-alike).

The base labels are four plain phrases at consecutive words.

Only built-in functions, in one narrow map: postings are looked up inside the row, so there
is no shuffle, no Python on the executors, and no group that could grow.  The index is a
fixed table of ``TEMPLATES``.  Texts without any first word of a phrase and any index word
skip the word positions.

Cases: null text counts as empty (0 words, no labels, score 0); texts are read whole;
overlapping places all count; repeated rows get equal results; an empty table gives an empty
result; other columns, whatever their names, are kept by ``with_licenses``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, free_name, own_columns, table

#: The base phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    text: str
    key: str
    excluded: tuple[str, ...] = ()  # phrases that make it another licence


#: The notices of well-known licences as they are printed (names and years left out), the phrase
#: that each must contain, and phrases that make it another licence.
TEMPLATES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind",
        "permission is hereby granted free of charge",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
        "permission to use copy modify",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "except in compliance with the license",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "source and binary forms with or without modification",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "under the terms of the gnu general public license",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version",
        "under the terms of the gnu lesser general public license",
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
        "under the terms of the gnu affero general public license",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http "
        "mozilla org mpl 2 0",
        "mozilla public license",
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "eclipse public license",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions the origin of this software must not be misrepresented",
        "the origin of this software must not be misrepresented",
    ),
    Template(
        "boost",
        "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
        "boost software license",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is "
        "distributed without any warranty you should have received a copy of the cc0 public domain dedication along with this software",
        "public domain dedication",
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
        "creative commons attribution",
        ("creative commons attribution sharealike", "creative commons attribution share alike", "creative commons attribution noncommercial", "creative commons attribution non commercial", "creative commons attribution noderiv"),
    ),
    Template(
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
        "creative commons attribution sharealike",
    ),
    Template(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0",
        "creative commons attribution noncommercial",
    ),
    Template(
        "artistic",
        "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0 for details see the full text of the license in the file license",
        "the artistic license",
    ),
    Template(
        "wtfpl",
        "this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it and or modify it under the terms of the do what "
        "the fuck you want to public license version 2 as published by sam hocevar",
        "want to public license",
    ),
)
RARE, SHARE, SLACK = 8, 0.6, 6


def rare_index(templates: tuple[Template, ...] = TEMPLATES, most: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) of the ``most`` rarest words of each template; of equals longer ones, then earlier ones."""
    words = [t.text.split() for t in templates]
    held = {w: sum(w in ws for ws in words) for ws in words for w in ws}
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, ws in enumerate(words):
        once = [w for w in dict.fromkeys(ws) if ws.count(w) == 1]
        for w in sorted(once, key=lambda w: (-math.log(len(words) / held[w]), len(w) < 5, ws.index(w)))[:most]:
            postings.setdefault(w, []).append((k, ws.index(w)))
    return postings


INDEX = rare_index()
_NEEDED = [sum(k == t for ps in INDEX.values() for t, _ in ps) for k in range(len(TEMPLATES))]


def guard_words() -> set[str]:
    """A text without these has no place to report.

    A template needs a share of its rare words, so it also needs one of any ``n - needed + 1``
    of them: those that few templates have, longest first, are asked for.
    """
    words = {p.split()[0] for p in PHRASES}
    for k, n in enumerate(_NEEDED):
        own = sorted((w for w, ps in INDEX.items() if k in dict(ps)), key=lambda w: (-len(w), w))
        words.update(own[: n - math.ceil(SHARE * n) + 1])
    return words


_EDGE = r"[0-9A-Za-z\x80-\x{10FFFF}]"
_GUARD = rf"(?i)(?<!{_EDGE})(?:{'|'.join(sorted(guard_words()))})(?!{_EDGE})"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _follows(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands at word ``at``."""
    return F.slice(words, at + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))


def base_places(words: Column) -> Column:
    """(label, start) of each place of a base phrase, by start."""

    def look(w, i):
        found = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in PHRASES.items():
            ws = phrase.split()
            here = (w == ws[0]) & (F.get(words, i + 1) == ws[1])
            found = F.when(here & _follows(words, i, ws), F.struct(i.cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    return F.filter(F.transform(words, look), lambda p: p.isNotNull())


def template_hits(words: Column) -> Column:
    """(label, start, share) of each template whose rare words line up and whose key phrase stands there."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i"))), lambda x: x["w"].isin(*INDEX))
    postings = F.create_map(
        *[x for w, ps in INDEX.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in ps]))]
    )
    starts = F.flatten(
        F.transform(
            hits,
            lambda x: F.transform(F.try_element_at(postings, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("at"), p["at"].alias("word"))),
        )
    )
    needed = F.array(*[F.lit(math.ceil(SHARE * n)) for n in _NEEDED])
    kind = "struct<t:int,at:int,last:int,words:array<int>>"

    def close(state):
        run = state["run"]
        enough = run.isNotNull() & (F.size(F.array_distinct(run["words"])) >= F.get(needed, run["t"]))
        return F.when(enough, F.concat(state["out"], F.array(run))).otherwise(state["out"])

    def step(state, p):
        """A start goes on while the next place is near: a run has a few words a template, more only where a word repeats."""
        run = state["run"]
        same = run.isNotNull() & (run["t"] == p["t"]) & (p["at"] - run["last"] <= SLACK)
        grown = F.struct(
            p["t"].alias("t"), F.when(same, run["at"]).otherwise(p["at"]).alias("at"), p["at"].alias("last"),
            F.when(same, F.array_union(run["words"], F.array(p["word"]))).otherwise(F.array(p["word"])).alias("words"),
        )
        return F.struct(grown.alias("run"), F.when(same, state["out"]).otherwise(close(state)).alias("out"))

    zero = F.struct(F.lit(None).cast(kind).alias("run"), F.array().cast(f"array<{kind}>").alias("out"))
    lined_up = F.aggregate(F.array_sort(starts), zero, step, close)

    def stands(low, high, phrase: str):
        """The first place of the phrase between two words, or null."""
        ws = phrase.split()
        least = F.greatest(low, F.lit(0))
        places = F.when(high >= least, F.sequence(least, high)).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(places, lambda at: _follows(words, at, ws)), F.lit(0))

    def confirmed(c):
        ok = F.lit(False)
        for k, t in enumerate(TEMPLATES):
            ws, key = t.text.split(), t.key.split()
            offset = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
            low, high = c["at"] + offset - SLACK, c["last"] + offset + SLACK
            own = stands(low, high, t.key).isNotNull()
            for phrase in t.excluded:
                own = own & stands(low, high, phrase).isNull()
            ok = F.when(c["t"] == k, own).otherwise(ok)
        return ok

    labels = F.array(*[F.lit(t.label) for t in TEMPLATES])
    totals = F.array(*[F.lit(float(n)) for n in _NEEDED])
    return F.transform(
        F.filter(lined_up, confirmed),
        lambda c: F.struct(F.get(labels, c["t"]).alias("label"), c["at"].alias("start"), (F.size(c["words"]) / F.get(totals, c["t"])).alias("share")),
    )


def with_licenses(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` and a struct ``into`` of words (number), places (base phrases) and templates."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = F.regexp_count(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    words = F.when(body.rlike(_GUARD), words_of(body)).otherwise(F.array().cast("array<string>"))
    listed = free_name(docs, into + "_words")
    looked = docs.withColumn(listed, words)
    made = F.struct(count.alias("words"), base_places(F.col(listed)).alias("places"), template_hits(F.col(listed)).alias("templates"))
    return looked.select(*own_columns(docs), made.alias(into))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("licenses.places", lambda p: p["start"].cast("long"))
    base = F.transform("licenses.places", lambda p: p["label"])
    more = F.transform("licenses.templates", lambda t: t["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("licenses.places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("licenses.templates", lambda t: t["share"])), F.lit(0.0)))
    return found.select(
        "doc_id",
        F.col("licenses.words").alias("n_words"),
        F.size("licenses.places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        score.cast("double").alias("score"),
    )
