"""License scans: sentences to identifiers of known license sentences, then ordered rules over identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of common license notices, normalised (lower case, single spaces, no punctuation).
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-licensed": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-you-may-not": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "apache2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at <x> mozilla org mpl 2 0",
    "epl2-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at <x>",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-public": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-notice": "distributed under the boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "cc-work-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-work-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-work-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of <x> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "all-rights-reserved": "all rights reserved",
}
# Families of the licenses that share a header, and their versions.
FAMILIES = (("GPL", "general public license", "program"), ("LGPL", "lesser general public license", "library"), ("AGPL", "affero general public license", "program"))
VERSIONS = ("2", "2 1", "3")
for _short, _name, _thing in FAMILIES:
    for _v in VERSIONS:
        for _which, _words in (("only", f"version {_v} of the license"), ("or-later", f"either version {_v} of the license or at your option any later version")):
            SENTENCES[f"{_short.lower()}-{_v.replace(' ', '-')}-{_which}"] = f"<x> is free software you can redistribute it and or modify it under the terms of the gnu {_name} as published by the free software foundation {_words}"
# License names of one-line tags.
TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"tag-{t}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", t.lower()) for t in TAGS}
# Rules, (rule, license, sentences that must follow one another, other license sentences in between allowed).
RULES = (
    ("apache2-short", "Apache-2.0", ("apache2-notice",)),
    ("apache2-header", "Apache-2.0", ("apache2-notice", "apache2-you-may-not", "apache2-obtain", "apache2-unless")),
    ("apache2-licensed", "Apache-2.0", ("apache2-licensed",)),
    ("apache2-full", "Apache-2.0", ("apache2-licensed", "apache2-obtain", "apache2-unless")),
    ("mit-short", "MIT", ("mit-notice",)),
    ("mit-full", "MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("gpl3-short", "GPL-3.0", ("gpl3-notice",)),
    *((f"{s.lower()}-{v.replace(' ', '-')}-{w}", f"{s}-{v.replace(' ', '.') if ' ' in v else v + '.0'}-{w}", (f"{s.lower()}-{v.replace(' ', '-')}-{w}",)) for s, _, _ in FAMILIES for v in VERSIONS for w in ("only", "or-later")),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-3-or-later", "gpl-hope")),
    ("mpl2-header", "MPL-2.0", ("mpl2-subject", "mpl2-obtain")),
    ("epl2-header", "EPL-2.0", ("epl2-available",)),
    ("isc-full", "ISC", ("isc-grant", "isc-warranty")),
    ("unlicense", "Unlicense", ("unlicense-public", "unlicense-free")),
    ("boost", "BSL-1.0", ("boost-notice",)),
    ("zlib", "Zlib", ("zlib-warranty", "zlib-grant")),
    ("cc-work-by", "CC-BY-4.0", ("cc-work-by",)),
    ("cc-work-by-sa", "CC-BY-SA-4.0", ("cc-work-by-sa",)),
    ("cc-work-by-nc", "CC-BY-NC-4.0", ("cc-work-by-nc",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("cc-by", "CC-BY-4.0", ("cc-by-notice",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("cc0", "CC0-1.0", ("cc0-notice",)),
    ("bsd2", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd3", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("all-rights-reserved", "Proprietary", ("all-rights-reserved",)),
    *((f"tag-{t}", t, (f"tag-{t}",)) for t in TAGS),
)
#: A sentence ends at a line end, or at a mark before white space; lines without a mark or a blank line between may be one sentence.
MARK_END = r"[.!?]+[\x20\x09-\x0D]+"
#: Words of which every known sentence has one, in any case; texts without them hold no license sentence.
TRIGGERS = ("license", "licensed", "permission", "software", "redistribution", "redistributions", "reserved", "endorse", "copyright", "program", "mpl")
TRIGGER = f"(?i)\\b(?:{'|'.join(TRIGGERS)})\\b"
#: <x> in a sentence stands for so many words at most, as do names and addresses.
MOST_SLOT = 12
#: Lines that a wrapped sentence can have: one per word.
MOST_LINES = max(len(s.split()) for s in SENTENCES.values()) + MOST_SLOT
_PLAIN = {i: s for i, s in SENTENCES.items() if "<x>" not in s}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def pattern(sentence: str) -> str:
    """Regular expression of a normalised sentence at the start of lines; words stand after single spaces or line ends, and a line ends after the last."""
    space = "[ \n]"
    return "^" + space.join(rf"[^ \n]+(?:{space}[^ \n]+){{0,{MOST_SLOT - 1}}}" if w == "<x>" else w for w in sentence.split()) + "\n"


def sentence_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, place, sentence id) of each known license sentence, wrapped or not; whole texts.

    place numbers a text's lines and what marks part in them. A sentence fills one such piece, or
    several pieces that follow one another without a mark or a blank line between. Pieces that
    are a known sentence are matched to the dictionary, a constant, in the same task; sentences
    of several lines and those with names in them are met by their patterns. Only texts, and
    pieces, with a word of TRIGGERS are cut.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(_PLAIN.items()), "sentence_id string, sentence string"))  # the constant table above
    hits = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).filter(F.col("t").rlike(TRIGGER)).select("id", F.split("t", MARK_END).alias("parts"))
    parts = hits.select("id", "parts", F.posexplode("parts").alias("i", "part")).filter(F.col("part").rlike(TRIGGER))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.size(F.split(x, "\n")))
    lines = parts.select("id", before.alias("before"), F.transform(F.split("part", "\n"), normalised).alias("lines"))
    each = lines.select("id", "before", "lines", F.posexplode("lines").alias("j", "sentence")).filter("sentence <> ''").withColumn("place", F.col("before") + F.col("j"))
    alone = each.join(known, "sentence").select("id", "place", "sentence_id")
    rest = F.concat(F.array_join(F.slice("lines", F.col("j") + 1, F.lit(MOST_LINES)), "\n"), F.lit("\n"))
    starts = each.select("id", "place", F.size("lines").alias("n"), rest.alias("rest"))
    met = lambda which: F.array_compact(F.array(*[F.when(F.col("rest").rlike(pattern(s)), F.lit(i)) for i, s in which.items()]))
    slots = {i: s for i, s in SENTENCES.items() if i not in _PLAIN}
    several = starts.select("id", "place", F.explode(F.when(F.col("n") > 1, met(_PLAIN)).otherwise(F.array().cast("array<string>"))).alias("sentence_id"))
    named = starts.select("id", "place", F.explode(met(slots)).alias("sentence_id"))
    return alone.unionByName(several).unionByName(named)


def sequence(ids: tuple[str, ...]) -> str:
    """Regular expression of sentence ids in order, each between commas."""
    return ".*".join(f",{re.escape(i)}," for i in ids)


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and rule that it meets: key, rule, license, n_sentences, first_place.

    A document's license sentences in text order form a sequence; a rule is met where its
    sentences occur in that sequence in its order. n_sentences counts the document's license
    sentences, each place once, first_place is the place of the rule's first sentence. Documents
    without a license, null and empty texts give no row, an empty table gives none. Rows with
    equal keys are one document, rows without a key too, and repeated rows count once. Very long
    texts are read whole; other columns are ignored, whatever their names.
    """
    at = sentence_ids(docs, key, text)
    docs_ids = at.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("place", "sentence_id"))).alias("found"))
    line = docs_ids.withColumn("line", F.concat(F.lit(","), F.array_join(F.transform("found", lambda x: x["sentence_id"]), ",,"), F.lit(",")))
    met = F.array_compact(F.array(*[
        F.when(F.col("line").rlike(sequence(seq)), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("license"), F.lit(seq[0]).alias("first")))
        for rule, name, seq in RULES
    ]))
    return line.select("id", "found", F.explode(met).alias("m")).select(
        F.col("id").alias(key), "m.rule", "m.license", F.size("found").cast("long").alias("n_sentences"),
        F.array_min(F.transform(F.filter("found", lambda x: x["sentence_id"] == F.col("m.first")), lambda x: x["place"])).cast("long").alias("first_place"),
    )
