"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A segment is a run of whole lines. Text and templates are reduced to words of letters and digits in
lower case; Dice is twice the common bigrams over the sum of both sets.

* A segment's size, its words less one, has to lie in ``[t / (2 - t), (2 - t) / t]`` of the template's number of
  bigrams, the bounds outside which Dice cannot reach ``t``. (A segment that says the same words over and over may
  pass the upper bound although its set is small; it is no copy of the template and is left out.)
* Dice >= t asks for at least the lower share of the template's bigrams in common. A document that does not
  hold that many anywhere is left out for the template, exactly, by one set intersection per document.

The templates are a short list in the code; nothing about the documents is broadcast or shuffled but
findings. DataFrame functions only.

Defined results: null and empty texts hold no licence; lines without words are passed over; segments of one
word have no bigram. A first line goes to the template it is most like; per document and licence the best
segment is returned (ties: the earlier, then the shorter). Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import bind, plain_words

SIMILARITY = 0.8

# Notices by which works name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)


def bigrams(words: Column) -> Column:
    """Different word bigrams as 64-bit hashes."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b)))

    return bind(words, pairs)


def template_table(spark: SparkSession, similarity: float = SIMILARITY) -> list[dict]:
    """Number, licence, bigrams, least common bigrams and size bounds of every template."""
    given = [F.struct(F.lit(i).alias("t"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(TEMPLATES)]
    rows = spark.range(1).select(F.inline(F.array(*given))).select("t", "license", bigrams(plain_words(F.col("text"))).alias("big"))
    share = similarity / (2 - similarity)
    size = F.size("big")
    bounded = rows.select(
        "t", "license", "big", F.ceil(size * share - 1e-9).cast("int").alias("low"), F.floor(size / share + 1e-9).cast("int").alias("high")
    )
    return [r.asDict() for r in bounded.collect()]


def scan(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(r, doc, license, first_line, last_line, dice)`` of the licences found in each document."""
    known = template_table(docs.sparkSession, similarity)
    longs = lambda values: F.array(*[F.lit(v) for v in values])
    table = F.array(
        *[
            F.struct(F.lit(k["t"]).alias("t"), F.lit(k["license"]).alias("license"), F.lit(k["low"]).alias("low"), F.lit(k["high"]).alias("high"), longs(k["big"]).alias("big"))
            for k in known
        ]
    )
    every = longs(sorted({v for k in known for v in k["big"]}))
    least = min(k["low"] for k in known)
    body = F.coalesce(F.col(text), F.lit(""))

    def fitting(held: Column) -> Column:
        enough = F.filter(table, lambda k: F.size(F.array_intersect(held, k["big"])) >= k["low"])
        return F.when(F.size(held) >= least, enough)

    # In one projection with the row number, which no filter is pushed below: the text is read once.
    rows = docs.select(
        F.monotonically_increasing_id().alias("r"),
        F.col(doc_id).alias("doc"),
        body.alias("text"),
        bind(F.array_intersect(bigrams(plain_words(body)), every), fitting).alias("fits"),
    )
    found = rows.where(F.size("fits") > 0)

    # Lines with words, their numbers, and how many words lie before each.
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), plain_words(x).alias("words"))),
        lambda x: F.size(x["words"]) > 0,
    )
    cut = found.select("r", "doc", "fits", lines.alias("lines")).select(
        "r", "doc", "lines", F.explode("fits").alias("k")
    )

    def runs(i: Column) -> Column:
        """Segments that begin at line ``i`` and keep the template's size bounds."""
        grown = F.aggregate(
            F.sequence(i, F.least(F.size("lines") - 1, i + F.col("k.high"))),
            F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<j:int,n:int>>").alias("out")),
            lambda acc, j: F.struct(
                (acc["n"] + F.size(F.get("lines", j)["words"])).alias("n"),
                bind(
                    acc["n"] + F.size(F.get("lines", j)["words"]),
                    lambda n: F.when(n <= F.col("k.high") + 1, F.concat(acc["out"], F.array(F.struct(j.alias("j"), n.alias("n"))))).otherwise(acc["out"]),
                ).alias("out"),
            ),
        )
        return F.transform(
            F.filter(grown["out"], lambda s: s["n"] > F.col("k.low")),
            lambda s: F.struct(
                F.get("lines", i)["no"].alias("first_line"),
                F.get("lines", s["j"])["no"].alias("last_line"),
                F.flatten(F.transform(F.slice("lines", i + 1, s["j"] - i + 1), lambda x: x["words"])).alias("words"),
            ),
        )

    segments = cut.select("r", "doc", "k", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), runs))).alias("s"))
    sized = segments.select("r", "doc", "k", "s.first_line", "s.last_line", bigrams(F.col("s.words")).alias("big"))
    dice = 2.0 * F.size(F.array_intersect("big", F.col("k.big"))) / (F.size("big") + F.size("k.big"))
    scored = sized.select("r", "doc", "first_line", "last_line", F.col("k.license").alias("license"), F.col("k.t").alias("t"), dice.alias("dice"))
    good = scored.where(F.col("dice") >= similarity)
    by_line = good.groupBy("r", "doc", "first_line").agg(
        F.max(F.struct("dice", -F.col("last_line"), -F.col("t"), "license", "last_line")).alias("b")
    )
    return by_line.groupBy("r", "doc", F.col("b.license").alias("license")).agg(
        F.max(F.struct(F.col("b.dice").alias("dice"), -F.col("first_line"), "first_line", F.col("b.last_line").alias("last_line"))).alias("b")
    ).select("r", "doc", "license", "b.first_line", "b.last_line", "b.dice")
