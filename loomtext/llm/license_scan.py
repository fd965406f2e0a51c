"""License scans by diagonal voting, in DataFrame operations only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

1. Base labels: every place where the words of a fixed phrase stand in a row.
2. Every rolling 3-word gram of every document is hashed and joined to the
   grams of the license templates (a fixed table of a few hundred rows, so it
   is broadcast).  Each match votes for a diagonal: its place in the document
   minus its place in the template.
3. Votes are summed by document, template and diagonal; diagonals at most
   ``NEAR`` apart are one span, so a few words put in or left out do no harm.
4. A span is verified by a second look at its matched grams in the order of the
   document: only those that come later in the template than all before them
   count, so moved or repeated pieces don't.  It counts if those cover enough of
   the template's words and it is not much longer than the template.  Gram
   hashes have 64 bits, so a matched gram means three equal words.

A row is a document of its own, known by hashes of its id and text, so rows that
repeat an id, or have none, don't share votes; rows that are equal in both have
equal spans.

Edge cases: null or empty text has no words, no labels (empty strings) and
score 0; null and repeated ids are labelled as all others; several templates of
one label give it once, the best cover is the score; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM, NEAR, LEAST_COVER, LONGEST = 3, 2, 0.7, 1.5

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Words of public license texts and notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams_of(words: Column) -> Column:
    """Hashes of all rolling grams, in order of their places."""
    places = F.sequence(F.lit(0), F.size(words) - F.lit(GRAM))
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(GRAM)]))
    return F.when(F.size(words) >= GRAM, hashed)


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, place, length): one row for each place of each template."""
    rows = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    table = spark.sql(f"SELECT template, label, split(text, ' ') AS w FROM VALUES {rows} AS t(template, label, text)")
    return table.select("template", "label", F.size("w").alias("length"), F.posexplode(grams_of(F.col("w"))).alias("place", "gram"))


def _places(words: Column, phrase: str) -> Column:
    """Start places of a phrase; only texts that hold its last word are searched."""
    parts = phrase.split()
    here = lambda i: [F.get(words, i + F.lit(k)) == F.lit(w) for k, w in enumerate(parts)]

    def stands(i: Column) -> Column:
        first, *rest = here(i)
        for more in rest:
            first = first & more
        return F.coalesce(first, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(1)), stands)


def in_order(votes: Column) -> Column:
    """How many template words the votes (at, place), sorted, cover when only rising places count."""
    start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, v: Column) -> Column:
        further = v["place"] > acc["last"]
        return F.struct(F.when(further, v["place"]).otherwise(acc["last"]).alias("last"), F.when(further, acc["n"] + F.least(v["place"] - acc["last"], F.lit(GRAM))).otherwise(acc["n"]).alias("n"))

    return F.aggregate(votes, start, step)["n"]


def row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart: 96 bits of hashes and the length."""
    return F.struct(F.xxhash64(id_, text).alias("a"), F.hash(text).alias("b"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, template, label, first_place, last_place, cover) of every verified span; key tells rows of one id apart."""
    id_, text = F.col(id_col), F.col(text_col)
    words = docs.select(id_.alias("id"), row_key(id_, text).alias("key"), words_of(text).alias("words"))
    grams = words.select("id", "key", grams_of(F.col("words")).alias("grams"))  # a column of its own, else each lambda splits the text anew
    # the outer form: for the other one the planner would add a filter on the grams' size and push it below the split
    places = grams.select("id", "key", F.posexplode_outer("grams").alias("at", "gram"))
    votes = places.join(F.broadcast(template_grams(docs.sparkSession)), "gram")
    span = ["id", "key", "template", "label", "length"]
    # sets: equal rows give equal votes
    diagonals = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*span, "diagonal")
    diagonals = diagonals.agg(F.collect_set(F.struct("at", "place")).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("int")
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    merged = merged.groupBy(*span, "span").agg(F.array_sort(F.flatten(F.collect_list("votes"))).alias("votes"), F.min("lo").alias("first_place"), (F.max("hi") + GRAM - 1).alias("last_place"))
    merged = merged.select("*", F.explode_outer(F.array(in_order(F.col("votes")))).alias("covered")).withColumn("cover", F.col("covered") / F.col("length"))
    return merged.filter((F.col("cover") >= LEAST_COVER) & (F.col("last_place") - F.col("first_place") + 1 <= LONGEST * F.col("length"))).select("id", "key", "template", "label", "first_place", "last_place", "cover")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.col(text_col)
    words = words_of(text)
    base = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), text.alias("text"), words.alias("words"))
    asked = F.contains(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit("license"))
    found = [F.when(asked & (F.size("words") > 0), _places(F.col("words"), phrase)).otherwise(F.array().cast("array<int>")) for phrase, _ in PHRASES]
    base = base.select("id", "key", F.size("words").cast("long").alias("n_words"), *[f.alias(f"at{k}") for k, f in enumerate(found)])
    names = [F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]
    places = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    base = base.select(
        "id",
        "key",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("own"),
    )
    by_template = spans(docs, id_col, text_col).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("score"))
    out = base.join(by_template, "key", "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
