"""License scans by voting along diagonals.

Built from DataFrame functions alone. Every run of `GRAM` words of a text is joined by its hash to
the places of known notices (a fixed list, so that side is broadcast), and equal words confirm each
hit. A hit at text place p and notice place q lies on the diagonal p - q; an undisturbed copy of a
notice puts all its hits on one diagonal, and each inserted or lost word shifts the rest to a
neighbouring one. The notice's places that are hit are gathered per diagonal as bits, neighbouring
diagonals are merged, and a merged span counts when it covers enough of the notice's places without
being much longer than it; a place hit again and again is one place. A diagonal that covers enough
counts alone as well, so copies of a short notice one after the other are all seen.

Short phrases are notices of their own that must match in full; their places are the base result.

Defined results: a null or empty text has no words, no labels and score 0; a very long one is
searched whole. Labels are sorted, so ties among notices do not matter. Rows with equal key and
text are searched once and all get the result; a null key is a key like any other. Extra columns
are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.text import alnum_words

GRAM = 3
MAX_SHIFT = 4  # diagonals at most so far apart are merged
MIN_COVER = 0.6
MAX_STRETCH = 1.5
BITS = 60  # places of a notice in one number

# The phrases of the base result.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Wordings of common license notices (public texts).
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved."),
)


def _grams(words: Column, place: Column) -> list[Column]:
    return [F.get(words, place + j) for j in range(GRAM)]


def notice_grams(spark: SparkSession) -> DataFrame:
    """One row per word run of a notice: which notice, its label, place, size and words.

    A phrase of two words is one run whose third word is null. The list is fixed, a few hundred rows.
    """
    listed = [(label, text, True) for text, label in PHRASES] + [(label, text, False) for label, text in NOTICES]
    rows = [
        F.struct(F.lit(i).alias("notice"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(phrase).alias("phrase"))
        for i, (label, text, phrase) in enumerate(listed)
    ]
    notices = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", alnum_words(F.col("text")))
    runs = F.greatest(F.size("words") - (GRAM - 1), F.lit(1))
    cut = notices.withColumn("runs", runs).withColumn("q", F.explode(F.sequence(F.lit(0), runs - 1)))
    q1, q2, q3 = _grams(F.col("words"), F.col("q"))
    return cut.select(
        "notice", "label", "phrase", "runs", "q", F.size("words").alias("size"), F.xxhash64(q1, q2).alias("pair"),
        q1.alias("q1"), q2.alias("q2"), q3.alias("q3"),
    )


def hits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Places where a word run of a text equals one of a notice: id, version, notice..., q, p."""
    worded = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), alnum_words(F.col(f"`{text}`")).alias("words")
    ).where(F.size("words") >= 2)
    places = worded.select("id", "version", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("p"))
    p1, p2, p3 = _grams(F.col("words"), F.col("p"))
    runs = places.select("id", "version", "p", p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), F.xxhash64(p1, p2).alias("pair"))
    equal = (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")) & (F.col("q3").isNull() | (F.col("p3") == F.col("q3")))
    known = F.broadcast(notice_grams(docs.sparkSession).withColumnRenamed("pair", "known"))
    found = runs.join(known, (F.col("pair") == F.col("known")) & equal)
    return found.select("id", "version", "notice", "label", "phrase", "runs", "size", "q", "p").distinct()


def _masks() -> list[str]:
    """Columns that hold a bit for every place of the longest notice."""
    longest = max(len(text.split()) for _, text in (*NOTICES, *((label, text) for text, label in PHRASES)))
    return [f"places_{i}" for i in range(2 * longest // BITS + 1)]  # a word may be cut into several


def spans(found: DataFrame) -> DataFrame:
    """Merged diagonals, and single ones of enough cover: one row per span of a notice in a text, with its cover, first and last word."""
    masks = _masks()
    bits = [F.bit_or(F.when(F.floor(F.col("q") / BITS) == i, F.expr(f"shiftleft(1L, q % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(masks)]
    covered = sum((F.bit_count(m) for m in masks), F.lit(0))
    diagonals = (
        found.withColumn("diagonal", F.col("p") - F.col("q"))
        .groupBy("id", "version", "notice", "label", "phrase", "runs", "size", "diagonal")
        .agg(*bits, F.min("p").alias("first"), F.max("p").alias("last"))
        .withColumn("n", covered)
    )
    along = Window.partitionBy("id", "version", "notice").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along)) > F.when(F.col("phrase"), 0).otherwise(MAX_SHIFT), F.lit(True))
    numbered = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    # a diagonal that covers enough by itself is a copy of its own too, whatever stands next to it
    alone = ~F.col("phrase") & (F.col("n") >= MIN_COVER * F.col("runs"))
    chain, single = F.struct(F.lit(False).alias("single"), F.col("span").alias("at")), F.struct(F.lit(True).alias("single"), F.col("diagonal").cast("long").alias("at"))
    numbered = numbered.withColumn("span", F.explode(F.when(alone, F.array(chain, single)).otherwise(F.array(chain))))
    merged = numbered.groupBy("id", "version", "notice", "label", "phrase", "runs", "size", "span").agg(
        *[F.bit_or(m).alias(m) for m in masks], F.min("first").alias("first"), (F.max("last") + F.least(F.lit(GRAM), F.first("size")) - 1).alias("last")
    )
    return merged.withColumn("cover", covered / F.col("runs"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the base phrases; first_word and last_word are their smallest and
    largest start. score is the largest cover of a notice, 1 where a base phrase stands.
    """
    whole = F.when(F.col("phrase"), F.col("cover") >= 1).otherwise(
        (F.col("cover") >= MIN_COVER) & (F.col("last") - F.col("first") + 1 <= MAX_STRETCH * F.col("size"))
    )
    per_doc = (
        spans(hits(docs, key, text))
        .withColumn("whole", whole)
        .groupBy("id", "version")
        .agg(
            F.count(F.when(F.col("phrase") & F.col("whole"), 1)).alias("n_base"),
            F.min(F.when(F.col("phrase") & F.col("whole"), F.col("first"))).alias("first_word"),
            F.max(F.when(F.col("phrase") & F.col("whole"), F.col("first"))).alias("last_word"),
            F.collect_set(F.when(F.col("phrase") & F.col("whole"), F.col("label"))).alias("base_labels"),
            F.collect_set(F.when(F.col("whole"), F.col("label"))).alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    counted = docs.select(
        F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("_version"),
        F.size(alnum_words(F.col(f"`{text}`"))).cast("long").alias("n_words"),
    )
    joined = counted.join(per_doc, F.col(key).eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version")), "left")
    listed = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return joined.select(
        F.col(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        listed("base_labels").alias("base_labels"), listed("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
