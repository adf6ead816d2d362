"""License scan by a positional index of rare licence words; DataFrame functions only.

Each template's words with the highest inverse document frequency are looked up in every file.  Where one occurs, all
template words of the file are joined with the template postings, grouped by relative position, and weighed.  A label is
given where the aligned words carry enough weight and the template's mandatory phrase stands there in full.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, usual wording of the notice (63 words at most), mandatory phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files", "permission is hereby granted free of charge to any person"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted", "with or without fee is hereby granted"),
    ("gnu-gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gnu-gpl-2", "this program is free software under the gnu general public license version 2", "gnu general public license version 2"),
    ("gnu-lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("gnu-agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
RARE_WORDS = 3
LEAST_SHARE = 0.6


def _postings() -> list[tuple[int, str, int]]:
    return [(t, word, i) for t, (_, text, _) in enumerate(TEMPLATES) for i, word in enumerate(text.split())]


def _key_bits(t: int) -> int:
    text, phrase = TEMPLATES[t][1].split(), TEMPLATES[t][2].split()
    at = next(i for i in range(len(text)) if text[i:i + len(phrase)] == phrase)
    return sum(1 << (at + i) for i in range(len(phrase)))


def spaced_words(text: Column) -> Column:
    """Lower-case words, one space between and none around."""
    # The Kelvin sign is the one character beyond ASCII whose lower case is an ASCII letter.
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``documents`` has doc_id and text; other columns are ignored.  A null or empty text has no words, places or labels
    and scores 0.  ``score`` is 1 where a base phrase stands, else the largest share of a template's weight (summed
    inverse document frequencies) that is aligned at one place.  Repeated rows are scanned each; an empty table gives
    none.  No group holds more than one document's licence words.
    """
    spark = documents.sparkSession
    vocabulary = sorted({w for _, w, _ in _postings()})
    words = F.split("norm", " ")
    base = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), spaced_words(F.col("text")).alias("norm"))
    # First pass: document frequencies of the licence words over all documents.  The result has a row per licence word.
    present = F.array_intersect(words, F.lit(vocabulary))
    total = documents.count()
    found = dict(base.select(F.explode(present).alias("word")).groupBy("word").count().collect())
    idf = {w: round(math.log((total + 1) / (found.get(w, 0) + 1)) + 1, 9) for w in vocabulary}
    rare = [sorted(set(text.split()), key=lambda w: (-idf[w], w))[:RARE_WORDS] for _, text, _ in TEMPLATES]
    # Second pass: what a file holds, without its text.
    double = F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" "))
    n_words = F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1)
    stored = base.withColumn("double", double).withColumn("n_words", n_words.cast("long"))
    firsts, lasts, counts, names = [], [], [], []
    for phrase, label in BASE.items():
        own = " " + phrase.replace(" ", "  ") + " "
        hit = F.contains("double", F.lit(own))
        before = F.expr(f"substring(double, 1, locate('{own}', double) - 1)")
        after = F.expr(f"substring(reverse(double), 1, locate('{own[::-1]}', reverse(double)) - 1)")
        firsts.append(F.when(hit, _spaces(before) / 2))
        lasts.append(F.when(hit, F.col("n_words") - _spaces(after) / 2 - len(phrase.split())))
        counts.append(F.when(hit, (F.length("double") - F.length(F.replace("double", F.lit(own), F.lit("")))) / len(own)).otherwise(0))
        names.append(F.when(hit, F.lit(label)))
    rare_words = sorted({w for ws in rare for w in ws})
    places = F.when(F.arrays_overlap(words, F.lit(rare_words)), F.filter(
        F.transform(words, lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary)))
    stored = Workspace(spark, "licenses").store("files", stored.select(
        "doc_id", "key", "n_words", reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))).alias("base"), places.alias("places")))
    # A row per template word: bounded by the fixed templates.
    index = spark.createDataFrame(
        [(w, t, i, w in rare[t]) for t, w, i in _postings()], "word string, template int, place int, rare boolean")
    weights = F.lit([[idf[w] for w in text.split()] for _, text, _ in TEMPLATES])
    sums = F.lit([sum(idf[w] for w in text.split()) for _, text, _ in TEMPLATES])
    phrases = F.lit([_key_bits(t) for t in range(len(TEMPLATES))])
    names_of = F.lit([label for label, _, _ in TEMPLATES])
    aligned = (stored.where(F.size("places") > 0).select("key", F.explode("places").alias("p")).select("key", "p.at", "p.word")
               .join(F.broadcast(index), "word").groupBy("key", "template", (F.col("at") - F.col("place")).alias("offset"))
               .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"), F.max("rare").alias("rare")).where("rare"))
    own = F.element_at(weights, F.col("template") + 1)
    share = F.aggregate(F.transform(own, lambda w, i: F.when(F.getbit("bits", i) == 1, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.element_at(sums, F.col("template") + 1)
    phrase = F.element_at(phrases, F.col("template") + 1)
    placed = aligned.withColumn("share", share).withColumn("whole", F.col("bits").bitwiseAND(phrase) == phrase)
    per_file = placed.groupBy("key").agg(
        F.max("share").alias("share"),
        F.collect_set(F.when(F.col("whole") & (F.col("share") >= LEAST_SHARE), F.element_at(names_of, F.col("template") + 1))).alias("more"))
    joined = stored.drop("places").join(per_file, "key", "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.least(F.lit(1.0), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))), 6).alias("score"))
