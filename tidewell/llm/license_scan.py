"""License scan by diagonal voting (native: DataFrame functions only).

Every rolling word k-gram of every document is joined to the positions of the same k-gram in the license
templates. A hit votes for the diagonal ``document position - template position``; neighbouring
diagonals of one template (insertions and deletions shift a diagonal by a few words) merge into one span,
and a span is verified by the share of the template's words that its hits cover. The template side is a
constant of this module, a few hundred rows, so it is broadcast; the documents' k-grams are never shuffled,
only their hits are.

Beside the votes, the base phrases are found exactly, with their word positions.

Defined results: null text has no words; an empty table gives an empty result; repeated rows give equal
rows; a null ``doc_id`` is carried along; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import NON_WORD, ascii_lower, table, text_of

K = 4  # words of a gram
NEIGHBOUR = 3  # words between diagonals that still merge
COVERED = 0.6  # share of a template's words from which a span is verified

# Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Usual notices of public licenses, as (label, words).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _template_grams(spark: SparkSession) -> DataFrame:
    rows = []
    for number, (label, words) in enumerate(TEMPLATES):
        w = words.split()
        rows += [(number, label, len(w), i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    grams = spark.createDataFrame(rows, f"t int, label string, t_words int, t_pos int, {', '.join(f't{i} string' for i in range(K))}")
    return grams.select("t", "label", "t_words", "t_pos", F.xxhash64(*[f"t{i}" for i in range(K)]).alias("gram"))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NON_WORD), lambda w: w != "")


def vote(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, _th (hash of the text), t, label, first, words, covered."""
    worded = docs.select("doc_id", F.xxhash64(text_of()).alias("_th"), _words(text_of()).alias("_w"))
    worded = worded.filter(F.size("_w") >= K)
    shifted = F.arrays_zip(*[F.slice(F.col("_w"), F.lit(i + 1), F.size("_w") - (K - 1)).alias(f"w{i}") for i in range(K)])
    grams = worded.select("doc_id", "_th", F.posexplode(shifted).alias("pos", "g")).select("doc_id", "_th", "pos", F.xxhash64(*[f"g.w{i}" for i in range(K)]).alias("gram"))
    hits = grams.join(F.broadcast(_template_grams(docs.sparkSession)), "gram")
    doc = ["doc_id", "_th", "t", "label", "t_words"]
    diagonals = hits.groupBy(*doc, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("t_seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy(*doc).orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR, F.lit(True)).cast("int")
    spans = (
        diagonals.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(along))
        .groupBy(*doc, "span")
        .agg(F.flatten(F.collect_list("t_seen")).alias("seen"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    )
    reached = F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + (K - 1)))))
    return spans.select(
        "doc_id",
        "_th",
        "t",
        "label",
        F.col("first").cast("long").alias("first"),
        (F.col("last") - F.col("first") + K).cast("long").alias("words"),
        (F.size(reached) / F.col("t_words")).alias("covered"),
    ).filter(F.col("covered") >= COVERED)


def _phrase(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    # each word between two spaces of its own, so that neighbouring phrases never share one
    based = docs.select("doc_id", F.xxhash64(text_of()).alias("_th"), _words(text_of()).alias("_w")).select("doc_id", "_th", F.size("_w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")).alias("_s"))
    spaces = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))) / 2
    counts, firsts, lasts, labels = [], [], [], []
    for words, label in PHRASES.items():
        p = _phrase(words)
        there = F.contains("_s", F.lit(p))
        counts.append(F.when(there, (F.octet_length("_s") - F.octet_length(F.replace("_s", F.lit(p), F.lit("")))) / len(p)).otherwise(0).cast("long"))
        firsts.append(F.when(there, spaces(F.substring_index("_s", p, 1))).cast("long"))
        lasts.append(F.when(there, F.col("n_words") - len(words.split()) - spaces(F.substring_index("_s", p, -1))).cast("long"))
        labels.append(F.when(there, F.lit(label)))
    base = based.select(
        "doc_id",
        "_th",
        "n_words",
        reduce(Column.__add__, counts).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("_base"),
    )
    voted = vote(docs).groupBy(F.col("doc_id").alias("_v_id"), F.col("_th").alias("_v_th")).agg(F.collect_set("label").alias("_voted"), F.max("covered").alias("_covered"), F.count("*").alias("_spans"))
    joined = base.join(voted, F.col("doc_id").eqNullSafe(F.col("_v_id")) & (F.col("_th") == F.col("_v_th")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_voted", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("_covered", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))).alias("score"),
    )


def op2_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
