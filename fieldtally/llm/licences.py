"""Licence scans by diagonal voting, in DataFrame operations only.

All rolling word 3-grams of all texts are joined to the templates' positions by hash (and
word by word, so a collision counts for nothing). A hit votes for its diagonal, the text
position less the template position; diagonals at most ``NEAR`` apart are merged, which
lets words be put in or left out, and a span is verified by the share of the template's
words that its hits cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, ready, table, written
from .urls import LOWER, UPPER

# The base phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Wording of public licence notices, lower case, words only.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
GRAM = 3
NEAR = 2  # diagonals so far apart are one span
COVERED = 0.7  # share of a template's words that verifies a span
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _positions(spark: SparkSession, templates) -> DataFrame:
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        rows += [(number, label, len(words), at, *words[at:at + GRAM]) for at in range(len(words) - GRAM + 1)]
    df = spark.createDataFrame(rows, "template int, label string, template_words int, template_at int, t0 string, t1 string, t2 string")
    return df.withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def scan_licences(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best verified share of a template, 1 for a base phrase).

    A null or empty text has no words, no labels (empty strings) and score 0. Null ids and
    repeated rows are scanned each; an empty table gives no row; further columns are
    ignored.
    """
    spark = ready(docs.sparkSession)
    src = only(docs, id_col, text_col).select("doc_id", F.translate("text", UPPER, LOWER).alias("text"), F.monotonically_increasing_id().alias("row"))
    # A separator at either end leaves one empty string there.
    split = src.select("doc_id", "row", F.split("text", APART).alias("w"))
    lead, n = (F.col("w")[0] == "").cast("int"), F.size("w")
    tail = ((F.try_element_at("w", F.lit(-1)) == "") & (n > lead)).cast("int")
    words = split.select("doc_id", "row", F.slice("w", lead + 1, n - lead - tail).alias("w"))
    windows = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("c"))
    # A row at -1 stands for the text itself, so that texts without a hit stay.
    every = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(windows).alias("at", "g"))
    every = every.select("doc_id", "row", "n_words", F.coalesce(F.col("at"), F.lit(0)).alias("at"), F.col("g.a").alias("w0"), F.col("g.b").alias("w1"), F.col("g.c").alias("w2"))
    base = F.lit(None).cast("string")
    for phrase, label in PHRASES:
        parts = phrase.split()
        fits = [F.col(f"w{i}") == p for i, p in enumerate(parts)]
        base = F.when(fits[0] & fits[1] & (fits[2] if len(parts) > 2 else F.lit(True)), label).otherwise(base)
    grams = _positions(spark, templates)  # bounded by the templates
    hit = (F.xxhash64("w0", "w1", "w2") == F.col("gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    joined = every.join(F.broadcast(grams), hit, "left").withColumn("base", base)
    marks = joined.where((F.col("at") == 0) | F.col("template").isNotNull() | F.col("base").isNotNull())
    marks = written(marks.select("row", "doc_id", "n_words", "at", "base", "template", "label", "template_words", "template_at"), "licence-marks")

    votes = marks.where("template is not null").withColumn("diagonal", F.col("at") - F.col("template_at"))
    diagonals = votes.groupBy("row", "template", "label", "template_words", "diagonal").agg(F.collect_set("template_at").alias("hits"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(0))
    spans = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy("row", "template", "label", "template_words", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x, x + GRAM - 1)))))
    verified = spans.withColumn("share", covered / F.col("template_words")).where(F.col("share") >= COVERED)
    more = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    place = marks.select("row", "doc_id", "n_words", "at", "base").distinct()
    start = F.when(F.col("base").isNotNull(), F.col("at").cast("long"))
    whole = place.groupBy("row", "doc_id", "n_words").agg(F.count("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), F.collect_set("base").alias("bases"))
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat("bases", F.coalesce("more", none)))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return whole.join(more, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("bases")).alias("base_labels"), join(both).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op4_diagonal_voting(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))
