"""License scan by diagonal voting, in DataFrame operations only.

Rolling hashes of ``K`` words of each document are joined to their places in
license templates. Each match votes for a diagonal, the place in the document
less that in the template; neighbouring diagonals are merged, so words put in or
left out don't split a license. What they hold is verified: only matches that
stand in the template's order count, on diagonals that drift by a few words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the contract and their labels. All words of a phrase must stand consecutively.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Well-known sentences of licenses, found with small changes too.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    ``lower`` also changes letters beyond ASCII, two of them into ASCII ones; texts with those are translated letter by letter.
    """
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.when(text.rlike("[\\u0130\\u212A]"), plain).otherwise(F.lower(text)), F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """A row for each gram of each template, and one, of no template, that the mark of each document meets."""
    rows = [(-1, "", True, 0, -1, "", "", "")]
    for n, (label, text, base) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates]):
        w = re.findall(WORD, text)
        rows += [(n, label, base, len(w), i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, place int, t0 string, t1 string, t2 string").withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def in_order(matches: Column, places: Column) -> Column:
    """The length of the longest chain of matches (at, place) in which both rise, of places below ``places``.

    Matches are sorted by (at, -place), so none follows one at the same word; the
    state holds, for each place, the longest chain that ends there or before.
    """
    longer = lambda best, m: F.transform(best, lambda b, q: F.when(q < -m["back"], b).otherwise(F.greatest(b, 1 + F.coalesce(F.get(best, -m["back"] - 1), F.lit(0)))))
    return F.aggregate(F.array_sort(matches), F.array_repeat(F.lit(0), places), longer, lambda best: F.element_at(best, -1))


def scan_licenses(docs: DataFrame, *, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, slip: int = 4, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase is found where all its words stand consecutively. A template is
    found where at least ``least`` of its grams stand in its order, each once, on
    diagonals of which the last is at most ``slip`` from the first: at most so
    many more words put in than left out, or less. Of one shorter than twelve
    words, where one word may be the version, all grams must stand on one
    diagonal. ``score`` is the largest such share of any phrase or template, 0 if
    no gram matches. A null text counts as empty. Null ids are kept; repeated rows
    give the same result, once each; an empty table gives no rows; other columns
    are ignored. Documents are scanned once; only matches, and one mark a
    document, are shuffled.
    """
    grams = F.broadcast(template_grams(docs.sparkSession, templates, phrases))  # a few hundred rows, fixed by the code
    at = F.col("at")
    word = lambda i: F.when(at < 0, "").otherwise(F.get("words", at + i))
    text = F.coalesce(F.col("text"), F.lit(""))
    rolled = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("bytes"), words(text).alias("words"))
        .select("doc_id", "text_hash", "bytes", F.size("words").cast("bigint").alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("words") - K))).alias("at"))
        .select("doc_id", "text_hash", "bytes", "n_words", "at", *(word(i).alias(f"w{i}") for i in range(K)))
        .withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    )
    votes = (
        rolled.join(grams, "gram")
        .where((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
        .groupBy("doc_id", "text_hash", "bytes", "n_words", "template", "label", "base", "size", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("hits"))
    )
    # Each diagonal of a document and a template is tried as the first of a span; the others of it are at most ``slip`` on.
    # All matches of one document on one template meet in a window, so its length bounds them.
    span = Window.partitionBy("doc_id", "text_hash", "bytes", "template").orderBy("diagonal").rangeBetween(0, slip)
    keys = ["doc_id", "text_hash", "bytes", "n_words"]
    free = F.when(F.col("base") | (F.col("size") < 12), 0).otherwise(slip)
    near = F.filter(F.collect_list(F.struct("diagonal", "places")).over(span), lambda d: d["diagonal"] - F.col("diagonal") <= F.col("free"))
    matches = F.flatten(F.transform("near", lambda d: F.transform(d["places"], lambda p: F.struct((d["diagonal"] + p).alias("at"), (-p).alias("back")))))
    spans = (
        votes.withColumn("free", free)
        .withColumn("near", near)
        .withColumn("diagonal", F.col("diagonal").cast("bigint"))
        .withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(in_order(matches, F.greatest(F.col("size") - (K - 1), F.lit(1))) / (F.col("size") - (K - 1))))
    )
    phrase, found = F.col("base") & (F.col("share") == 1), F.col("share") >= F.when(F.col("base") | (F.col("size") < 12), 1.0).otherwise(least)
    is_text = F.col("template") >= 0
    labels = lambda ok: F.array_join(F.array_sort(F.collect_set(F.when(ok & is_text, F.col("label")))), ",")
    return (
        spans.groupBy(*keys)
        .agg(
            F.max(F.when(~is_text, F.col("hits"))).alias("rows"),
            F.count_if(phrase & is_text).alias("n_base"),
            F.min(F.when(phrase & is_text, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(phrase & is_text, F.col("diagonal"))).alias("last_word"),
            labels(phrase).alias("base_labels"),
            labels(found).alias("labels"),
            F.max("share").alias("score"),
        )
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
        .drop("copy")
    )
