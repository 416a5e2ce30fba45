"""License scans by diagonal voting, with DataFrame functions alone.

Words of a text are numbered from 0. The hashes of all rolling word pairs are joined with the pairs of the templates; a
hit votes for the diagonal (place in the text minus place in the template). Votes are summed by diagonal, neighbouring
diagonals (words put in or left out) are merged, and a span is verified by the share of the template's places that it
covers. A phrase needs its one diagonal whole: its words stand consecutively. The templates are a constant of this
module, so their table is broadcast.

Defined results: null or empty texts have no words and no labels, score 0 and null places; a pair of a phrase that
overlaps itself counts at every start; repeated rows each get a row. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import all_cores, ascii_lower

# Phrases and the labels that they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of common notices, in words, and the labels that they stand for.
NOTICES = {
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "asl-text",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution": "cc-text",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _pairs(of: Column) -> Column:
    """Hash of each word with the next one; the last word has no pair of its own."""
    return F.transform(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(of, i + 1)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, pairs, at, pair): every word pair of every template."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text in PHRASES).alias("phrase"), F.split(F.lit(text), " ").alias("words"))
        for i, (text, label) in enumerate((PHRASES | NOTICES).items())
    ]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")
    return table.select("template", "label", "phrase", (F.size("words") - 1).alias("pairs"), F.posexplode(_pairs(F.col("words"))).alias("at", "pair"))


def _spans(docs: DataFrame, key: str, text: str, drift: int, coverage: float) -> DataFrame:
    """Verified spans, and for each text one row without a template, which says how many words it has and how often it is there.

    So one scan gives both: an empty word ends each text, and its pair, which no other word can make, has no template."""
    ended = F.concat(words(F.col(text)), F.array(F.lit("")))
    worded = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), ended.alias("words"))
    none = F.xxhash64(F.lit(""), F.lit(None).cast("string"))
    grams = worded.select("id", "h", F.posexplode(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))).alias("place", "pair"))
    own = templates(docs.sparkSession)
    extra = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("phrase"), F.lit(1).alias("pairs"), F.lit(0).alias("at"), none.alias("pair"))
    hits = grams.join(F.broadcast(own.union(extra)), "pair")  # the templates are constants
    by = ["id", "h", "template", "label", "phrase", "pairs"]
    diagonals = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*by, "diagonal").agg(F.collect_set("at").alias("seen"), F.count(F.lit(1)).alias("times"))
    diagonals = diagonals.where("phrase is null or not phrase or size(seen) = pairs")
    row = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(row) > drift)
    merged = diagonals.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*by, "group").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("times").alias("times"))
    score = F.size("seen") / F.col("pairs")
    first, last = F.greatest(F.col("low") + F.array_min("seen"), F.lit(0)), F.col("high") + F.array_max("seen") + 1
    return merged.select("id", "h", "template", "label", "phrase", first.cast("bigint").alias("first_word"), last.cast("bigint").alias("last_word"), score.alias("score"), "times").where(F.col("score") >= coverage)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", drift: int = 3, coverage: float = 0.7) -> DataFrame:
    """Verified spans: (id, h, template, label, phrase, first_word, last_word, score), h being the hash of the text.

    ``drift``: words by which neighbouring diagonals of one span may differ; ``coverage``: least share of a notice.
    """
    return _spans(docs, key, text, drift, coverage).where("template >= 0").drop("times")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", drift: int = 3, coverage: float = 0.7) -> DataFrame:
    """Per row: (key), n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = _spans(all_cores(docs.select(key, text)), key, text, drift, coverage)
    base = F.col("phrase")
    start = F.when(base, F.col("first_word"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    real = F.col("template") >= 0
    by_doc = found.groupBy("id", "h").agg(
        F.max(F.when(~real, F.col("first_word"))).alias("n_words"),  # where the empty word stands
        F.count_if(base).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("score"))), F.lit(0.0)).alias("score"), F.max(F.when(~real, F.col("times"))).alias("times"),
    )
    each = by_doc.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))  # repeated rows each get theirs
    return each.select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
