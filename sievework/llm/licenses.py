"""License scans by diagonal voting.

Texts are lower-cased (A-Z alone) and cut into words of digits, a-z and anything beyond ASCII. Rolling hashes of k words
are joined to the places of the same k words in the templates (a constant table, so the join is a broadcast one); each
hit votes for the diagonal, place in the text less place in the template. Each k-gram brings its own words along, so hits
are checked word for word where they are found, hash collisions never vote, and the work is linear in a text's length. Votes are counted by diagonal; neighbouring diagonals (words put in or left out)
are merged; and a merged span is verified by the share of the template that it covers.

Two sorts of templates: the base phrases, k = 2, of which every place must be a whole match on one diagonal; and the
notices, k = 3 (found by the hash of the first two), that need COVERED of their k-grams. A score is the best coverage, 1 for a base phrase.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; repeated rows, also with one
doc_id, are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import ascii_lower, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The contract's phrases and labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that the method knows of its own; each is the opening or the reference line of a public licence.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
BASE_K, NOTICE_K = 2, 3
#: Diagonals this near are one span; the share of a notice's k-grams that a span must cover.
NEAR, COVERED = 3, 0.8


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def _templates(spark: SparkSession) -> DataFrame:
    """(gram, gram_words, template, label, base, t_pos, t_grams): one row for each place of k words of each template."""
    rows = []
    for n, (phrase, label) in enumerate(BASE_PHRASES + NOTICES):
        words, base = re.split(r" +", phrase), n < len(BASE_PHRASES)
        k = BASE_K if base else NOTICE_K
        rows += [(words[i : i + k], n, label, base, i, len(words) - k + 1) for i in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "gram_words array<string>, template int, label string, base boolean, t_pos int, t_grams int").coalesce(1)
    return table.withColumn("gram", F.xxhash64(*[F.xxhash64(F.get("gram_words", F.lit(j))) for j in range(BASE_K)]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(text_of().cast("string")).alias("words"))
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    # Pairs of words are hashed and joined, for both sorts of templates; a place brings the words that a notice compares.
    one = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("h", i + j) for j in range(BASE_K)]).alias("g"), F.slice("words", i + 1, NOTICE_K).alias("own"))
    grams = F.when(F.col("n") >= BASE_K, F.transform(F.sequence(F.lit(0), F.col("n") - BASE_K), one)).otherwise(F.array().cast("array<struct<pos:int,g:bigint,own:array<string>>>"))
    none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("array<string>").alias("own")))
    placed = rows.select("row", "doc_id", "n", F.explode(F.concat(none, grams)).alias("at"))
    placed = placed.select("row", "doc_id", "n", F.col("at.pos").alias("pos"), F.col("at.g").alias("g"), F.col("at.own").alias("own"))
    table = F.broadcast(_templates(spark))
    same = F.slice("own", F.lit(1), F.size("gram_words")) == F.col("gram_words")
    hits = placed.join(table, (placed.g == table.gram) & same, "left").where(F.col("template").isNotNull() | (F.col("pos") < 0))
    hits = hits.select("row", "doc_id", "n", "template", "label", "base", "t_pos", "t_grams", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    voted = hits.groupBy("row", "doc_id", "n", "template", "label", "base", "t_grams", "diagonal").agg(F.collect_set("t_pos").alias("covers"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(NEAR)) | F.lag("diagonal").over(order).isNull()
    merged = voted.withColumn("new", far.cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = merged.groupBy("row", "doc_id", "n", "template", "label", "base", "t_grams", "span").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covers"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("diagonal"))
    share = F.coalesce(F.size("covers") / F.col("t_grams"), F.lit(0.0))
    spans = spans.withColumn("share", F.when(F.col("template").isNull(), F.lit(0.0)).otherwise(share))
    whole = F.col("base") & (F.col("share") == 1.0)
    verified = whole | (~F.col("base") & (F.col("share") >= COVERED))
    each = spans.select("row", "doc_id", "n", F.coalesce(whole, F.lit(False)).alias("whole"), F.when(verified, F.col("label")).alias("label"), F.when(whole, F.col("label")).alias("base_label"), "diagonal", F.when(F.col("base") & ~whole, F.lit(0.0)).otherwise(F.col("share")).alias("share"), F.when(verified, F.struct("label", F.col("first").alias("first"), F.col("last").alias("last"))).alias("found"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return each.groupBy("row", "doc_id", "n").agg(
        F.count_if("whole").alias("n_base"), F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        joined("base_label").alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"), F.collect_list("found").alias("spans"),
    ).select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "base_labels", "labels", "score", "spans")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base places, labels and scores of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
