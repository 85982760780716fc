"""Operator 3: license scans by diagonal voting, in DataFrame operations only.

All rolling three-word hashes of every document are joined to the positions of
the same hashes in the license templates (a fixed list, so its broadcast has a
fixed bound). Matches are counted by (document, template, diagonal), the
diagonal being document position less template position, with the set of
template positions that matched (a bit each). A full diagonal of a base phrase
is a place where the phrase stands word for word.

For the longer templates each diagonal is merged with those up to ``BAND``
after it, which bridges words put in or left out. A merged span is a candidate
when ``VOTES`` of the template's positions voted, each counted once however
often its words are repeated, and verified when the words under those positions
are ``COVER`` of the template's words. Diagonals that near keep the order of the
words: parts that change places lie as many diagonals apart as they are long.

Defined cases: a null or empty text has no words, null positions, empty labels
and score 0; texts of any length are scanned whole; repeated rows are scanned
each; a document that is all license is only as many rows as it has words; of
merged spans of one template near each other the one of greatest cover counts,
of equal ones the first; of overlapping spans of several templates all of
greatest cover count; an empty table gives an empty result; further columns are
ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest distance between diagonals that are merged; less than any template's words.
BAND = 6
#: Least share of a template's positions that vote for a span, and of its words that they cover.
VOTES, COVER = 0.6, 0.8

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Well-known license lines and openings, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "this work is licensed under the creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
}


def template_hashes(spark) -> DataFrame:
    """(hash, template, label, base, at, grams) for every rolling hash of the fixed templates."""
    texts = [(i, t, label, t in BASE, len(t.split()) - K + 1) for i, (t, label) in enumerate([*BASE.items(), *TEMPLATES.items()])]
    rows = [(i, label, base, at, n, *t.split()[at : at + K]) for i, t, label, base, n in texts for at in range(n)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, at int, grams int, w0 string, w1 string, w2 string")
    return table.select("template", "label", "base", "at", "grams", F.xxhash64("w0", "w1", "w2").alias("hash"))


#: Key of the one row in each document that carries its number of words.
COUNT = 0


def matches(docs: DataFrame) -> DataFrame:
    """One row per (document row, template, diagonal) with at least one common hash; template -1 carries n_words."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    n = F.size("w")
    rolled = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(K)])))
    # position 0 carries the number of words, hashes follow from position 1
    values = F.concat(F.array(n.cast("long")), F.coalesce(rolled, F.array().cast("array<bigint>")))
    rows = listed.select("row", "doc_id", F.posexplode(values).alias("pos", "value")).withColumn("hash", F.when(F.col("pos") == 0, F.lit(COUNT)).otherwise(F.col("value")))
    spark = docs.sparkSession
    known = template_hashes(spark).union(spark.createDataFrame([(-1, "", False, -1, 0, COUNT)], "template int, label string, base boolean, at int, grams int, hash long"))
    hits = rows.join(F.broadcast(known), "hash")
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("pos") - 1 - F.col("at"))
    return hits.groupBy("row", "doc_id", "template", "label", "base", "grams", diagonal.alias("diagonal")).agg(
        F.count("*").alias("matched"), F.bit_or(F.expr("CASE WHEN at < 0 THEN 0L ELSE shiftleft(1L, at) END")).alias("votes"), F.min(F.col("pos") - 1).alias("first"), (F.max("pos") + K - 2).alias("last"), F.max("value").alias("n_words")
    )


def spans(docs: DataFrame) -> DataFrame:
    """Merged and verified spans: row, doc_id, template, label, base, start, first, last, cover; template -1 carries n_words.

    A base phrase must match in full on one diagonal; ``cover`` is the share of the template's words."""
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    after, around = by.rangeBetween(0, BAND), by.rangeBetween(-BAND, BAND)
    votes = F.bit_or("votes").over(after)
    merged = matches(docs).withColumns({"first": F.min("first").over(after), "last": F.max("last").over(after), "all": votes, "n_words": F.col("n_words")})
    words = F.bit_count(F.col("all").bitwiseOR(F.shiftleft("all", 1)).bitwiseOR(F.shiftleft("all", 2)))
    enough = F.bit_count("all") >= VOTES * F.col("grams")
    cover = F.when(F.col("template") < 0, 0.0).when(F.col("base"), F.col("matched") / F.col("grams")).when(enough, words / (F.col("grams") + K - 1)).otherwise(0.0)
    scored = merged.withColumn("cover", cover)
    best = F.max(F.struct("cover", (-F.col("diagonal")).alias("turn"))).over(around)
    ranked = scored.withColumn("best", F.col("base") | (-best.turn == F.col("diagonal")))
    least = F.when(F.col("base"), 1.0).otherwise(COVER)
    kept = ranked.where((F.col("template") < 0) | ((F.col("cover") >= least) & F.col("best")))
    return kept.select("row", "doc_id", "template", "label", "base", F.col("diagonal").alias("start"), "first", "last", "cover", "n_words")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (template, first and last word, cover) of each row."""
    start = F.when(F.col("base"), F.col("start").cast("long"))
    found = F.col("template") >= 0
    span = F.struct("first", "last", "label", "cover")
    # of template spans that overlap, those of less cover are other versions of the same text
    return (
        spans(docs)
        .groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("template") < 0, F.col("n_words"))).alias("n_words"),
            F.sum(F.col("base").cast("long")).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found & F.col("base"), span))).alias("exact"),
            F.array_sort(F.collect_list(F.when(found & ~F.col("base"), span))).alias("close"),
        )
        .withColumn("close", F.filter("close", lambda x: ~F.exists("close", lambda y: (y.cover > x.cover) & (y["first"] <= x["last"]) & (x["first"] <= y["last"]))))
        .withColumn("spans", F.concat("exact", "close"))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda x: x.label))), ","))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )
