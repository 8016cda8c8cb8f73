"""License scan by diagonal voting, in built-in functions only.

Every word 2-gram of a text is joined by its hash to the positions it has in the
templates. A hit votes for the diagonal ``word position - template position``; votes
are summed by (document, template, diagonal), diagonals that lie within ``SLACK`` words
of each other are merged (a word more or less inside a notice shifts its tail). A
merged run with enough votes is then verified: what counts is its longest chain of
2-grams that follow each other both in the text and in the template, with steps of
``SLACK`` diagonals at most, so no place of the template counts twice or out of order.
Short phrases must stand whole on one diagonal, which makes them exact. The hash join is
followed by a comparison of the words, so colliding hashes never vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 3
#: Share of a notice's 2-grams that must vote.
COVERAGE = 0.6

# Phrases that must stand whole, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of widely used public license notices, found also with small changes.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "as-is": "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "gnu lesser general public license",
    "cc-license": "this work is licensed under a creative commons attribution",
    "spdx": "spdx license identifier",
    "mit-name": "released under the mit license",
}


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, a-z and characters beyond ASCII; null counts as empty."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` also maps letters beyond ASCII, which neither splits words nor spells a phrase: only the Kelvin sign becomes an ASCII letter, so it is set aside first."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows = []
    for whole, group in ((True, {v: k for k, v in phrases.items()}), (False, notices)):
        for label, text in group.items():
            w = text.split(" ")
            rows += [(label, whole, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "label string, whole boolean, grams int, tpos int, t1 string, t2 string")
    return table.withColumn("h", F.xxhash64("t1", "t2"))


def _row(id_col: str, text_col: str) -> Column:
    """What votes are counted by: rows of one id are told apart by their texts, and rows of one id and text have the same spans anyway."""
    return F.struct(F.col(id_col).alias("id"), F.substring(F.sha2(F.coalesce(text_col, F.lit("")), 256), 1, 32).alias("hash"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per found span: id, label, whole, start word, words covered, coverage.

    Null and empty texts have no spans. Texts that share an id, or have none, are scanned
    each; equal texts under one id are told once. ``phrases`` maps a phrase of two or more words to
    its label, ``notices`` a label to its text; both tables are literals, and broadcast.
    """
    found = _spans(docs, id_col, text_col, phrases, notices)
    return found.select("id.id", *found.columns[1:])


def _spans(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str] | None, notices: dict[str, str] | None) -> DataFrame:
    grams = _templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    words = docs.select(_row(id_col, text_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    each = words.select("id", F.posexplode(pairs).alias("pos", "p")).select("id", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    votes = each.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(grams), "h").where("a = t1 and b = t2")
    by = votes.groupBy("id", "label", "whole", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places")).withColumn("hits", F.size("places"))
    return _merged(by)


def _chain(hits: Column, grams: Column) -> Column:
    """Votes of the longest chain, from the ``hits`` (pos, tpos) of a run in order."""

    def step(state: Column, hit: Column) -> Column:
        shift = lambda s: F.abs(hit["pos"] - hit["tpos"] - s["pos"] + s["tpos"])
        before = F.filter(state["near"], lambda s: (s["pos"] < hit["pos"]) & (s["tpos"] < hit["tpos"]) & (shift(s) <= SLACK))
        n = F.coalesce(F.array_max(F.transform(before, lambda s: s["n"])), F.lit(0)) + 1
        # what lies further back can't be followed any more
        near = F.filter(state["near"], lambda s: s["pos"] >= hit["pos"] - grams - SLACK)
        return F.struct(F.greatest(state["best"], n).alias("best"), F.concat(near, F.array(F.struct(n.alias("n"), hit["pos"].alias("pos"), hit["tpos"].alias("tpos")))).alias("near"))

    none = F.struct(F.lit(0).alias("best"), F.array().cast("array<struct<n:int,pos:int,tpos:int>>").alias("near"))
    return F.aggregate(hits, none, step, lambda state: state["best"])


def _merged(by: DataFrame) -> DataFrame:
    """Whole phrases from full diagonals; notices from runs of neighbouring diagonals with enough votes in a chain."""
    whole = by.where("whole and hits = grams").select("id", "label", "whole", F.col("diagonal").cast("long").alias("start"), (F.col("grams") + 1).cast("long").alias("length"), F.lit(1.0).alias("coverage"))
    line = Window.partitionBy("id", "label").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(line)
    runs = by.where("not whole").withColumn("first", F.coalesce((gap > SLACK).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("first").over(line))
    at = F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("pos"), t.alias("tpos")))
    found = runs.groupBy("id", "label", "whole", "grams", "run").agg(F.sum("hits").alias("hits"), F.max_by("diagonal", F.struct("hits", -F.col("diagonal"))).alias("start"), F.flatten(F.collect_list(at)).alias("at"))
    found = found.where(F.col("hits") / F.col("grams") >= COVERAGE).withColumn("chained", _chain(F.array_sort("at"), F.col("grams")))
    part = F.col("chained") / F.col("grams")
    found = found.where(part >= COVERAGE).select("id", "label", "whole", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), (F.col("grams") + 1).cast("long").alias("length"), part.alias("coverage"))
    return whole.unionByName(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base figures count whole phrases only; ``labels`` adds the notices; ``score`` is the
    best coverage (1 for a whole phrase, 0 without any). Texts that are null, empty or
    without words give zeros, null places and empty labels. Rows that repeat an id, or have
    none, are each told by their own text.
    """
    found = _spans(docs, id_col, text_col, phrases, notices)
    base = lambda c: F.when(F.col("whole"), F.col(c))
    told = found.groupBy("id").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select(_row(id_col, text_col).alias("id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(told, "id", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select(F.col("id.id").alias(id_col), "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
