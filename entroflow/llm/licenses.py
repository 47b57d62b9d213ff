"""License scans by diagonal voting, with DataFrame functions only.

Texts are split into words once, into a staged table. All rolling word k-grams of the documents are joined to the
positions they have in the templates, which are a table of texts of any length; a pair of positions votes for its diagonal
(document position less template position). Votes are gathered by diagonal and neighbouring diagonals merged (an added or
missing word moves the rest by one) into stretches: each diagonal takes in those up to SPREAD times the template's length
further on, so that words put into a copy may be as many, and stretches that lie within another are left out. A stretch is verified by its words: the
longest chain of matched words that goes forward both in the text and in the template must hold enough of the template.
Diagonals that hold enough by themselves are spans of their own; of broken copies within one stretch the last of the best is told.
Phrases are templates whose every k-gram must stand on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

K, BESIDE, LEAST = 3, 8, 0.6
#: A stretch's diagonals lie within so many template lengths, and within REACH words at least.
SPREAD, REACH = 2.0, 32

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Openings and grants of public license texts.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of ASCII only takes the quicker way to the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _template_grams(spark, templates: DataFrame | Iterable[tuple[str, str]] | None) -> DataFrame:
    """Every k-gram of phrases and templates with its place: template, phrase, label, words, place, t0, t1, ..."""
    fields = "text string, label string"
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([*(TEMPLATES if templates is None else templates)], fields)
    given = spark.createDataFrame([*PHRASES], fields).withColumn("phrase", F.lit(True)).unionByName(templates.select("text", "label", F.lit(False).alias("phrase")).filter("label is not null").distinct())
    split = given.withColumn("w", F.regexp_extract_all(lowered(F.col("text")), F.lit(_WORD), F.lit(0))).filter(F.size("w") >= K)
    split = split.select(F.xxhash64("phrase", "label", "text").alias("template"), "phrase", "label", F.size("w").alias("words"), "w")
    placed = split.select("*", F.explode(F.sequence(F.lit(0), F.col("words") - K)).alias("place"))
    return stage(placed.select("template", "phrase", "label", "words", "place", *(F.get("w", F.col("place") + k).alias(f"t{k}") for k in range(K))), "license_templates")


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, w (lower-cased words) of each row, staged."""
    text = F.coalesce("text", F.lit(""))
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(lowered(text), F.lit(_WORD), F.lit(0)).alias("w")), "license_words")


def license_spans(docs: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, phrase, label, first (word), last (word, exclusive), coverage."""
    return _spans(_words(docs), templates)


def _chain(found: Column) -> Column:
    """The longest chain of matched words, forward in template and text, the last to begin of these: its size, first and last.
    found: array of (back, at), back the place in the template negated, at the place in the text, sorted: from the
    template's end, and of one place the nearest word first, so that a chain has it once at most."""
    link = "struct<at:int,end:int>"

    def step(tails: Column, x: Column) -> Column:
        # tails: for each length the latest beginning of a chain of it; beginnings go down as lengths go up.
        longer, rest = F.filter(tails, lambda t: t["at"] > x["at"]), F.filter(tails, lambda t: t["at"] <= x["at"])
        end = F.coalesce(F.try_element_at(longer, F.lit(-1))["end"], x["at"] + 1)
        return F.concat(longer, F.array(F.struct(x["at"].alias("at"), end.alias("end")).cast(link)), F.slice(rest, F.lit(2), F.size(rest)))

    return F.aggregate(found, F.array().cast(f"array<{link}>"), step, lambda t: F.struct(F.size(t).alias("size"), F.try_element_at(t, F.lit(-1)).alias("whole")))


def _spans(texts: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] | None) -> DataFrame:
    split = texts.filter(F.size("w") >= K)
    shifted = [F.slice("w", F.lit(k + 1), F.size("w") - (K - 1)).alias(f"w{k}") for k in range(K)]
    grams = split.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "g")).select("doc_id", "text_hash", "pos", *(F.col(f"g.w{k}").alias(f"w{k}") for k in range(K)))
    grams = grams.withColumn("gram", F.xxhash64(*(f"w{k}" for k in range(K))))
    places = small(_template_grams(texts.sparkSession, templates)).withColumn("t_gram", F.xxhash64(*(f"t{k}" for k in range(K))))
    same = F.col("gram") == F.col("t_gram")
    for k in range(K):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    of_text = ["doc_id", "text_hash", "template"]
    own = [*of_text, "phrase", "label", "words"]
    hits = grams.join(places, same).select(*own, "place", (F.col("pos") - F.col("place")).alias("diagonal"))
    # Votes are the set of template places, so that a repeated row adds nothing.
    votes = stage(hits.groupBy(*own, "diagonal").agg(F.array_sort(F.collect_set("place")).alias("votes")), "license_votes")
    grams_of = F.col("words") - (K - 1)
    exact = votes.filter(F.col("phrase") & (F.size("votes") == grams_of)).select(*own[:-1], F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("words")).alias("last"), F.lit(1.0).alias("coverage"))
    # A vote tells of K words at most: texts and stretches with fewer votes than that can't hold enough of the template.
    enough = F.ceil(LEAST * F.col("words"))
    near = votes.filter(~F.col("phrase"))
    told = near.select(*own, F.explode("votes").alias("place")).groupBy(*own).agg(F.size(F.collect_set("place")).alias("told")).filter(K * F.col("told") >= enough)
    told = told.select(*(F.col(c).alias(f"_{c}") for c in of_text))
    runs = near.join(told, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("template") == F.col("_template")), "left_semi")
    runs = runs.withColumn("along", F.col("diagonal") / F.greatest(SPREAD * F.col("words"), F.lit(float(REACH))))
    by = Window.partitionBy(*of_text).orderBy("along")
    reach = by.rangeBetween(0, 1)
    places_of = lambda d: F.array_distinct(F.flatten(F.transform(d["votes"], lambda j: F.sequence(j, j + (K - 1)))))
    merged = runs.withColumns({"all": F.collect_list(F.struct("diagonal", "votes")).over(reach), "sum": F.sum(F.size("votes")).over(reach), "end": F.max("diagonal").over(reach)})
    merged = merged.withColumn("whole", F.coalesce(F.col("end") > F.lag("end").over(by), F.lit(True))).filter(F.col("whole") & (K * F.col("sum") >= enough))
    of_one = lambda d: F.transform(places_of(d), lambda p: F.struct((-p).alias("back"), (d["diagonal"] + p).alias("at")))
    merged = merged.withColumn("chain", _chain(F.array_sort(F.flatten(F.transform("all", of_one)))))
    merged = merged.select(*own, F.col("chain.whole.at").alias("first"), F.col("chain.whole.end").alias("last"), (F.col("chain.size") / F.col("words")).alias("coverage"))
    alone = runs.withColumn("places", places_of(F.struct("diagonal", "votes")))
    alone = alone.select(*own, (F.col("diagonal") + F.array_min("places")).alias("first"), (F.col("diagonal") + F.array_max("places") + 1).alias("last"), (F.size("places") / F.col("words")).alias("coverage"))
    near = merged.unionByName(alone).filter(F.col("coverage") >= LEAST)
    # Templates that share most words: of stretches that begin within a few words, those of the best coverage count.
    beside = Window.partitionBy("doc_id", "text_hash").orderBy("first").rangeBetween(-BESIDE, BESIDE)
    near = near.select(exact.columns).distinct().withColumn("best", F.max("coverage").over(beside)).filter("coverage = best").drop("best")
    return exact.unionByName(near)


def scan_licenses(docs: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of each row of `docs`, with its doc_id.

    n_base counts the places of the fixed phrases, first_word and last_word are the smallest and largest start of one
    (null without); labels adds those of license texts found nearly whole; score is the best coverage, 0 without any.
    `templates`: texts and their labels, as a table (text, label) or pairs, of any number and length; default: TEMPLATES.
    Their words are taken as the documents' are; a template of a null label, or of fewer than K words, is never found.
    A null text is empty. Rows are kept, repeated ones alike; other columns play no part, whatever their names; an empty
    table gives an empty result.
    """
    texts = _words(docs)
    spans = _spans(texts, templates)
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    base = F.when(F.col("phrase"), F.col("first"))
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    sized = texts.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    both = sized.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"))
