"""License scans by a positional rare-token index, in DataFrame functions only.

The licence templates give a word list and postings (word, template, place); common function words stay out of it.  Each document
is cut into words once; of the documents that hold the words of a key phrase the words are kept.  Document frequencies over all documents give
each licence word its IDF; all of a document's licence words are looked up in the postings, hits are grouped by template and
relative place (place in the document minus place in the template), and a group whose IDF mass is large enough counts once the
template's mandatory key phrase stands exactly where the alignment puts it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import read, stage

#: The phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Fixed values: (label, key phrase, notice), in lower-case words; the key phrase is part of the notice.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0", "licensed under cc0 1 0 universal public domain dedication"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd 4 0", "licensed under cc by nd 4 0"),
)
COMMON = frozenset("a and any are as by can for in into is it may not of or that the this to under use with you 0 1 2 3 4 v".split())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6

_POSTINGS = [(w, t, i) for t, (_, _, notice) in enumerate(TEMPLATES) for i, w in enumerate(notice.split()) if w not in COMMON]
VOCABULARY = sorted({w for w, _, _ in _POSTINGS} | {w for phrase, _ in BASE for w in phrase.split()})
_KEY_WORDS = sorted({tuple(sorted(set(phrase.split()) - COMMON)) for _, phrase, _ in TEMPLATES})


def words_of(text: Column) -> Column:
    """Words of ``text``, A-Z lower-cased.

    ``lower`` turns two letters beyond ASCII, the Kelvin sign and the dotted capital I, into ASCII ones, which would change words;
    another letter stands in for them.  What else it does beyond ASCII stays there and meets no licence word.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0101")), F.lit("\u0130"), F.lit("\u0101"))
    return F.regexp_extract_all(F.lower(safe), F.lit(WORD), F.lit(0))


def _at(words: Column, i: Column, phrase: str) -> Column:
    """Whether ``phrase`` stands at word ``i`` (from 0)."""
    found = F.lit(True)
    for j, w in enumerate(phrase.split()):
        found = found & F.coalesce(F.get(words, (i + j).cast("int")) == w, F.lit(False))
    return found


def _places(words: Column, phrase: str, label: str) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _at(words, i, phrase))
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, *, text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Licences in every document (doc_id, ``text``): one row each, with doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and places (array<struct<label,first_word,share>>: the method's own finds).

    Null and empty texts have no words, no labels, score 0 and null first and last words.  Repeated rows are scanned one by one, and
    so are rows that share a doc_id or have none.  Very long texts are taken whole; other columns, whatever their names, are not read and not returned.  An empty table gives no rows; IDF is then of no use.  Score: 1 with a base label,
    else the largest share of a template's IDF mass that stood in place, 0 without labels.
    """
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    words = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of(F.col(text)).alias("_words"))
    known = words.withColumn("_known", F.array_intersect("_words", vocabulary))
    has = lambda w: F.array_contains("_known", w)
    base_hint = has("mit") & has("license") | has("apache") & has("license") & has("version") | has("cc") & has("by") & has("nc")
    keep = base_hint  # a label needs its whole key phrase, so all licence words of that
    for needed in _KEY_WORDS:
        keep = keep | reduce(lambda a, b: a & b, [has(w) for w in needed])
    table = stage(known.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), "_known", F.when(keep, F.col("_words")).alias("_words")), "licenses")

    total = table.count()
    frequency = {r["w"]: r["n"] for r in table.select(F.explode("_known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row a vocabulary word
    idf = {w: _idf(total, frequency.get(w, 0)) for w in VOCABULARY}

    candidates = table.where(F.col("_words").isNotNull())
    places = F.flatten(F.array(*[_places(F.col("_words"), phrase, label) for phrase, label in BASE]))
    base = candidates.where(base_hint).select("_row", places.alias("_places")).where(F.size("_places") > 0).select(
        "_row", F.size("_places").cast("long").alias("n_base"), F.array_min("_places.at").alias("first_word"), F.array_max("_places.at").alias("last_word"),
        F.array_distinct("_places.label").alias("_base"))

    found = _aligned(candidates, idf, least_share)
    labels = lambda c: F.array_join(F.array_sort(c), ",")
    none = F.array().cast("array<string>")
    merged = table.drop("_words", "_known").join(base, "_row", "left").join(found, "_row", "left")
    own = F.coalesce(F.col("places.label"), none)
    return merged.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        labels(F.coalesce("_base", none)).alias("base_labels"), labels(F.array_union(F.coalesce("_base", none), own)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("places.share"), F.lit(0.0))).alias("score"), "places")


def _idf(total: int, df: int) -> float:
    return math.log((total + 1) / (df + 1)) + 0.1  # a word of every document still weighs a little


def _aligned(candidates: DataFrame, idf: dict[str, float], least_share: float) -> DataFrame:
    """(_row, places): templates whose rare words stand in place, verified by their key phrases."""
    spark = candidates.sparkSession
    mass = [sum(idf[w] for w, t, _ in _POSTINGS if t == k) for k in range(len(TEMPLATES))]
    keys = [notice.split() for _, _, notice in TEMPLATES]
    key_at = [next(i for i in range(len(n)) if n[i : i + len(p.split())] == p.split()) for n, (_, p, _) in zip(keys, TEMPLATES, strict=True)]
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("part", T.DoubleType())])
    postings = spark.createDataFrame([(w, t, i, idf[w] / mass[t]) for w, t, i in _POSTINGS], schema)  # a fixed table
    hits = (
        candidates.select("_row", F.posexplode("_words").alias("_at", "word"))
        .join(F.broadcast(postings), "word")
        .groupBy("_row", "template", (F.col("_at") - F.col("place")).alias("_offset"))
        .agg(F.sum("part").alias("share"))
        .where(F.col("share") >= least_share - 1e-9)
    )
    verified = F.lit(False)
    for t, (_, phrase, _) in enumerate(TEMPLATES):
        verified = F.when(F.col("template") == t, _at(F.col("_words"), F.col("_offset") + key_at[t], phrase)).otherwise(verified)
    label = F.element_at(F.array(*[F.lit(name) for name, _, _ in TEMPLATES]), F.col("template") + 1)
    found = hits.join(candidates.select("_row", "_words"), "_row").where(F.col("_offset") + F.lit(0) >= -len(max(keys, key=len))).where(verified)
    best = found.groupBy("_row", label.alias("label")).agg(F.min(F.greatest("_offset", F.lit(0))).cast("long").alias("first_word"), F.max(F.round(F.least("share", F.lit(1.0)), 9)).alias("share"))
    return best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("label", "first_word", "share"))).alias("places"))  # at most one a label


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("places")
