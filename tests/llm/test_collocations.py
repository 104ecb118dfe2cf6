"""Phrases against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import collocations
from arcline.llm.common import looked_up, scratch, stage

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            f.update(("und" if lang is None else lang, tuple(w[b : b + k])) for k in range(1, words + 1) for b in range(len(w) - k + 1))
    held = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = Counter()
    for (lang, g), a in held.items():
        for k in range(2, len(g)):
            for b in range(len(g) - k + 1):
                longer[lang, g[b : b + k]] = max(longer[lang, g[b : b + k]], a)
    out = []
    for (lang, g), a in held.items():
        if 100 * longer[lang, g] < covered * a:
            score, _, left, right = min((1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    return [(r[0], rank[r[0]], *r[1:]) for r in out if not rank.update([r[0]]) and rank[r[0]] <= top]


def mined(df, **parameters):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(df, **parameters).collect())


def made_up(n, seed, vocabulary="a b c d e f Ab aB é É K İ x1 - 'n"):
    rng, names = random.Random(seed), vocabulary.split()
    text = lambda: "".join(rng.choices(names, [2.0**-i for i in range(len(names))])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for _ in range(rng.randrange(60)))
    return [(i, text(), rng.choice(["en", "en", "en", "de", None, "und", ""])) for i in range(n)]


ODD = [(900, None, "en"), (901, "", "en"), (902, " \t\n.,;", None), (903, "a b " * 30_000, "en"), (904, "x" * 50_000, "de"), (905, ("y" * 3000 + " z ") * 12, "de"), (906, "\x00 \x00   a b " * 12, "fr"), (907, "a b c. " * 40, "hot")]


@pytest.mark.parametrize(("words", "least", "covered", "top"), [(3, 10, 50, 2000), (2, 3, 50, 5), (4, 4, 80, 2000), (3, 10, 200, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, words, least, covered, top):
    monkeypatch.setattr(collocations, "BUCKET_GRAMS", 40_000)
    rows = made_up(300, words) + ODD
    rows += rows[:40]  # repeated
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("clash"), "gram": F.lit(1), "w0": F.lit(2), "times": F.lit("x"), "a": F.lit(None)}).repartition(3)
    assert mined(df, words=words, least=least, covered=covered, top=top) == brute(rows, words, least, covered, top)


def test_a_full_bitmap_and_small_sums_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_frequent", lambda counted, n: np.full(collocations._BITS // 8, 255, np.uint8))
    monkeypatch.setattr(collocations, "GRAMS", 50)
    rows = made_up(120, 9)
    assert mined(spark.createDataFrame(rows, SCHEMA), least=4) == brute(rows, least=4)


def test_covered_phrases_go_even_if_what_covers_them_goes(spark):
    rows = [(i, "p q r s", "en") for i in range(12)] + [(50 + i, "p q", "en") for i in range(12)] + [(90, "p q", "en")]
    got = {r[2] for r in mined(spark.createDataFrame(rows, SCHEMA), words=4)}
    assert got == {"p q r s", "p q"}  # 12 of 25 is less than half; q r, r s, p q r and q r s are covered


def test_no_rows_no_phrases(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        assert mined(spark.createDataFrame(rows, SCHEMA)) == []


@pytest.mark.parametrize(("a", "left", "right"), [(10, 10, 10), (3 * 10**9, 5 * 10**9, 7 * 10**9), (10**13 + 7, 10**13 + 9, 2 * 10**13), (7, 10**12, 10**12)])
def test_scores_are_exact_beyond_64_bits(spark, a, left, right):
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"), 10**6).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_pieces_are_held_once(spark):
    rows = [(i, "One two.  one\ttwo ;ONE TWO", "en") for i in range(50)]
    got = {(r.piece, r.n_words, r.times) for r in collocations.pieces(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("one two", 2, 150)}


def test_hot_keys_are_answered_by_broadcast(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{rng.randrange(900)}") for i in range(3000)]
    table = {k: len(repr(k)) for k in {k for _, k in rows if k != "k7"}}
    with scratch(spark):
        asked = stage(spark.createDataFrame(rows, "i long, k string"), "asked")
        out = looked_up(asked, spark.createDataFrame(list(table.items()), "k string, size long"), ["k"])
        assert sorted((r.i, r.size) for r in out.collect()) == [(i, table[k]) for i, k in rows if k in table]
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
