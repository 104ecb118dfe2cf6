"""Vector codes against brute force in whole numbers, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """(rows with codes and errors, codebooks) of (vec_id, components, label), entry by entry in Python's whole numbers."""
    kept = [(i, tuple(math.floor(codes.SCALE * x) for x in v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    cuts = codes.edges(len(kept[0][1]), parts)
    books = [[r[1][b:e] for r in kept[:entries]] for b, e in zip(cuts, cuts[1:], strict=False)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for n in range(rounds + 1):
        found = [[nearest(r[1][cuts[p] : cuts[p + 1]], books[p]) for p in range(parts)] for r in kept]
        if n < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [r[1][cuts[p] : cuts[p + 1]] for r, f in zip(kept, found, strict=True) if f[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    return [(r[0], r[2], [k for _, k in f], sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)], books


@pytest.mark.parametrize(("n", "dim", "entries", "spread"), [(300, 8, 40, 1.0), (120, 7, 16, 1.0), (90, 2, 256, 0.01), (400, 12, 24, 30.0), (60, 4, 4, 5e4)])
def test_codes_equal_brute_force(spark, n, dim, entries, spread):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([None, 1, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(40)]  # copies
    rows += [(5, rows[9][1], 2), (None, rows[9][1], None), (7, rows[7][1], 1)]  # repeated and null ids
    rows += [(900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 1), (903, [], 1), (904, [1.0], 1), (905, [float("-inf")] * dim, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("clash"), "codes": F.lit(3), "entry": F.lit(None)}).repartition(3)
    got, books = codes.compress(codes.integer_vectors(df), entries=entries)
    want, want_books = brute(rows, entries=entries)
    assert [[tuple(e) for e in b.tolist()] for b in books] == [[tuple(e) for e in b] for b in want_books]
    assert sorted(map(repr, ((r.vec_id, r.label, list(r.codes), r.error) for r in got.collect()))) == sorted(map(repr, want))


def test_restored_vectors_are_as_far_as_the_error_says(spark):
    rng = random.Random(2)
    vectors = codes.integer_vectors(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(50)], SCHEMA))
    coded, books = codes.compress(vectors, entries=8)
    back = {r.vec_id: (r.v, r.error) for r in codes.restored(coded, books).collect()}
    for r in vectors.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, back[r.vec_id][0], strict=True)) == back[r.vec_id][1]


def test_scan_from_any_start_finds_the_smallest_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-9, 9, (64, 3))
    entries[40:50] = entries[7]
    x = rng.integers(-9, 9, (500, 3))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for start in (np.zeros(500, np.int64), rng.integers(0, 64, 500), np.full(500, 49)):
        for kind in (np.float64, np.int64):
            index, away = codes.Book(entries.astype(kind)).nearest(x.astype(kind), start)
            assert (index == d.argmin(axis=1)).all() and (away == d.min(axis=1)).all()


def test_no_vectors_give_no_codes(spark):
    for rows in ([], [(1, None, 2)]):
        got, books = codes.compress(codes.integer_vectors(spark.createDataFrame(rows, SCHEMA)))
        assert got.count() == 0 and books == [] and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_vectors_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="smaller scale"):
        codes.compress(codes.integer_vectors(spark.createDataFrame([(1, [1e12, 0.0], 2)], SCHEMA)))


@pytest.mark.parametrize("hot", [0, 900])
def test_sums_of_hot_and_rare_labels(spark, hot):
    rng = random.Random(5)
    rows = [(i, None if i % 11 == 0 else 1 if i < hot else rng.randrange(3000), i) for i in range(2500)]
    want = {}
    for _, k, v in rows:
        want[k] = want.get(k, 0) + v
    got = codes.with_group_sum(spark.createDataFrame(rows, "i long, k int, v long"), "k", "v", "s").collect()
    assert sorted((r.i, r.s) for r in got) == [(i, want[k]) for i, k, _ in rows]
