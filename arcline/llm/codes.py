"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, found by exponion search.

A codebook of ``entries`` whole-number points is kept for each part position.  A round assigns every part to its nearest entry and moves each entry
to the floored mean of its parts.  For a part x that had entry a before, with A = |x - a|^2, whatever is as near as a lies within
2 * sqrt(A) of a; so only that much of a's list of entries, sorted by distance from a, is scanned, and the radius shrinks to
sqrt(A) + sqrt(B) once an entry at distance sqrt(B) is found.  Distances are whole numbers and ties go to the smaller index.

Rows are scanned where they lie.  Sums of parts are grouped by (part, entry) with partial sums, so a codebook, whose size is a parameter, is all
that passes through the driver.  Rows and their entries are written each round and the round before goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import INT, LONG, list_array, looked_up, read, release, stage, staged, struct, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that a task works on at a time, and entries of a neighbour list.
ROWS, SCAN = 1 << 15, 16


def integer_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<long>): floor(scale * x) of each component; without a ``label`` column that is null.

    Left out: vectors that are null or empty or hold null or non-finite components.
    """
    x = F.col("v")
    rows = vectors.select(F.col(key).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)).withColumn("v", F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def edges(width: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``width`` components begin, and the end: equal parts if ``parts`` divides it, else nearly so."""
    return [width * p // parts for p in range(parts + 1)]


class Book:
    """The entries of one part position, with each entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.norms = (entries * entries).sum(axis=1)
        between = self.norms[:, None] + self.norms[None, :] - 2 * (entries @ entries.T)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.gaps = np.take_along_axis(between, self.near, axis=1)

    def first(self, x: np.ndarray) -> np.ndarray:
        """A start for parts without an entry: the nearest of every SCAN-th entry."""
        some = np.arange(0, len(self.entries), SCAN)
        return some[np.argmin(self.norms[some][None, :] - 2 * (x @ self.entries[some].T), axis=1)]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry, the smallest of several, and the squared distance, from any ``start``."""
        size = (x * x).sum(axis=1)
        away = ((x - self.entries[start]) ** 2).sum(axis=1)
        best, least = start.copy(), away.copy()
        order = np.argsort(start, kind="stable")
        for a, rows in zip(*_groups(start[order], order), strict=True):
            gaps, near = self.gaps[a], self.near[a]
            reach = np.searchsorted(gaps, 4 * away[rows], "right")
            for k in range(0, len(near), SCAN):
                open_ = reach > k
                rows, reach = rows[open_], reach[open_]
                if not len(rows):
                    break
                some = np.sort(near[k : k + SCAN])
                d = size[rows, None] + self.norms[some] - 2 * (x[rows] @ self.entries[some].T)
                j = np.argmin(d, axis=1)
                d, j = d[np.arange(len(rows)), j], some[j]
                better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
                moved = rows[better]
                best[moved], least[moved] = j[better], d[better]
                radius = np.sqrt(away[rows].astype(np.float64)) + np.sqrt(least[rows].astype(np.float64))
                # rounded up: an entry more is scanned rather than one less
                reach = np.minimum(reach, np.searchsorted(gaps, radius * radius * (1 + 1e-9) + 1, "right"))
        return best, least


def _groups(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, begin = np.unique(values, return_index=True)
    return distinct, np.split(order, begin[1:])


def _assign(rows: DataFrame, books: list[np.ndarray], exact: bool) -> DataFrame:
    """``rows`` (vec_id, label, v and, from the second round on, codes) with their codes and error anew."""
    schema = T.StructType([f for f in rows.schema if f.name in ("vec_id", "label", "v")]).add("codes", T.ArrayType(INT)).add("error", LONG)
    again = "codes" in rows.columns
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if exact else np.int64  # products of doubles are much faster, and whole below 2^53
        own = [Book(b.astype(kind)) for b in books]
        for table in _chunks(batches):
            v = _matrix(table.column("v")).astype(kind)
            before = _matrix(table.column("codes")) if again else None
            codes, error = np.empty((len(v), len(own)), np.int32), np.zeros(len(v), np.int64)
            for p, book in enumerate(own):
                x = np.ascontiguousarray(v[:, cuts[p] : cuts[p + 1]])
                index, away = book.nearest(x, before[:, p].astype(np.int64) if again else book.first(x))
                codes[:, p] = index
                error += away.astype(np.int64)
            columns = [table.column(n).combine_chunks() for n in ("vec_id", "label", "v")]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, list_array(pa.array(codes.ravel()), np.full(len(v), len(own))), pa.array(error)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in column.chunks if len(c)])


def _moved(assigned: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry at the floored mean of its parts; one without parts stays."""
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])
    cut = lambda p: F.slice("v", int(cuts[p]) + 1, books[p].shape[1])
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.get("codes", F.lit(p)).alias("entry"), cut(p).alias("x")) for p in range(len(books))])
    width = max(b.shape[1] for b in books)
    sums = assigned.select(F.inline(parts)).groupBy("part", "entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most parts * entries rows
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(out[r["part"]].shape[1])]
    return out


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors`` (vec_id, label, v, as of ``integer_vectors``) as (vec_id, label, codes array<int>, error), staged, and the codebooks.

    The codebooks start as the parts of the ``entries`` vectors of smallest vec_id (nulls last, equal ids by components) and move ``rounds``
    times; error is the sum of squared distances from the entries at the end.  Each row counts, repeated ones and those without a vec_id too;
    equal entries leave their parts to the first of them.  Vectors whose length isn't that of the smallest vec_id are left out.
    Only the three columns are read.  An empty table gives no rows and no codebooks.  Squared distances have to fit a long, else it is an error.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.select("vec_id", "label", "v"), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return stage(rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), "codes"), []
    rows = rows.where(F.size("v") == len(first[0].v))
    start = np.array([r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64)
    most = rows.agg(F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v")))).first()[0]
    cuts = edges(start.shape[1], parts)
    bound = max(1, start.shape[1]) * 16 * max(1, most) ** 2
    if bound >= 1 << 62:
        raise ValueError("squared distances of these vectors don't fit a long: use a smaller scale")
    books = [start[:, b:e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds):
        before = staged()
        rows = stage(_assign(rows, books, bound < 1 << 53), "assigned")
        books = _moved(rows, books)
        release(spark, before)
    return stage(_assign(rows, books, bound < 1 << 53).drop("v"), "codes"), books


def restored(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` (with codes array<int>) and the vector v that they stand for; null codes give null."""
    held = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    return codes.withColumn("v", F.flatten(F.transform("codes", lambda c, p: F.element_at(F.element_at(held, p + 1), c + 1))))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def with_group_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` (staged) with the sum of ``value`` over the rows of an equal ``key``, nulls together."""
    return looked_up(rows, stage(rows.groupBy(key).agg(F.sum(value).alias(name)), "sums"), [key])


def _hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code.cast("long")), 2, "0"))


@tidy
def _coded(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    rows = codes.select("vec_id", "label", F.array_join(F.transform("codes", _hex), "").alias("code"), "error")
    return with_group_sum(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return _coded(integer_vectors(read(spark, sf_dir, "embeddings")))


def _rounds_sql() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT i, part, min(d * {ENTRIES} + entry) AS best FROM
    (SELECT x.i, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d FROM x JOIN b{r} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.entry, b.part, b.pos, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN
    (SELECT a.best % {ENTRIES} AS entry, x.part, x.pos, CAST(floor(sum(x.c) / count(*)) AS BIGINT) AS c FROM a{r} a JOIN x USING (i, part) GROUP BY ALL) m USING (entry, part, pos))""")
    return ",\n".join(out)


#: Vectors whose length four divides, as the tables have them.
OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS i, vec_id, label, v FROM
    (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
     WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (SELECT i, (k - 1) * {PARTS} // n AS part, (k - 1) % (n // {PARTS}) AS pos, c FROM (SELECT i, unnest(v) AS c, generate_subscripts(v, 1) AS k, len(v) AS n FROM e)),
b0 AS MATERIALIZED (SELECT i - 1 AS entry, part, pos, c FROM x WHERE i <= {ENTRIES}),
{_rounds_sql()},
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT i, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN e USING (i), books
"""
