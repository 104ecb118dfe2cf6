"""N-gram Jaccard join by MinHash banding, with pairs verified on full n-gram sets.

1. Each text becomes its set of word n-grams (64-bit hashes); texts of equal sets form a class, and only one of a class goes on.
   From the set come minwise values, in ``bands`` bands of ``rows`` rows: rows are chosen so that few pairs far below the threshold meet,
   bands so that a pair at the threshold meets with probability ``recall``.
2. Band hashes are shuffled; a class is tied to the smallest class of each of its buckets, and the ties' components are clusters.
3. A cluster is cut into blocks by its number of classes and the size of their sets.  Each full set travels once, to its block, where it meets the
   cluster's centre: the n-grams that more than half of the classes of one block hold.  A set a is then its difference from the centre, d(a), and

       |a & b| = (|a| + |b| - |d(a)| - |d(b)|) / 2 + |d(a) & d(b)|,

   so with gap(a) = (up + down) * |d(a)| - (down - up) * |a| two classes are linked exactly if gap(a) + gap(b) <= 2 * (up + down) * |d(a) & d(b)|.
4. Pairs with gap(a) + gap(b) <= 0 are linked whatever they share: they are counted by running sums over the cluster's gaps, without a
   pair.  Others have to share differences: within a block they are counted at once; across blocks only the differences of classes that can have such
   a partner travel, to strips.  A strip holds one block and streams the others past it, and gives a row for each of its classes.
5. Blocks give trees, and only links between different trees are passed on; their components are the final classes.

Rows and sets that are shuffled therefore grow with the cluster; only differences of classes far from the centre go to several strips.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import BINARY, LONG, Words, constants, key_filter, list_array, read, splitmix, stage, struct, text_slices, tidy, window_hashes, with_maybe
from arcline.llm.components import components

NGRAM, SIMILARITY, RECALL = 5, (4, 5), 0.995
#: A block has about so many classes, and so many bytes of n-grams besides one set, at most.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def bands_and_rows(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Most rows a band, and then fewest bands, with 1 - (1 - s^rows)^bands >= recall and at most ``most`` minwise values."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("this recall needs more minwise values")


def _sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each text's n-gram hashes, sorted and distinct; a text of fewer words, but not none, has one n-gram of them all."""
    whole = window_hashes(words.hashes, n)
    for b, e in zip(words.first[:-1], words.first[1:], strict=True):
        if e - b >= n:
            yield np.unique(whole[b : e - n + 1])
        elif e > b:
            yield window_hashes(words.hashes[b:e], int(e - b))
        else:
            yield np.zeros(0, np.uint64)


def _key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(docs: DataFrame, *, text: str = "text", ngram: int = NGRAM, bands: int, rows: int) -> DataFrame:
    """(doc_id, class_key, size, bands array<long>) for each row: null key, size 0 and no bands where there are no words."""
    schema = struct(doc_id=docs.schema["doc_id"].dataType, class_key=BINARY, size=LONG, bands=T.ArrayType(LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = (constants(41, bands * rows) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        shift = (constants(43, bands * rows) >> np.uint64(32)).astype(np.uint32)
        within = constants(47, rows)
        for batch in batches:
            keys: list[bytes | None] = []
            values, counts, sizes = [], [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                sets = list(_sets(Words(data, offsets), ngram))
                keys += [_key(s) for s in sets]
                full = [s for s in sets if len(s)]
                counts += [bands if len(s) else 0 for s in sets]
                sizes += [len(s) for s in sets]
                if not full:
                    continue
                grams = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
                begin = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                least = np.empty((len(full), bands * rows), np.uint64)
                for j in range(bands * rows):
                    least[:, j] = np.minimum.reduceat(grams * step[j] + shift[j], begin)
                with np.errstate(over="ignore"):
                    banded = (splitmix(least.reshape(len(full), bands, rows)) * within).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                values.append(splitmix(banded).view(np.int64).ravel())
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), list_array(flat, np.array(counts, np.int64))], names=schema.fieldNames())

    return docs.select("doc_id", text).mapInArrow(run, schema)


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    """The n-grams that more than half of the sets hold.  Any set would give right results; this one is close to most."""
    return pd.DataFrame({"component": pdf["component"].iloc[:1], "_blocks": pdf["_blocks"].iloc[:1], "centre": [_majority([np.frombuffer(x, np.uint64) for x in pdf["grams"]]).tobytes()]})


def _majority(sets: list[np.ndarray]) -> np.ndarray:
    every, n = np.unique(np.concatenate(sets), return_counts=True)
    return every[2 * n > len(sets)]


class _Sorted:
    """The elements of several sets in order, and whose each is."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]


def _shared(a: _Sorted, b: _Sorted) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``.

    An element that few pairs share adds to those pairs; one that many share is a column of two incidence matrices, which are multiplied some columns at a time.
    """
    out = np.zeros(a.n * b.n, np.int64)
    keys, first_a, n_a = np.unique(a.every, return_index=True, return_counts=True)
    at = np.searchsorted(b.every, keys, "left")
    n_b = np.searchsorted(b.every, keys, "right") - at
    pairs = n_a * n_b
    many = pairs > max(64, a.n * b.n // 512)
    few = np.flatnonzero((pairs > 0) & ~many)
    edges = np.searchsorted(np.cumsum(pairs[few]), np.arange(0, int(pairs[few].sum()) + 1, 1 << 22), "right") if len(few) else []
    for k in np.split(few, np.unique(edges)) if len(few) else []:
        p = pairs[k]
        place = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
        i = a.owner[np.repeat(first_a[k], p) + place // np.repeat(n_b[k], p)]
        j = b.owner[np.repeat(at[k], p) + place % np.repeat(n_b[k], p)]
        out += np.bincount(i * b.n + j, minlength=len(out))
    out = out.reshape(a.n, b.n)
    hot = np.flatnonzero(many)
    for lo in range(0, len(hot), 4096):
        k = hot[lo : lo + 4096]
        left, right = np.zeros((a.n, len(k)), np.float32), np.zeros((b.n, len(k)), np.float32)
        for m, x, start, n in ((left, a, first_a[k], n_a[k]), (right, b, at[k], n_b[k])):
            column = np.repeat(np.arange(len(k)), n)
            m[x.owner[np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)], column] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def _block(similarity: tuple[int, int]):
    """A block's classes against the centre and against each other."""
    up, down = similarity

    def run(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class_key").reset_index(drop=True)  # rows that repeat a doc_id and its text come twice
        if not len(pdf):
            return pd.DataFrame([], columns=list(_MEMBER))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        one = pdf["_blocks"].iloc[0] == 1
        centre = _majority(sets) if one else np.frombuffer(centres["centre"].iloc[0], np.uint64)
        apart = [np.setxor1d(s, centre, assume_unique=True) for s in sets]
        gap = np.array([(up + down) * len(d) - (down - up) * len(s) for d, s in zip(apart, sets, strict=True)])
        every = _Sorted(apart)
        both = gap[:, None] + gap[None, :]
        linked = both <= 2 * (up + down) * _shared(every, every)
        np.fill_diagonal(linked, False)
        keys = pdf["class_key"].to_numpy()
        counted = linked if one else linked & (both > 0)  # what running sums over the cluster count is left to them
        return pd.DataFrame({
            "class_key": keys, "component": pdf["component"], "_blocks": pdf["_blocks"], "own_block": pdf["own_block"], "copies": pdf["copies"], "gap": gap, "root": keys[_trees(linked)],
            "links": counted @ pdf["copies"].to_numpy(), "apart": [None if one else d.tobytes() for d in apart]})

    return run


_MEMBER = {"class_key": "binary", "component": "binary", "_blocks": "int", "own_block": "int", "copies": "long", "gap": "long", "root": "binary", "links": "long", "apart": "binary"}


def _trees(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each can reach."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _strips(similarity: tuple[int, int]):
    """Streams (component, strip, other, class_key, own_block, copies, gap, root, apart), sorted by the first three: a strip's own classes, then all others.

    Gives (a, b, links): the links of each of a strip's classes a, b null; and links between trees a and b, a forest of them for each strip.
    """
    up, down = similarity

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            pdf = batch.to_pandas()
            for key, part in pdf.groupby(["component", "strip", "other"], sort=False):
                for lo in range(0, len(part), 1024):
                    yield key, part.iloc[lo : lo + 1024]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            if state is not None:
                own, links, forest = state[0], state[2], state[3]
                ties = [(k, v) for k, v in forest.items() if k != v]
                yield pa.RecordBatch.from_arrays([pa.array([*own["class_key"], *(k for k, _ in ties)], pa.binary()), pa.array([None] * len(own) + [v for _, v in ties], pa.binary()), pa.array([*links, *[0] * len(ties)], pa.int64())], names=["a", "b", "links"])

        def opened() -> tuple:
            own = pd.concat(held).drop_duplicates("class_key").reset_index(drop=True)
            return own, _Sorted([np.frombuffer(x, np.uint64) for x in own["apart"]]), np.zeros(len(own), np.int64), {}

        for (component, strip, other), part in rows_of(batches):
            if (component, strip) != at:
                if held:  # a strip that no other class has met
                    state = opened()
                    for k in held:
                        _meet(state, k, up, down)
                yield from settled()
                at, held, state = (component, strip), [], None
            if not other:
                held.append(part)
                continue
            if state is None:
                state = opened()
                for k in held:
                    _meet(state, k, up, down)
                held = []
            _meet(state, part, up, down)
        if held:
            state = opened()
            for k in held:
                _meet(state, k, up, down)
        yield from settled()

    return run


def _meet(state: tuple, part: pd.DataFrame, up: int, down: int) -> None:
    """Count the links of a strip's classes with those of ``part`` that neither blocks nor running sums have counted."""
    own, held, links, forest = state
    part = part.drop_duplicates("class_key")
    both = own["gap"].to_numpy()[:, None] + part["gap"].to_numpy()[None, :]
    linked = (both > 0) & (own["own_block"].to_numpy()[:, None] != part["own_block"].to_numpy()[None, :])
    linked &= both <= 2 * (up + down) * _shared(held, _Sorted([np.frombuffer(x, np.uint64) for x in part["apart"]]))
    links += linked @ part["copies"].to_numpy()
    left, right = own["root"].to_numpy(), part["root"].to_numpy()
    (a, a_of), (b, b_of) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)

    def top(x: bytes) -> bytes:
        while forest.setdefault(x, x) != x:
            forest[x] = forest[forest[x]]
            x = forest[x]
        return x

    i, j = np.nonzero(linked & (own["gap"].to_numpy()[:, None] >= part["gap"].to_numpy()[None, :]))  # the other strip has the rest
    for code in np.unique(a_of.ravel()[i] * len(b) + b_of.ravel()[j]):
        x, y = sorted((top(a[code // len(b)]), top(b[code % len(b)])))
        forest[y] = x


@tidy
def join(docs: DataFrame, *, text: str = "text", ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, ``text``): a row per document.

    Returns doc_id; class_id, the smallest doc_id among the documents connected with it by links (pairs whose n-gram sets have
    a Jaccard similarity of ``similarity`` or more, copies included); copy_id, the smallest doc_id of its copies (equal n-gram
    sets); copies, their number; n_links, the number of other documents that it is linked with.  Words are lower-cased runs of
    digits, letters and characters beyond ASCII.  Documents without words (null, empty, only signs) link with none: their class
    and copy ids are their own.  Repeated rows are copies.  Rows without doc_id take part, and give a null id to a class of only such.
    Very long texts are taken whole; one set of theirs is the least that a block holds.  Other columns, whatever their names, are not read and not
    returned.  An empty table gives no rows.
    """
    bands, rows = bands_and_rows(similarity[0] / similarity[1], recall)
    signed = stage(signatures(docs, text=text, ngram=ngram, bands=bands, rows=rows), "signatures")
    groups = signed.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = stage(groups, "classes")

    banded = classes.select("class_key", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(F.min("class_key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = stage(buckets, "buckets")
    likely = with_maybe(banded, "bucket", key_filter(buckets, "bucket")).where("_maybe").drop("_maybe")
    ties = likely.join(buckets, ["band", "bucket"]).select(F.col("class_key").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    clusters = components(ties)

    placed = stage(clusters.withColumnRenamed("node", "class_key").join(classes.drop("bands"), "class_key"), "placed")
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("size") / block_bytes)).cast("int").alias("_blocks"))
    placed = placed.join(stage(sizes, "sizes"), "component").withColumn("own_block", F.pmod(F.xxhash64("class_key"), F.col("_blocks")).cast("int"))
    placed = stage(placed.select("class_key", "component", "_blocks", "own_block", "copy_id", "copies"), "placed")

    first = _full_sets(docs, placed.where("_blocks > 1 and own_block = 0"), text, ngram)
    centres = stage(first.groupBy("component").applyInPandas(_centre, "component binary, _blocks int, centre binary"), "centres")
    everywhere = centres.select("component", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("own_block"), "centre")
    keys = ["component", "own_block"]
    members = _full_sets(docs, placed, text, ngram).groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInPandas(_block(similarity), ", ".join(f"{k} {v}" for k, v in _MEMBER.items()))
    members = stage(members, "members")
    links, ties = _across(members.where("_blocks > 1"), similarity, block, block_bytes)
    links = members.where("_blocks = 1").select("class_key", "links").union(links)

    final = components(ties)
    ids = classes.select("class_key", "copy_id", "copies").join(members.select("class_key", "root"), "class_key", "left")
    ids = ids.join(final, ids["root"] == final["node"], "left").withColumn("component", F.coalesce("component", "root", "class_key"))
    ids = stage(ids.select("class_key", "copy_id", "copies", "component").join(links, "class_key", "left"), "ids")
    smallest = stage(ids.groupBy("component").agg(F.min("copy_id").alias("class_id")), "smallest")
    ids = ids.join(smallest, "component")
    out = signed.select("doc_id", "class_key").join(stage(ids, "ids"), "class_key", "left")
    alone = F.col("class_key").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"))


def _across(members: DataFrame, similarity: tuple[int, int], block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(class_key, links) of the classes of clusters of several blocks, and links between their trees (a, b)."""
    up, down = similarity
    by_gap = stage(members.groupBy("component", "gap").agg(F.sum("copies").alias("n")), "gaps")  # as many rows as there are gaps, not classes
    asked = by_gap.select("component", F.col("gap").alias("at"), "n", F.lit(0).alias("asks")).union(by_gap.select("component", -F.col("gap"), F.lit(0).cast("long"), F.lit(1)))
    upto = Window.partitionBy("component").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    sums = stage(asked.withColumn("sure", F.sum("n").over(upto)).where("asks = 1").select("component", (-F.col("at")).alias("gap"), "sure"), "sure")
    ends = stage(members.groupBy("component").agg(F.max("gap").alias("_most"), F.min(F.struct("gap", "class_key", "root")).alias("_best")), "ends")

    placed = members.join(ends, "component")
    hung = placed.where(F.col("gap") + F.col("_best.gap") <= 0).select(F.col("root").alias("a"), F.col("_best.root").alias("b")).where("a <> b").distinct()
    some = placed.where((F.col("gap") > -F.col("_most")) & (F.length("apart") > 0)).withColumn("root", F.when(F.col("gap") + F.col("_best.gap") <= 0, F.col("_best.root")).otherwise(F.col("root")))
    some = some.drop("_most", "_best", "_blocks", "links")
    some = stage(some, "apart")
    strips = some.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / (4 * block)), F.ceil(F.sum(F.length("apart")) / block_bytes)).cast("int").alias("_strips"))
    dealt = some.join(stage(strips, "strips"), "component").withColumn("_own", F.pmod(F.xxhash64(F.lit(3), "class_key"), F.col("_strips")))
    dealt = dealt.select("component", F.explode(F.sequence(F.lit(0), F.col("_strips") - 1)).alias("strip"), "_own", "class_key", "own_block", "copies", "gap", "root", "apart")
    dealt = dealt.withColumn("other", (F.col("strip") != F.col("_own")).cast("int")).drop("_own").repartition("component", "strip").sortWithinPartitions("component", "strip", "other")
    found = stage(dealt.mapInArrow(_strips(similarity), "a binary, b binary, links long"), "found")

    sure = members.join(sums, ["component", "gap"]).select("class_key", (F.col("links") + F.col("sure") - F.when(F.col("gap") <= 0, F.col("copies")).otherwise(0)).alias("links"))
    links = sure.union(found.where("b is null").select(F.col("a").alias("class_key"), "links")).groupBy("class_key").agg(F.sum("links").alias("links"))
    return links, hung.union(found.where("b is not null").select("a", "b"))


def _full_sets(docs: DataFrame, placed: DataFrame, text: str, ngram: int) -> DataFrame:
    """``placed`` classes with the n-gram set of one document of each; of rows that share its doc_id those of its text count."""
    d = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"))
    d = with_maybe(d, "_id", key_filter(placed, "copy_id")).where("_maybe").drop("_maybe")
    rows = placed.join(d, placed["copy_id"].eqNullSafe(d["_id"])).drop("_id")
    kept = [c for c in placed.columns if c != "copy_id"]
    schema = T.StructType([*[placed.schema[c] for c in kept], T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(kept.index("class_key"))
            for lo, hi, data, offsets in text_slices(batch.column(len(kept))):
                grams = [s.tobytes() if _key(s) == keys[lo + i].as_py() else None for i, s in enumerate(_sets(Words(data, offsets), ngram))]
                made = pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), pa.array(grams, pa.binary())], names=[*kept, "grams"])
                yield made.filter(pc.is_valid(made.column(len(kept))))

    return rows.select(*kept, "_text").mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
