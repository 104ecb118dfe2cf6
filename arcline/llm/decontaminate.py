"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, looked up in the word windows of every document.

Hits are verified word by word.  The benchmark's words are counted first.  Up to ``max_block_words`` words it is one broadcast and one
pass over the documents, without a shuffle.  A larger one is cut into blocks of that many words: each is a job of its own whose finds are written before its broadcast
is destroyed, so that one block is alive at a time, and only documents with finds are shuffled to merge them.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import BOOL, LONG, STRING, Words, carried, in_order, read, stage, struct, text_slices, window_hashes

NEW = struct(n_words=LONG, n_hit=LONG, n_items=LONG, item_ids=T.ArrayType(STRING), spans=T.ArrayType(struct(first=LONG, last=LONG)), contaminated=BOOL)
FOUND = "struct<n_words:bigint,item_ids:array<string>,spans:array<struct<first:bigint,last:bigint>>>"
WINDOW = 13


class _Index:
    """Windows of the items in arrays: below 50 bytes a window.

    For each length, in the order of their hashes: the hash, where the window's words begin among all items' words, and the item.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        raw = [text.encode("utf-8", "surrogatepass") for _, text in items]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.folded, self.vocabulary = words.folded, np.unique(words.hashes)
        self.starts, self.ends = words.starts.astype(np.uint32 if len(words.folded) < 2**32 else np.int64), words.ends.astype(np.uint32 if len(words.folded) < 2**32 else np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        own = np.array([number[item] for item, _ in items], np.int32)
        size = np.diff(words.first)
        for n in np.unique(np.minimum(size, window)).tolist():
            texts = np.flatnonzero(np.minimum(size, window) == n) if n else []
            if not n:
                continue
            count = size[texts] - n + 1
            begin = np.repeat(words.first[texts], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hashes, item = window_hashes(words.hashes, n, begin), np.repeat(own[texts], count)
            order = np.lexsort((item, hashes))
            hashes, item, begin = hashes[order], item[order], begin[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]) | ~self._same(begin[1:], begin[:-1], n)))
            self.by_length[n] = hashes[new], begin[new].astype(np.uint32 if len(words.hashes) < 2**32 else np.int64), item[new]

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from ``a`` are those from ``b``, of neighbours in hash order that mostly are not: compared only where lengths agree."""
        same = np.ones(len(a), bool)
        for j in range(n):
            same &= (self.ends[a + j] - self.starts[a + j]) == (self.ends[b + j] - self.starts[b + j])
        for k in np.flatnonzero(same):
            same[k] = self.text(int(a[k]), n) == self.text(int(b[k]), n)
        return same

    def text(self, k: int, n: int) -> bytes:
        return b" ".join(self.folded[self.starts[i] : self.ends[i]].tobytes() for i in range(k, k + n))

    def size(self) -> tuple[int, int]:
        """(windows, bytes)."""
        arrays = [self.folded, self.vocabulary, self.starts, self.ends, *(x for part in self.by_length.values() for x in part)]
        return sum(len(part[0]) for part in self.by_length.values()), sum(x.nbytes for x in arrays)

    def hits(self, words: Words) -> tuple[np.ndarray, list[tuple[int, set[str]]]]:
        """Which words are hit, and (word, items) for each window that occurs."""
        hit, occurring = np.zeros(len(words.hashes) + 1, np.int64), []
        if not len(self.vocabulary) or not len(words.hashes):
            return hit[:-1].astype(bool), occurring
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        missing = np.concatenate(([0], np.cumsum(self.vocabulary[at] != words.hashes)))
        text = np.searchsorted(words.first, np.arange(len(words.hashes)), "right") - 1
        for n, (hashes, begin, item) in self.by_length.items():
            if len(words.hashes) < n:
                continue
            start = np.flatnonzero((missing[n:] == missing[:-n]) & (text[n - 1 :] == text[: len(text) - n + 1]))
            if not len(start):
                continue
            value = window_hashes(words.hashes, n, start)
            lo, hi = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
            for i in np.flatnonzero(hi > lo):
                own = words.text(int(start[i]), n)
                items = {self.names[item[k]] for k in range(lo[i], hi[i]) if self.text(int(begin[k]), n) == own}
                if items:
                    occurring.append((int(start[i]), items))
                    hit[start[i]] += 1
                    hit[start[i] + n] -= 1
        return np.cumsum(hit)[:-1] > 0, occurring


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text, n): items in pieces of at most about ``most`` words that overlap by a window less a word, so no window is lost."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, most - window + 1)
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n = len(words.hashes)
                cuts = [(k, min(n, k + step + window - 1)) for k in range(0, max(1, n - window + 1), step)] if n else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cuts), pa.string()), pa.array([words.text(b, e - b).decode("utf-8", "surrogatepass") for b, e in cuts], pa.string()), pa.array([e - b for b, e in cuts], pa.int64())], names=["item_id", "text", "n"])

    return items.distinct().mapInArrow(run, "item_id string, text string, n long")


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", columns: list[str] | None = None, window: int = WINDOW, max_block_words: int = 1_000_000, share: int = 20) -> DataFrame:
    """Mark what ``docs`` hold of ``benchmark`` (item_id, text).

    Keeps ``columns`` (None: all; those named like a new one give way) and adds n_words, n_hit, n_items, item_ids (sorted strings),
    spans of hit words and contaminated (n_hit > 0 and share * n_hit >= n_words).  A window is ``window`` consecutive words of an
    item, or the whole of a shorter one.  Null and empty texts have no words and no hits, very long ones are taken whole; items without words have no windows; items
    that share an id count once and a null id reads ''.  Repeated documents are judged one by one; an empty table gives none.
    """
    spark = docs.sparkSession
    pieces = stage(_pieces(benchmark, window, max_block_words), "pieces")
    blocks = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / max_block_words))
    names, _ = carried(docs, NEW, columns)
    kept = [F.col(f"`{c}`") for c in names]
    if blocks == 1:
        index = spark.sparkContext.broadcast(_Index([(r.item_id, r.text) for r in pieces.collect()], window))
        return _judged(docs.select(*kept, _marker(index)(F.col(text)).alias("_found")), share)  # only texts go to Python, no text comes back
    ordered = in_order(pieces, [F.col("item_id"), F.col("text")], {"_before": "n"}, "pieces")
    ordered = stage(ordered.withColumn("_block", F.expr(f"_before div {max_block_words}")), "blocks")  # at most one piece more than max_block_words in each
    rows = stage(docs.select(*kept, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")), "documents")
    finds = []
    for block in range(blocks):
        index = spark.sparkContext.broadcast(_Index([(r.item_id, r.text) for r in ordered.where(F.col("_block") == block).collect()], window))
        found = rows.select("_row", _marker(index)(F.col("_text")).alias("_found"))
        finds.append(stage(found.where((F.size("_found.spans") > 0) | (F.lit(block) == 0)), "finds"))  # the first block's counts all words
        index.destroy()
    every = functools.reduce(DataFrame.unionByName, finds).groupBy("_row").agg(
        F.max("_found.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.item_ids")))).alias("item_ids"), F.flatten(F.collect_list("_found.spans")).alias("spans"))
    every = every.select("_row", F.struct("n_words", "item_ids", _joined("spans").alias("spans")).alias("_found"))
    return _judged(rows.join(every, "_row").drop("_row", "_text"), share)


def _joined(spans: str) -> Column:
    """Spans in order, those that touch or overlap as one."""
    step = lambda a, s: F.when((F.size(a) > 0) & (s["first"] <= F.try_element_at(a, F.lit(-1))["last"] + 1), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(a, F.lit(-1))["last"], s["last"]).alias("last"))))).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first:bigint,last:bigint>>"), step)


def _judged(found: DataFrame, share: int) -> DataFrame:
    n_hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"] + 1)
    out = found.withColumn("n_words", F.col("_found.n_words")).withColumn("n_hit", n_hit).withColumn("n_items", F.size("_found.item_ids").cast("long"))
    out = out.withColumn("item_ids", F.col("_found.item_ids")).withColumn("spans", F.col("_found.spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("_found")


def _marker(index):
    """A function of texts that gives what this block's index finds in them."""
    kind = pa.struct([("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])

    @F.arrow_udf(FOUND)
    def mark_texts(texts: pa.Array) -> pa.Array:
        n_words, spans, items = [], [], []
        for lo, hi, data, offsets in text_slices(texts):
            words = Words(data, offsets)
            hit, occurring = index.value.hits(words)
            n_words.extend(np.diff(words.first).tolist())
            at = [[] for _ in range(hi - lo)]
            got: list[set[str]] = [set() for _ in range(hi - lo)]
            if occurring:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for b, e in zip(edge[::2], edge[1::2], strict=True):
                    while b < e:  # a run of hits may go over from one text to the next
                        i = int(np.searchsorted(words.first, b, "right")) - 1
                        stop = min(e, int(words.first[i + 1]))
                        at[i].append({"first": int(b - words.first[i]), "last": int(stop - words.first[i]) - 1})
                        b = stop
                for k, found in occurring:
                    got[int(np.searchsorted(words.first, k, "right")) - 1] |= found
            spans += at
            items += got
        return pa.array([{"n_words": n, "item_ids": sorted(k), "spans": s} for n, k, s in zip(n_words, items, spans, strict=True)], kind)

    return mark_texts


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words out of ``marked``'s texts; what stood between the words that stay becomes one space where a span was cut.

    Null, empty and unmarked texts stay as they are; rows are cut one by one, repeated ones too, and other columns stay; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or not len(s):
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            kept, at = [], 0
            for x in s:
                kept.append(raw[at : words.starts[x["first"]]])
                at = int(words.ends[x["last"]])
            out.append(b" ".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    return marked.withColumn(text, cut(F.col(text), F.col("spans")))


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()


def op8(spark, sf_dir: str) -> DataFrame:
    marked = mark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: Windows are lists of words; both sides are cut into them and joined on equal windows, item lengths included.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bw),
lens AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT dw.r, dw.i, dw.n, bk.item_id FROM dw JOIN bk ON dw.n = bk.n AND array_to_string(dw.w[dw.i : dw.i + dw.n - 1], ' ') = bk.k),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""
