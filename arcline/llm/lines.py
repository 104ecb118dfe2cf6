"""Line dedup by a deletion-neighbourhood join, with an edit bound of one word.

A line's words are lower-cased runs of digits, letters and characters beyond ASCII.  Two lines are near when their word sequences are equal
or one insertion, deletion or replacement of a word apart.

1. Lines of equal words collapse to their earliest place, short ones too.
2. An edit leaves the first or the second half of the shorter line as it was, so a line is a candidate only if one of its half keys is
   another line's too: four keys a line, and counts of keys.
3. Candidates emit their deletion variants as hashed keys, those of the half that may have changed: (line without word i, i) finds
   replacements at i, for all lines with that key differ there only; (line without word i) finds the line that is exactly this.
4. Equal variants are joined through the earliest place of each key, so a group of n lines gives n links at most; a link's lines are
   compared word by word before it counts.
5. A line goes if an earlier line is near it; the earliest stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import FOLD, INT, LONG, Words, constants, key_filter, list_array, read, splitmix, stage, struct, text_slices, tidy, with_maybe

#: Lines of fewer words have no partner but an equal one; exact copies go from EXACT_WORDS on.
MIN_WORDS, EXACT_WORDS = 8, 1
PLACE = ["doc_id", "line_no"]


def _weights(n: int) -> np.ndarray:
    return constants(71, n)


class _Lines:
    """The lines of a text slice: the text, number and words of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words = Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        n_breaks = np.searchsorted(breaks, offsets)
        line = np.searchsorted(breaks, self.words.starts)  # line breaks before each word
        text = np.searchsorted(self.words.first, np.arange(len(line)), "right") - 1
        key = line + text  # a text's end is a break too
        self.begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.end = np.append(self.begin[1:], len(key)) if len(key) else self.begin
        self.text = text[self.begin] if len(key) else self.begin
        self.number = line[self.begin] - n_breaks[self.text] if len(key) else self.begin
        longest = int((self.end - self.begin).max(initial=0))
        self.by_place = _weights(longest + 1)
        with np.errstate(over="ignore"):
            at = np.arange(len(key)) - np.repeat(self.begin, self.end - self.begin)
            self.sum = np.concatenate(([np.uint64(0)], np.cumsum(self.words.hashes * self.by_place[at], dtype=np.uint64)))

    def _span(self, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.sum[e] - self.sum[b]

    def full(self, seed: int) -> np.ndarray:
        """A hash of each whole line."""
        with np.errstate(over="ignore"):
            return splitmix(self._span(self.begin, self.end) + (self.end - self.begin).astype(np.uint64) * constants(seed, 1)[0])

    def check(self) -> np.ndarray:
        """A second, unrelated hash of each whole line."""
        with np.errstate(over="ignore"):
            at = np.arange(len(self.words.hashes)) - np.repeat(self.begin, self.end - self.begin)
            mixed = splitmix(self.words.hashes ^ self.by_place[at])
            return splitmix(np.add.reduceat(mixed, self.begin)) if len(self.begin) else np.zeros(0, np.uint64)

    def halves(self) -> np.ndarray:
        """Four keys a line: for base lengths n and n - 1, the first base // 2 words and the last base - base // 2.

        The last words stand at other places in lines of other lengths, so they are hashed anew from their own start.
        """
        n = self.end - self.begin
        out = np.empty((len(n), 4), np.uint64)
        with np.errstate(over="ignore"):
            for k in (0, 1):
                base = n - k
                head = self._span(self.begin, self.begin + base // 2)
                tail = _tails(self.words.hashes, self.end - (base - base // 2), self.end, self.by_place)
                out[:, 2 * k] = splitmix(head + base.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
                out[:, 2 * k + 1] = splitmix(tail + base.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(2))
        return out


def _tails(hashes: np.ndarray, b: np.ndarray, e: np.ndarray, by_place: np.ndarray) -> np.ndarray:
    """Hash of words b .. e - 1 of each line, placed from 0."""
    n = e - b
    if not len(n):
        return np.zeros(0, np.uint64)
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.arange(int(n.sum())) - np.repeat(base, n)
    with np.errstate(over="ignore"):
        value = hashes[np.repeat(b, n) + at] * by_place[at]
    out = np.zeros(len(n), np.uint64)
    if len(value):
        out[n > 0] = np.add.reduceat(value, base[n > 0])
    return out


def line_table(docs: DataFrame, text: str, min_words: int, exact_words: int) -> DataFrame:
    """(doc_id, line_no, n, h1, h2, halves) for every line of ``exact_words`` words or more, halves empty below ``min_words``."""
    schema = struct(doc_id=docs.schema["doc_id"].dataType, line_no=INT, n=INT, h1=LONG, h2=LONG, halves=T.ArrayType(LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(1)):
                x = _Lines(data, offsets)
                n = x.end - x.begin
                keep = n >= exact_words
                if not keep.any():
                    continue
                halves = x.halves()[n >= max(min_words, exact_words)].view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(lo + x.text[keep])), pa.array(x.number[keep], pa.int32()), pa.array(n[keep], pa.int32()), pa.array(x.full(5)[keep].view(np.int64)),
                    pa.array(x.check()[keep].view(np.int64)), list_array(pa.array(halves), np.where(n[keep] >= min_words, 4, 0))], names=schema.fieldNames())

    return docs.select("doc_id", text).mapInArrow(run, schema)


def _with_lines(text: str, function: Callable[[Column], Column]) -> Column:
    """``function`` of a text's lines; as a lambda's variable the list is made once, not for each element that looks into it."""
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), function), F.lit(0))


def _variants(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, key, role) of candidate ``lines`` (doc_id, line_no, line, first, second), the halves that may differ.

    Roles: 0 the whole line, 1 the line without a word, 2 that and the word's place.
    """
    schema = struct(doc_id=lines.schema["doc_id"].dataType, line_no=INT, key=LONG, role=INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [column.to_numpy(zero_copy_only=False) for column in batch.columns[3:]]
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                by_place = _weights(int(np.diff(words.first).max(initial=0)) + 1)
                keys, roles, counts = [], [], []
                for i in range(hi - lo):
                    h = words.hashes[words.first[i] : words.first[i + 1]]
                    n = len(h)
                    place = np.arange(0 if halves[0][lo + i] else max(0, n - 1) // 2, n if halves[1][lo + i] else n - max(0, n - 1) // 2)
                    whole, without = _deletions(h, place, by_place)
                    with np.errstate(over="ignore"):
                        placed = splitmix(without + (place + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
                    keys += [np.array([whole]), without, placed]
                    roles.append(np.repeat([0, 1, 2], [1, len(place), len(place)]))
                    counts.append(len(roles[-1]))
                at = pa.array(np.repeat(np.arange(lo, hi), counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles), pa.int32())], names=schema.fieldNames())

    return lines.select("doc_id", "line_no", "line", "first", "second").mapInArrow(run, schema)


def _deletions(h: np.ndarray, place: np.ndarray, by_place: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """The hash of the line, and of the line without each word of ``place``."""
    n = len(h)
    with np.errstate(over="ignore"):
        ahead = np.concatenate(([np.uint64(0)], np.cumsum(h * by_place[:n], dtype=np.uint64)))
        moved = np.concatenate(([np.uint64(0)], np.cumsum(h[1:] * by_place[: n - 1], dtype=np.uint64)))
        whole = splitmix(np.array([ahead[n] + np.uint64(n)], np.uint64))[0]
        without = splitmix(ahead[place] + moved[n - 1] - moved[place] + np.uint64(n - 1))
    return whole, without


@tidy
def near_duplicates(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, exact_words: int = EXACT_WORDS) -> DataFrame:
    """Lines to drop: (doc_id, line_no, near_doc_id, near_line_no), the latter an earlier line that is near; it may go itself for a still earlier one.

    Lines are numbered from 0 by the line feeds before them; earlier means a smaller (doc_id, line_no), null ids last.  Lines of fewer
    than ``min_words`` words have only equal lines as partners, and below ``exact_words`` none.  Null and empty texts have no lines that do.
    Rows that repeat a doc_id are taken to be the same document: their equal lines keep the place that they share, and stay.  Lines and texts of any length are
    taken whole.  Other columns, whatever their names, are not read and not returned.  An empty table gives no rows.
    """
    lines = stage(line_table(docs, text, min_words, exact_words), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    distinct = stage(lines.groupBy("h1", "h2").agg(F.min(order).alias("at"), F.max("n").alias("n"), F.first("halves").alias("halves"), F.count("*").alias("times")), "distinct")
    repeated = distinct.where("times > 1").select("h1", "h2", "at")
    repeated = stage(repeated, "repeated")
    copies = with_maybe(lines.select("doc_id", "line_no", "h1", "h2"), "h1", key_filter(repeated, "h1")).where("_maybe").drop("_maybe")
    exact = copies.join(repeated, ["h1", "h2"])
    exact = exact.where(~order.eqNullSafe(F.col("at"))).select("doc_id", "line_no", F.col("at.doc_id").alias("near_doc_id"), F.col("at.line_no").alias("near_line_no"))

    keyed = distinct.select(F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no"), F.posexplode("halves").alias("half", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = stage(shared, "halves")
    likely = with_maybe(keyed, "key", key_filter(shared, "key")).where("_maybe").drop("_maybe")
    candidates = likely.join(shared, "key").groupBy(*PLACE).agg(F.max((F.col("half") % 2 == 1)).alias("first"), F.max((F.col("half") % 2 == 0)).alias("second"))
    by_doc = stage(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "first", "second")).alias("_lines")), "candidates")  # a document's own lines
    d = with_maybe(docs.select("doc_id", F.col(text).alias("_text")), "doc_id", key_filter(by_doc, "doc_id")).where("_maybe")
    d = d.join(by_doc.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    line = lambda every: F.transform("_lines", lambda x: F.struct(x["line_no"].alias("line_no"), F.get(every, x["line_no"]).alias("line"), x["first"].alias("first"), x["second"].alias("second")))
    texts = d.select("doc_id", F.inline(_with_lines("_text", line)))
    texts = stage(texts.where(F.col("line").isNotNull()), "candidate-lines")  # null: the line is another text's that has this id too

    compared = _verified(texts, _links(stage(_variants(texts), "variants")))
    best = F.min(F.struct(F.col("near_doc_id").isNull().alias("last"), "near_doc_id", "near_line_no")).alias("kept")
    earliest = compared.groupBy(*PLACE).agg(best).select(*PLACE, "kept.near_doc_id", "kept.near_line_no")
    # a line whose own text stood earlier goes for that; one whose earliest copy is near an earlier line goes too, by either
    return exact.union(earliest).groupBy(*PLACE).agg(best).select(*PLACE, "kept.near_doc_id", "kept.near_line_no")


def _links(variants: DataFrame) -> DataFrame:
    """(doc_id, line_no, near_doc_id, near_line_no): a line and the earliest earlier line of each of its keys."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    least = variants.where("role = 2").groupBy("key").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    replaced = variants.where("role = 2").join(stage(least, "groups"), "key")
    whole = variants.where("role = 0").select("key", order.alias("whole"))
    shorter = variants.where("role = 1").withColumn("longer", order).join(whole, "key").select("key", "whole", "longer")
    ends = shorter.groupBy("key", "whole").agg(F.min("longer").alias("longer"))  # the shorter line needs only the earliest of the longer ones
    pair = lambda a, b: [F.col(f"{a}.doc_id").alias("doc_id"), F.col(f"{a}.line_no").alias("line_no"), F.col(f"{b}.doc_id").alias("near_doc_id"), F.col(f"{b}.line_no").alias("near_line_no")]
    out = replaced.withColumn("own", order).where(F.col("least") < F.col("own")).select(*pair("own", "least"))
    out = out.union(shorter.where(F.col("whole") < F.col("longer")).select(*pair("longer", "whole")))
    out = out.union(ends.where(F.col("longer") < F.col("whole")).select(*pair("whole", "longer")))
    best = F.min(F.struct(F.col("near_doc_id").isNull().alias("last"), "near_doc_id", "near_line_no")).alias("kept")
    return stage(out.groupBy(*PLACE).agg(best).select(*PLACE, "kept.near_doc_id", "kept.near_line_no"), "near")


def _verified(lines: DataFrame, near: DataFrame) -> DataFrame:
    """Those pairs of ``near`` whose lines are within one edit, by their words."""
    a = lines.select(F.col("doc_id").alias("_a"), F.col("line_no").alias("_m"), F.col("line").alias("_line"))
    b = lines.select(F.col("doc_id").alias("_b"), F.col("line_no").alias("_k"), F.col("line").alias("_kept"))
    pairs = near.join(a, F.col("doc_id").eqNullSafe(F.col("_a")) & (F.col("line_no") == F.col("_m"))).join(b, F.col("near_doc_id").eqNullSafe(F.col("_b")) & (F.col("near_line_no") == F.col("_k")))

    @F.pandas_udf("boolean")
    def within_one(x, y):
        return pd.Series([_one_edit(_split(p), _split(q)) for p, q in zip(x, y, strict=True)], dtype=bool)

    return pairs.where(within_one("_line", "_kept")).select(*PLACE, "near_doc_id", "near_line_no")


def _split(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").translate(FOLD.tobytes()).split()


def _one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the sequences are equal or one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def remove_lines(docs: DataFrame, dropped: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without their ``dropped`` lines, and with n_removed; the other lines keep their order and bytes.

    ``doc_id`` names the column of ``docs`` that ``dropped`` has as doc_id.  A document of whose lines none with words is left goes; others, and
    those that had none before, null and empty texts among them, stay.  Rows that share an id, or have none, lose the same lines.  Input columns named n_removed give
    way.  An empty table gives no rows.
    """
    by_doc = stage(dropped.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone")), "dropped")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_removed"])
    marked = with_maybe(docs, doc_id, key_filter(by_doc, "_id"))
    joined = marked.where("_maybe").join(by_doc, F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    some = F.col("_gone").isNotNull()
    new = joined.withColumn(text, F.when(some, _with_lines(text, _without)).otherwise(F.col(text))).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)))
    new = new.where(~some | F.col(text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).drop("_id", "_gone")
    return marked.where(~F.col("_maybe")).withColumn("n_removed", F.lit(0)).unionByName(new).drop("_maybe")


def _without(every: Column) -> Column:
    """The lines but for those numbered in the sorted array _gone, as a text: the runs between them, end to end."""
    gone = F.filter("_gone", lambda k: k < F.size(every))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(every))), lambda a, b: F.slice(every, a + 2, b - a - 1))
    return F.array_join(F.flatten(runs), "\n")


def op5(spark, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(read(spark, sf_dir, "documents"))
    removed = F.sort_array(F.collect_list(F.struct("line_no", "near_doc_id", "near_line_no")))
    found = dropped.groupBy("doc_id").agg(F.count("*").alias("n_removed"), removed.alias("removed"))
    ids = read(spark, sf_dir, "documents").select("doc_id")
    return ids.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "removed")
