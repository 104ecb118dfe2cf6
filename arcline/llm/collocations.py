"""Phrase collocation mining: contiguous phrases that occur more often than their parts let expect, language by language.

1. Texts are cut into pieces, and identical pieces of a language become one with a multiplicity, so copies and stock passages are counted once.
2. Phrases of one word, then two, and so on are counted by multiplicity: a task adds up what it meets, the sums are shuffled to hash buckets, and each
   bucket is summed by duckdb, which keeps its table on disk beyond a fixed memory.  A phrase is only sent if the phrases one word shorter
   in it may be frequent enough, by a bitmap of fixed size; buckets hand on what is frequent, the only phrases that can be a candidate or part of one.
3. Candidates that a frequent enough longer one covers go.  Each candidate left asks for the counts of its parts: requests are shuffled to the parts, answers
   back to the candidate.  Parts that many ask for, of which there are few, are broadcast instead.
4. The best of each language are ranked, first among the candidates of each of 64 hashes.

Words are told apart by 64-bit hashes, phrases by those of their words.
"""

from __future__ import annotations

import os
import string
import tempfile
from collections.abc import Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.llm.common import LONG, SPACED, STRING, Words, looked_up, read, release, shared_folder, splitmix, stage, struct, text_slices, tidy

WORDS, LEAST, COVERED, SCALE, TOP = 3, 10, 50, 1_000_000, 2000
#: A-Z lower-cased; piece marks as 0x0A, tab as a space.
PIECES = np.array([b + 32 if 65 <= b <= 90 else 10 if 10 <= b <= 13 or b in b".,;:!?" else 32 if b == 9 else b for b in range(256)], dtype=np.uint8)
#: Phrases that a task adds up at a time, phrases a bucket is made for, and a bucket's memory.
GRAMS, BUCKET_GRAMS, BUCKET_MB = 1 << 19, 1 << 21, 192
_BITS, _PAGE = 1 << 26, 1 << 15
UNKNOWN = "und"


def _summed(keys: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, sums) of equal keys.  Equal ones that another key's hash comes between stay apart, and are added up later."""
    order = np.argsort(_mixed(keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return order[begin], np.add.reduceat(weights[order], begin) if len(begin) else weights[:0]


def _mixed(keys: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns of numbers."""
    out = np.zeros(len(keys[0]), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64) + np.uint64(1))
    return out


def pieces(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, n_words, times), staged: the distinct pieces of each language's texts that hold words, and how often each occurs."""
    schema = struct(lang=STRING, piece=STRING, n_words=LONG, times=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                folded = PIECES[data]
                whole = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(folded)])
                cut = pc.split_pattern(whole, "\n")
                every = pa.table({"lang": batch.column(0).slice(lo, hi - lo).take(pc.list_parent_indices(cut)), "piece": pc.ascii_trim(cut.flatten(), " ")})
                once = every.filter(pc.greater(pc.binary_length(every["piece"]), 0)).group_by(["lang", "piece"]).aggregate([([], "count_all")]).combine_chunks()
                if not once.num_rows:
                    continue
                piece = once["piece"].combine_chunks()
                n_words = [np.diff(Words(d, o, SPACED).first) for _, _, d, o in text_slices(piece)]
                yield pa.RecordBatch.from_arrays([once["lang"].combine_chunks(), piece.cast(pa.string()), pa.array(np.concatenate(n_words), pa.int64()), once["count_all"].combine_chunks()], names=schema.fieldNames())

    cut = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).mapInArrow(run, schema)
    return stage(cut.groupBy("lang", "piece").agg(F.max("n_words").alias("n_words"), F.sum("times").alias("times")), "pieces")


def _columns(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _grams(pieces: DataFrame, n: int, frequent: np.ndarray | None) -> DataFrame:
    """(lang, w0 .., times and, of single words, word) of what phrases of ``n`` words tasks have added up; longer ones by what ``frequent`` allows."""
    schema = struct(lang=STRING, **dict.fromkeys(_columns(n), LONG), **({"word": STRING} if n == 1 else {}), times=LONG)
    bits = pieces.sparkSession.sparkContext.broadcast(frequent) if n > 1 else None

    def found(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray, pa.Array | None]]:
        codes = batch.column(0).dictionary_encode()
        names, code, times = codes.dictionary, codes.indices.to_numpy(), batch.column(2).to_numpy()
        salt = np.array([hash_of(x) for x in names.to_pylist()], np.uint64)
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            words = Words(data, offsets, SPACED)
            owner = np.repeat(np.arange(lo, hi), np.diff(words.first))
            h = words.hashes
            at = np.arange(max(0, len(h) - n + 1))
            at = at[owner[at] == owner[at + n - 1]]
            if n > 1:
                may = _may(bits.value, [salt[code[owner[: len(h) - n + 2]]], *(h[i : len(h) - n + 2 + i] for i in range(n - 1))])
                at = at[may[at] & may[at + 1]]
            keys = [h[at + i] for i in range(n)]
            first, total = _summed([code[owner[at]], *keys], times[owner[at]])
            text = _taken(words, at[first]) if n == 1 else None
            yield names, code[owner[at[first]]], [k[first] for k in keys], total, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for names, code, keys, total, text in found(batch):
                columns = [names.take(pa.array(code)), *(pa.array(k.view(np.int64)) for k in keys), *([text] if text is not None else []), pa.array(total)]
                held.append(pa.RecordBatch.from_arrays(columns, names=schema.fieldNames()))
            if sum(b.num_rows for b in held) >= GRAMS:
                yield from _added(held)
                held = []
        yield from _added(held)

    return pieces.select("lang", "piece", "times").mapInArrow(run, schema)


def hash_of(lang: str) -> int:
    """A language's hash, as of its words' bytes."""
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(_mixed([np.array([len(data)]), *(data[i : i + 1] for i in range(len(data)))])[0])


def _taken(words: Words, at: np.ndarray) -> pa.Array:
    """The bytes of some words, as strings."""
    size = words.ends[at] - words.starts[at]
    ends = np.cumsum(size)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    data = words.folded[np.repeat(words.starts[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _added(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of several batches with equal ones added up."""
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = [c for c in table.column_names if c.startswith("w") and c != "word"]
    codes = table["lang"].combine_chunks().dictionary_encode()
    first, total = _summed([codes.indices.to_numpy(), *(table[c].to_numpy().view(np.uint64) for c in keys)], table["times"].to_numpy())
    once = table.drop_columns("times").take(pa.array(first)).append_column("times", pa.array(total))
    yield from once.to_batches(max_chunksize=1 << 16)


def _may(bits: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    h = _mixed(keys) & np.uint64(_BITS - 1)
    return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _frequent(counted: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashes of counted phrases of ``n`` words: 8 MB, whatever their number; once it is full it allows all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            salt = np.array([hash_of(x) for x in codes.dictionary.to_pylist()], np.uint64)
            h = _mixed([salt[codes.indices.to_numpy()], *(batch.column(i + 1).to_numpy().view(np.uint64) for i in range(n))])
            yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(_BITS - 1)).astype(np.int64))], names=["bit"])

    set_ = counted.select("lang", *_columns(n)).mapInArrow(run, struct(bit=LONG)).distinct()
    pages = set_.groupBy(F.floor(F.col("bit") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % _PAGE).alias("bits")).collect()  # at most 2048 of 4 KB
    out = np.zeros(_BITS // 8, np.uint8)
    for r in pages:
        out[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _counted(grams: DataFrame, n: int, buckets: int, least: int, folder: str | None) -> DataFrame:
    """``grams`` summed by duckdb, a hash bucket at a time; those that occur ``least`` times and more."""
    columns = ["lang", *_columns(n), *(["word"] if n == 1 else [])]
    schema = grams.select(*columns, F.col("times").alias("f")).schema
    types = ", ".join(f"{c} {'VARCHAR' if c in ('lang', 'word') else 'BIGINT'}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder:
            os.makedirs(folder, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=folder) as own:
            settings = {"memory_limit": f"{BUCKET_MB}MB", "threads": 1, "temp_directory": own, "preserve_insertion_order": False}
            with duckdb.connect(f"{own}/bucket.db", config=settings) as bucket:
                bucket.execute(f"CREATE TABLE grams ({types}, times BIGINT)")
                for batch in batches:
                    bucket.register("more", pa.Table.from_batches([batch]))
                    bucket.execute("INSERT INTO grams SELECT * FROM more")
                    bucket.unregister("more")
                reader = bucket.sql(f"SELECT {', '.join(columns)}, CAST(sum(times) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING sum(times) >= {least}").to_arrow_reader(1 << 16)
                yield from reader

    return grams.select(*columns, "times").repartition(buckets, "lang", *_columns(n)).mapInArrow(run, schema)


def counts(pieces: DataFrame, *, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, gram array<long>, word, f), staged: the phrases of up to ``words`` words that occur ``least`` times or more; word for single ones."""
    spark = pieces.sparkSession
    buckets = max(1, -(-(pieces.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_GRAMS))
    folder, frequent, found = shared_folder(spark, "buckets"), None, []
    for n in range(1, words + 1):
        table = stage(_counted(_grams(pieces, n, frequent), n, buckets, least, folder), f"grams{n}")
        found.append(table.select("lang", F.array(*_columns(n)).alias("gram"), (F.col("word") if n == 1 else F.lit(None).cast("string")).alias("word"), "f"))
        frequent = _frequent(table, n) if n < words else None
    return stage(reduce(DataFrame.unionByName, found), "counts")


def _parts(rows: DataFrame, least: int) -> DataFrame:
    """A row for each shorter phrase of ``least`` words and more within each ``gram``: ``begin`` and ``part``."""
    size = F.size("gram")
    spans = F.flatten(F.transform(F.sequence(F.lit(least), size - 1), lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda b: F.struct(b.alias("begin"), F.slice("gram", b + 1, n).alias("part")))))
    return rows.where(size > least).select(*rows.columns, F.inline(spans))


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Those of ``candidates`` (lang, gram, a) that no longer one holds that occurs ``covered`` percent as often or more."""
    longest = _parts(candidates, 2).groupBy("lang", F.col("part").alias("gram")).agg(F.max("a").alias("_longer"))
    return candidates.join(longest, ["lang", "gram"], "left").where(F.coalesce(100 * F.col("_longer").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)"), F.lit(True))).drop("_longer")


def _score(a: Column, l: Column, r: Column, scale: int) -> Column:  # noqa: E741
    """floor(scale * a * a / (l * r)), exact to 38 digits."""
    whole = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(19,0)") * whole(a) * whole(a), whole(l) * whole(r))


def scored(candidates: DataFrame, counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """``candidates`` (lang, gram, a) with their phrase and the l, r and score of their lowest-scoring cut, the first of several."""
    requests = stage(_parts(candidates, 1), "requests")
    answers = looked_up(requests, counts.select("lang", F.col("gram").alias("part"), "word", "f"), ["lang", "part"])
    found = answers.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.collect_list(F.struct("begin", F.size("part").alias("n"), "word", "f")).alias("parts"))  # a phrase's own parts
    size = F.size("gram")
    of = lambda begin, n: F.filter("parts", lambda p: (p["begin"] == begin) & (p["n"] == n))[0]
    cut = lambda k: F.struct(_score(F.col("a"), of(F.lit(0), k)["f"], of(k, size - k)["f"], scale).alias("score"), k.alias("k"), of(F.lit(0), k)["f"].alias("l"), of(k, size - k)["f"].alias("r"))
    phrase = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda b: of(b, F.lit(1))["word"]), " ")
    best = found.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut)))
    return best.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")


@tidy
def mine(docs: DataFrame, *, words: int = WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of 2 to ``words`` words of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Ranked by score descending, a descending, phrase ascending by bytes.  A null language is ``und``, together with rows that say so; null and empty
    texts hold nothing; rows count each, repeated ones too; very long pieces are worked on whole.  Other columns are not read.  An empty
    table gives no rows.
    """
    held = pieces(docs)
    totals = held.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("times")).alias("n"))
    counted = counts(held, words=words, least=least)
    kept = uncovered(counted.where(F.size("gram") > 1).select("lang", "gram", F.col("f").alias("a")), covered)
    rows = scored(kept, counted)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    ahead = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_first", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_first") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH p AS (SELECT lang, unnest(string_split_regex(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS text FROM documents)),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, list_slice(w, b, b + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS b FROM w, range(1, {WORDS + 1}) AS s(k))),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
covers AS (SELECT lang, list_slice(g, b, b + k - 1) AS g, max(a) AS longer FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS b FROM c, range(2, {WORDS}) AS s(k) WHERE k < len(g)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN covers USING (lang, g) WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
cuts AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, CAST({SCALE}::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM kept) c JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, k) JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, k + 1, len(c.g))),
best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN totals USING (lang) WHERE rank <= {TOP}
"""
