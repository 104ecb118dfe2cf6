"""Hierarchical Pitman-Yor language model: Chinese-restaurant seating sampled by Gibbs, contexts sharing one parent.

Symbols are all words that the training texts hold at least ``LEAST`` times and, for words below that, ``tails`` classes by the word's last
bytes.  Every preceding symbol has a context restaurant over symbols; they share the parent restaurant, whose base is uniform.  Each tail
class has a restaurant over its words, which stand once each, and one further word for those not seen.  So every token of the corpus is
a customer, and what is gathered grows with the corpus: a number for each symbol and for each distinct pair.  Words are told apart by 64-bit hashes.

A sweep takes the customers of a dish w out of the context of u and seats them anew, one after another: with t tables so far, the next opens one with a
weight of (strength + discount * (tables of the other dishes + t)) * parent(w), the parent being without the dish's own old tables and with its t new ones, and
joins one with a weight of the dish's seated customers minus discount * t.  All (u, w) of a sweep are seated side by side given the last sweep's
tables of the others, then the parent's dishes given the new ones: a sampler of rows in parallel, not of one customer at a time.  After the burn-in the predictive
probabilities of the sweeps are averaged.  Random numbers are functions of the sweep, the pair and the customer, so results don't hang on how the table is cut.

Symbols are numbered by hash and dealt to ``g`` blocks; cell (a, b) of a g by g grid has the pairs of contexts of block a and dishes of block b.  The state
is a table of blocks, never on the driver: a sweep sends each block to its g cells, and each cell's sums back to its two blocks.

Documents are packed once into chunks of a few megabytes, as distinct words and their order.  A chunk asks for the counts and numbers of its distinct words, and
for its distinct pairs of symbols, not for each token; requests and answers travel packed, by range of the word's hash or cell of the pair, and the chunk
then scores its documents with the answers.  Ranges and cells are as many as the corpus needs for each to hold about ``CHUNKS_PER_BUCKET`` chunks' worth; a chunk
sends a packet only to those that it has a word or pair of, so there are no more packets than distinct words and pairs of the chunks.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import BINARY, DOUBLE, INT, LONG, SPACED, Words, in_order, read, release, splitmix, stage, staged, struct, text_slices, tidy
from arcline.llm.toxicity import remainder

#: A word that the training texts hold so often is a symbol of its own; a block holds about HEAD symbols at most.
LEAST, HEAD, TAILS = 2, 1 << 20, 256
CHUNK_BYTES = 4 << 20
CHUNKS_PER_BUCKET = 3
BURN_IN, SAMPLES = 3, 4
CONTEXT = (0.75, 5.0)
PARENT = (0.1, 10.0)
WORDS = (0.7, 10.0)
SEED = 20240917

#: The end of a text, a symbol and a word of its own: no word's hash, as far as 64 bits tell.
END = np.uint64(0x9E6C63D0876A9A47)
#: To so many customers of a dish its tables are drawn from their law as it stands; more are seated in groups of a 32nd of those seated.
EXACT, GROUP = 64, 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _tails_of(words: Words, tails: int) -> np.ndarray:
    """The class of each word, by its last two bytes and whether it is longer than four."""
    length = words.ends - words.starts
    last, before = words.folded[words.ends - 1].astype(np.int64), np.where(length > 1, words.folded[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
    return ((last * 31 + before * 17 + (length > 4)) % tails).astype(np.uint16)


class _Planes(NamedTuple):
    """Whole numbers, first byte by first byte: small ones take little once packed."""

    kind: str
    data: bytes


def _pack(x) -> bytes:
    def planes(y):
        if isinstance(y, tuple):
            return tuple(planes(z) for z in y)
        if isinstance(y, np.ndarray) and y.dtype.kind in "iu":
            return _Planes(y.dtype.str, np.ascontiguousarray(np.ascontiguousarray(y).view(np.uint8).reshape(-1, y.itemsize).T).tobytes())
        return y

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes(x), protocol=5))


def _unpack(x: bytes):
    def whole(y):
        if isinstance(y, _Planes):
            kind = np.dtype(y.kind)
            return np.ascontiguousarray(np.frombuffer(y.data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
        return tuple(whole(z) for z in y) if isinstance(y, tuple) else y

    return whole(pickle.loads(zstandard.ZstdDecompressor().decompress(x)))  # noqa: S301  what this module has written


def chunks(docs: DataFrame, text: str, train: Column, chunk_bytes: int, tails: int) -> DataFrame:
    """(chunk, body): documents in packed chunks, each (row keys, whether to learn from them, tokens of each, distinct words in order and their classes, the tokens as places among those)."""
    schema = struct(chunk=LONG, body=BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            ids, flags = [x for h in held for x in h[0]], [x for h in held for x in h[1]]
            lengths, hashes, classes = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            held = []
            words = np.unique(hashes)
            codes = np.searchsorted(words, hashes).astype(np.uint32)
            of = np.zeros(len(words), np.uint16)
            of[codes] = classes
            del hashes, classes
            body = _pack((ids, flags, lengths, np.diff(words, prepend=np.uint64(0)), of, codes))
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "body"])
            held, size, made = [], 0, made + 1
            return out

        for batch in batches:
            keys, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(2), 1 << 18):
                words = Words(data, offsets, SPACED)
                n = hi - lo
                lengths = np.diff(words.first) + 1
                hashes, classes = np.full(len(words.hashes) + n, END, np.uint64), np.zeros(len(words.hashes) + n, np.uint16)
                at = np.arange(len(words.hashes)) + np.searchsorted(words.first, np.arange(len(words.hashes)), "right") - 1  # an end goes after each text's words
                hashes[at], classes[at] = words.hashes, _tails_of(words, tails)
                held.append((keys[lo:hi], [bool(x) for x in flags[lo:hi]], lengths, hashes, classes))
                size += len(data) + 100 * n
                if size >= chunk_bytes:
                    yield flush()
        if held:
            yield flush()

    return stage(docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("_train"), text).mapInArrow(run, schema), "chunks")


def _ranges(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word: equal ranges of hashes, so that buckets in order hold words in order."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def word_requests(packed: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, body): a chunk's distinct words by bucket, packed, with their number in its training texts and their classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, train, lengths, steps, classes, codes = _unpack(body.as_py())
                words = np.cumsum(steps)
                learnt = np.bincount(codes[np.repeat(np.array(train, bool), lengths)], minlength=len(words))
                edges = np.searchsorted(_ranges(words, buckets), np.arange(buckets + 1))
                dealt = np.flatnonzero(np.diff(edges))
                bodies = [_pack((np.diff(words[edges[b] : edges[b + 1]], prepend=np.uint64(0)), learnt[edges[b] : edges[b + 1]].astype(np.uint32), classes[edges[b] : edges[b + 1]])) for b in dealt]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dealt), chunk)), pa.array(dealt, pa.int32()), pa.array(bodies, pa.binary())], names=["chunk", "bucket", "body"])

    return packed.mapInArrow(run, struct(chunk=LONG, bucket=INT, body=BINARY))


def count_words(requests: DataFrame, tails: int, least: int) -> DataFrame:
    """The counts of all words, by bucket.  Rows of three kinds:

    0: (chunk, bucket, body), the training counts of a chunk's words in the order of its request, and their ranks among the bucket's symbols (-1: none);
    1: (bucket, symbols, n), the bucket's number of symbols and of words seen, and c, of tokens;
    2: (symbol, n), how many words of a tail class were seen.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(body) for body in pdf["body"]]
        lists = [np.cumsum(p[0]) for p in parts]
        words, first, back = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        total = np.bincount(back.ravel(), weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(words)).astype(np.int64)
        classes = np.concatenate([p[2] for p in parts])[first]
        rank = np.where(total >= least, np.cumsum(total >= least) - 1, -1)
        bucket = int(pdf["bucket"].iloc[0])
        rows, at = [], 0
        for chunk, words_of in zip(pdf["chunk"], lists, strict=True):
            k = back.ravel()[at : at + len(words_of)]
            at += len(words_of)
            rows.append((0, int(chunk), bucket, 0, 0, 0, _pack((total[k], rank[k]))))
        rows.append((1, 0, bucket, int((total >= least).sum()), int(total.sum()), int((total > 0).sum()), None))
        rare = np.bincount(classes[(total > 0) & (total < least)], minlength=tails)
        rows += [(2, 0, bucket, int(k), 0, int(rare[k]), None) for k in np.flatnonzero(rare)]
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "symbol", "c", "n", "body"])

    return requests.groupBy("bucket").applyInPandas(run, "kind int, chunk long, bucket int, symbol long, c long, n long, body binary")


def _class_words(seen: dict[int, int], tails: int) -> np.ndarray:
    """log10 of the probability of a word not seen and of a seen one in each tail class's restaurant: its words stand once, each at a table of its own."""
    d, strength = WORDS
    n = np.array([seen.get(k, 0) for k in range(tails)], float)
    opening = (strength + d * n) / (n + 1)
    return np.log10(np.stack([opening, 1 - d + opening]) / (strength + n))


def pair_requests(packed: DataFrame, counted: DataFrame, class_words: np.ndarray, *, tails: int, size: int, g: int, n_train: int, n_types: int) -> DataFrame:
    """(chunk, cell, body): a chunk's distinct pairs by cell, packed, with their number in its training texts; of cell -1 what its documents have besides:
    keys, flags, tokens, words known, base scores, tail words' log10 and each token's place among the pairs."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        pdf = pdf.sort_values("bucket")  # the chunk itself, then its words in order
        ids, train, lengths, _, classes, codes = _unpack(pdf["body"].iloc[0])
        answers = [(*_unpack(body), begin) for body, begin in zip(pdf["body"].iloc[1:], pdf["begin"].iloc[1:], strict=True)]
        count = np.concatenate([c for c, _, _ in answers])
        symbol = np.where((rank := np.concatenate([r for _, r, _ in answers])) >= 0, rank + np.repeat([b for _, _, b in answers], [len(r) for _, r, _ in answers]), classes)
        c, symbols = count[codes], symbol[codes].astype(np.int64)
        del answers, codes, rank
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[first] = tails  # the start
        pairs = before * size + symbols
        del before
        every, back = np.unique(pairs, return_inverse=True)
        back = back.ravel().astype(np.int32)
        del pairs
        counts = np.bincount(back, weights=np.repeat(np.array(train, float), lengths), minlength=len(every)).astype(np.int64)
        cell = every // size % g * g + every % size % g
        order = np.argsort(cell, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        rare = np.where(symbols < tails, class_words[(c > 0).astype(np.int64), np.minimum(symbols, tails - 1)], 0.0)
        total = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has a token at least, its end
        base = np.log10((c + 1) / (n_train + n_types + 1))
        rows = [(chunk, -1, _pack((ids, train, lengths, total((c > 0).astype(np.int64)), total(base), total(rare), place[back])))]
        held, begin = np.unique(cell[order], return_index=True)  # of all cells, whose number grows with the corpus, those that this chunk has pairs of
        kind = np.uint32 if counts.max(initial=0) < 2**32 else np.uint64
        for b, at in zip(held, np.split(order, begin[1:]), strict=True):
            rows.append((chunk, int(b), _pack((np.diff(every[at], prepend=0), counts[at].astype(kind)))))
        return pd.DataFrame(rows, columns=["chunk", "cell", "body"])

    left = packed.select("chunk", F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("begin"), "body")
    return left.unionByName(counted.select("chunk", "bucket", "begin", "body")).groupBy("chunk").applyInPandas(run, "chunk long, cell int, body binary")


def _slices(n: int, size: int = 1 << 18) -> Iterator[slice]:
    """Runs of ``size`` at most, so that working arrays stay small."""
    return (slice(lo, lo + size) for lo in range(0, n, size))


def _uniform(key: np.ndarray, k: int) -> np.ndarray:
    """The k-th random number between 0 and 1 of each key."""
    with np.errstate(over="ignore"):
        return (splitmix(key + np.uint64(k + 1) * _GOLDEN) >> np.uint64(11)) * 2.0**-53


def _keys(numbers: np.ndarray, sweep: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(splitmix(numbers.astype(np.uint64) + np.uint64(SEED)) + np.uint64(sweep * 2 + salt) * np.uint64(0xD1B54A32D192ED03))


def _binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """A binomial number for each key: by inversion, or beyond 30 on either side by the normal law."""
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)
    mean = n * q
    z = np.sqrt(-2 * np.log(np.maximum(_uniform(key, k), 1e-300))) * np.cos(2 * np.pi * _uniform(key, k + 1))
    out = np.clip(np.rint(mean + np.sqrt(mean * (1 - q)) * z), 0, n)
    low = np.flatnonzero(mean <= 30)
    u, found, chance = _uniform(key[low], k), np.zeros(len(low)), np.exp(n[low] * np.log1p(-q[low]))
    odds, left = q[low] / (1 - q[low]), np.arange(len(low))
    below = chance.copy()
    while len(left := left[(u[left] > below[left]) & (found[left] < n[low][left])]):
        chance[left] *= odds[left] * (n[low][left] - found[left]) / (found[left] + 1)
        found[left] += 1
        below[left] += chance[left]
        left = left[chance[left] > 1e-18]
    out[low] = found
    return np.where(flip, n - out, out).astype(np.int64)


@functools.lru_cache(maxsize=4)
def _arrangements(discount: float) -> np.ndarray:
    """Logarithms of the weights of all ways to seat c customers at t tables, but for what opening them weighs: generalised Stirling numbers, for c to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            out[c + 1, 1 : EXACT + 1] = np.logaddexp(out[c, :EXACT], np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1 : EXACT + 1], -np.inf))
    return out


def seat(c: np.ndarray, opening: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of ``c`` customers of each dish, all reseated; ``key`` gives each dish its random numbers.

    ``opening(which, t)`` is the weight with which the next customer of dishes ``which`` opens a table when they have ``t``; t tables weigh the product of those of all
    but the first, times the ways to seat the customers at them.  To ``EXACT`` customers that law is drawn from as it stands.  Beyond, customers come one after another.  A
    table that opens changes what all later customers weigh, by a factor that for an opening of weight rising by ``rise`` a table is close to
    d / (rise + (d - rise) * (c / n)^d) after n of c customers; the weight of opening is taken times that.
    From ``EXACT`` on they come in groups of a ``GROUP``-th of those seated, which share the chance of their middle.
    """
    t = (c > 0).astype(np.int64)
    ways = _arrangements(discount)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        for lo in range(edges[k - 2], edges[k - 1], 1 << 14):
            which = order[lo : min(lo + (1 << 14), edges[k - 1])]
            weight = np.empty((k, len(which)))
            weight[0] = ways[k, 1]
            opened = np.zeros(len(which))
            for n in range(1, k):
                opened = opened + np.log(opening(which, np.full(len(which), n)))
                weight[n] = ways[k, n + 1] + opened
            share = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
            t[which] = 1 + (share < _uniform(key[which], 0) * share[-1]).sum(axis=0)

    def chance(which: np.ndarray, now: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = opening(which, now)
        rise = opening(which, now + 1) - weight
        later = 1.0
        for _ in range(3):
            rest = weight * later - discount * now
            times = np.maximum(c[which] - 0.5 + rest, 0.5) / np.maximum(n + 0.5 + rest, 0.5)
            later = discount / (rise + (discount - rise) * np.maximum(times, 1.0) ** discount)
        return np.clip(weight * later / (weight * later + n - discount * now), 0, 1)

    active = np.flatnonzero(c > EXACT)
    for n in range(1, EXACT if len(active) else 0):
        t[active] += _uniform(key[active], n) < chance(active, t[active], n)
    seated, k = np.full(len(active), EXACT), EXACT
    while len(active):
        step = np.minimum(seated // GROUP, c[active] - seated)
        now, at = t[active].astype(np.float64), seated.astype(np.float64)
        p = chance(active, now, at)
        p = chance(active, now + p * (step - 1) / 2, at + (step - 1) / 2)
        t[active] += _binomial(step, p, key[active], k)
        seated, k = seated + step, k + 2
        active, seated = active[seated < c[active]], seated[seated < c[active]]
    return t


def _parent(dishes: tuple[np.ndarray, np.ndarray], whole: tuple[int, int], size: int) -> np.ndarray:
    """The parent's predictive probabilities of a block's (customers, tables); ``whole`` are those of all blocks.  Its base is uniform."""
    d, strength = PARENT
    customers, tables = dishes
    n, t = whole
    return (customers - d * tables + (strength + d * t) / (size - 1)) / (strength + n)


def _merge(bodies) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bucket's requests and their counts."""
    parts = [_unpack(b) for b in bodies]
    keys, counts = np.concatenate([np.cumsum(k) for k, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


_SUMS = "side int, block int, old int, body binary"


def _sums(every: np.ndarray, x: list[np.ndarray], cell: int, size: int, g: int) -> list[tuple]:
    """Rows of a cell's sums of each of ``x``: side 0 by context of its block, side 1 by dish."""
    out = []
    for side, block, at in ((0, cell // g, every // size // g), (1, cell % g, every % size // g)):
        length = (size - block + g - 1) // g
        out.append((side, block, 0, _pack(tuple(np.bincount(at, weights=y, minlength=length).astype(np.int64) for y in x))))
    return out


def _gather(requests: DataFrame, size: int, g: int) -> DataFrame:
    """Each cell's distinct pairs and their counts (side 2, the cell as block), and sums of customers and of first tables, one a pair."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        every, total = _merge(pdf["body"])
        return pd.DataFrame([*_sums(every, [np.minimum(total, 1), total], cell, size, g), (2, cell, 0, _pack((np.diff(every, prepend=0), total)))], columns=["side", "block", "old", "body"])

    return stage(requests.groupBy("cell").applyInPandas(run, _SUMS), "restaurants")


def _state(sums: DataFrame, before: DataFrame | None, sweep: int, whole: tuple[int, int], size: int, g: int) -> tuple[DataFrame, tuple[int, int]]:
    """The blocks after a sweep, side 0 (tables; of sweep 0 customers too) and side 1 (the parent's customers, tables), and the parent's whole (customers, tables)."""
    d, strength = PARENT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, block = int(pdf["side"].iloc[0]), int(pdf["block"].iloc[0])
        new = [_unpack(b) for b in pdf["body"][pdf["old"] == 0]]
        total = [np.sum(x, axis=0) for x in zip(*new, strict=True)]
        if side == 0:
            return pd.DataFrame([(0, block, 1, _pack(tuple(total)), 0, 0)], columns=["side", "block", "old", "body", "n", "t"])
        customers = total[0]
        tables = np.minimum(customers, 1)
        if sweep:
            others = whole[1] - _unpack(pdf["body"][pdf["old"] == 1].iloc[0])[1]
            tables = seat(customers, lambda which, t: (strength + d * (others[which] + t)) / (size - 1), d, _keys(np.arange(len(customers)) * g + block, sweep, 1))
        return pd.DataFrame([(1, block, 1, _pack((customers, tables)), int(customers.sum()), int(tables.sum()))], columns=["side", "block", "old", "body", "n", "t"])

    sums = sums.where("side < 2")
    if before is not None:
        sums = sums.unionByName(before.where("side = 1").drop("n", "t"))
    state = stage(sums.groupBy("side", "block").applyInPandas(run, f"{_SUMS}, n long, t long"), "state")
    r = state.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    return state, (r["n"] or 0, r["t"] or 0)


def _dealt(state: DataFrame, g: int, sweep: int) -> DataFrame:
    """(cell, kind, at, body): each block at its ``g`` cells, kinds 2 and 3 for sides 0 and 1."""
    j = F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("j")
    cell = F.when(F.col("side") == 0, F.col("block") * g + F.col("j")).otherwise(F.col("j") * g + F.col("block"))
    return state.select("side", "block", "body", j).select(cell.cast("int").alias("cell"), (F.col("side") + 2).alias("kind"), F.lit(sweep).cast("long").alias("at"), "body")


def _openings(every: np.ndarray, old: np.ndarray, tables: np.ndarray, dishes: tuple[np.ndarray, np.ndarray], whole: tuple[int, int], size: int, g: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The weight of a new table for each pair of a cell, its own ``old`` tables taken out of the context and of the parent."""
    (d, strength), (up_d, up_strength) = CONTEXT, PARENT
    u, w = every // size // g, every % size // g
    others = tables[u] - old
    customers = dishes[0][w] - old
    kept = np.maximum(np.minimum(dishes[1][w], customers), 1)  # the dish's tables at the parent, one at least once it has a table here
    base = (up_strength + up_d * (whole[1] - dishes[1][w] + kept)) / (size - 1) - up_d * kept

    def opening(which: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (strength + d * (others[which] + t)) * (customers[which] + t + base[which]) / (up_strength + whole[0] - old[which] + t)

    return opening


def _sweep(restaurants: DataFrame, seats: DataFrame | None, state: DataFrame, whole: tuple[int, int], sweep: int, size: int, g: int) -> DataFrame:
    """Each cell's tables by pair (side 2, the cell as block) and their sums."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        part = {int(k): _unpack(b) for k, b in zip(pdf["kind"], pdf["body"], strict=True)}
        rows = []
        if 1 in part:
            delta, total = part[1]
            every = np.cumsum(delta)
            t = part[4].astype(np.int64) if 4 in part else np.minimum(total, 1)
            for k in _slices(len(t)):  # each from its own old tables
                t[k] = seat(total[k], _openings(every[k], t[k], part[2][0], part[3], whole, size, g), CONTEXT[0], _keys(every[k], sweep, 0))
            rows = [*_sums(every, [t], cell, size, g), (2, cell, 0, _pack(t.astype(np.uint32 if t.max(initial=0) < 2**32 else np.uint64)))]
        return pd.DataFrame(rows, columns=["side", "block", "old", "body"])

    by_pair = lambda df, kind: df.where("side = 2").select(F.col("block").alias("cell"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("at"), "body")
    parts = by_pair(restaurants, 1).unionByName(_dealt(state, g, sweep))
    if seats is not None:
        parts = parts.unionByName(by_pair(seats, 4))
    return stage(parts.groupBy("cell").applyInPandas(run, _SUMS), "seats")


def _answers(requests: DataFrame, restaurants: DataFrame, size: int, g: int, burn_in: int, samples: int) -> DataFrame:
    """(chunk, cell, body): the averaged probabilities of each request's pairs, by Gibbs sweeps over all context restaurants."""
    d, strength = CONTEXT
    spark, pairs_path = restaurants.sparkSession, staged()[-1]
    state, whole = _state(restaurants, None, 0, (0, 0), size, g)
    parts, wholes, seats = [_dealt(state.where("side = 0"), g, 0)], {}, None
    for sweep in range(1, burn_in + samples + 1):
        behind = staged()[-2:] if 1 < sweep <= burn_in + 1 else []  # the last sweep's tables and state
        new = _sweep(restaurants, seats, state, whole, sweep, size, g)
        state, whole = _state(new, state, sweep, whole, size, g)
        seats = new
        release(spark, behind)  # written anew, and not read again
        spark.sparkContext._jvm.System.gc()  # Spark deletes a shuffle's files once the driver has let go of it, which is when it collects garbage
        if sweep > burn_in:
            wholes[sweep] = whole
            parts.append(seats.where("side = 2").select(F.col("block").alias("cell"), F.lit(1).alias("kind"), F.lit(sweep).cast("long").alias("at"), "body"))
            parts.append(_dealt(state, g, sweep))
    release(spark, [pairs_path])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["kind"] == 0]
        if not len(asked):
            return pd.DataFrame([], columns=["chunk", "cell", "body"])
        every, total = _merge(asked["body"])
        part = {(int(k), int(at)): b for k, at, b in zip(pdf["kind"], pdf["at"], pdf["body"], strict=True) if k}
        p = np.zeros(len(every))
        for sweep, all_of in wholes.items():  # averaged over the sweeps: what stays in the context, and what it leaves to the parent times the parent's probability
            tables, seats, above = _unpack(part[2, sweep])[0], _unpack(part[1, sweep]), _parent(_unpack(part[3, sweep]), all_of, size)
            for k in _slices(len(p)):
                p[k] += total[k] - d * seats[k] + (strength + d * tables[every[k] // size // g]) * above[every[k] % size // g]
        customers = _unpack(part[2, 0])[1]
        for k in _slices(len(p)):
            p[k] /= len(wholes) * (strength + customers[every[k] // size // g])
        p = p.astype(np.float32)
        return pd.DataFrame({"chunk": asked["at"].to_numpy(), "cell": asked["cell"].to_numpy(), "body": [_pack(p[np.searchsorted(every, np.cumsum(_unpack(b)[0]))]) for b in asked["body"]]})

    every = requests.select("cell", F.lit(0).alias("kind"), F.col("chunk").alias("at"), "body")
    for x in parts:
        every = every.unionByName(x)
    return every.groupBy("cell").applyInPandas(run, "chunk long, cell int, body binary")


@tidy
def score(docs: DataFrame, *, train: Column, text: str = "text", head: int = HEAD, tails: int = TAILS, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Learn from the ``train`` rows of ``docs`` (doc_id, ``text``) and score all whole texts: a row for each.

    Returns doc_id, held_out (not learnt from), n_tokens, n_known, train_tokens, base_score and score (log10 probabilities; perplexity is
    10 ^ (-score / n_tokens)).  Null texts are empty ones, which hold only an end; very long ones are a chunk of their own.  Repeated rows are learnt and scored one by one.  Where
    nothing is learnt from, N and V are 0 and every probability comes from the bases.  Other columns, whatever their names, are not read and not returned.  An empty table gives no rows.  ``head`` bounds a
    block of symbols, not their number: more symbols are more blocks.
    """
    before = staged()
    packed = chunks(docs, text, train, chunk_bytes, tails)
    n_chunks = max(1, packed.count())
    buckets = math.ceil(n_chunks / CHUNKS_PER_BUCKET)
    counted = stage(count_words(word_requests(packed, buckets), tails, least), "words")
    whole = counted.where("kind = 1").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("symbol", "c", "n")]).first()
    seen = {r["symbol"]: r["n"] for r in counted.where("kind = 2").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}  # a row a class
    n_types, n_train, size = whole["n"], whole["c"], tails + 1 + whole["symbol"]  # symbols: the classes, the start of a text (a context only), the words by bucket
    begins = in_order(counted.where("kind = 1").select("bucket", "symbol"), [F.col("bucket")], {"_before": "symbol"}, "begins")
    answered = counted.where("kind = 0").join(begins.select("bucket", (F.col("_before") + tails + 1).alias("begin")), "bucket")
    g = max(math.ceil(math.sqrt(buckets)), math.ceil(size / head))

    asked = pair_requests(packed, answered, _class_words(seen, tails), tails=tails, size=size, g=g, n_train=n_train, n_types=n_types)
    read_once = [p for p in staged() if p not in before]
    asked = stage(asked, "pairs")
    release(docs.sparkSession, read_once)
    requests = asked.where("cell >= 0")
    answers = _answers(requests, _gather(requests, size, g), size, g, burn_in, samples)
    every = asked.where("cell < 0").unionByName(answers)
    schema = struct(doc_id=docs.schema["doc_id"].dataType, held_out=T.BooleanType(), n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=DOUBLE, score=DOUBLE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        ids, train_flags, lengths, known, base, rare, place = _unpack(pdf["body"].iloc[0])
        log = np.log10(np.concatenate([_unpack(b) for b in pdf["body"].iloc[1:]]).astype(np.float64))
        total = np.add.reduceat(log[place], np.concatenate(([0], np.cumsum(lengths)[:-1])))
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype="object"), "held_out": [not t for t in train_flags], "n_tokens": lengths, "n_known": known, "train_tokens": np.full(len(lengths), n_train), "base_score": base, "score": total + rare})

    return every.groupBy("chunk").applyInPandas(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), train=remainder("doc_id", 7) != 2)
