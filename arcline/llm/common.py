"""Shared pieces: staged tables, Arrow text slices and vectorised word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z lower-cased; digits, letters and bytes from 0x80 kept; every other byte is a separator (32).
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
#: A-Z lower-cased; only white space (\\x20, \\x09-\\x0D) separates.
SPACED = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], dtype=np.uint8)
#: Text is hashed in slices of about this many bytes, so that the working arrays stay small.
SLICE_BYTES = 1 << 19
#: Rows that go to Python at a time while an operator runs; Spark's own 10,000 texts are tens of megabytes in the JVM and again in each worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK, _RUNNING = threading.Lock(), {}
#: What the operator that now runs has staged, its own list for each call and thread.
_OWN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one is made only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="arcline-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/arcline-{label}-{uuid.uuid4().hex}"
    own = _OWN.get()
    if own is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str | None:
    """A path that tasks may write to by name, in the shared folder, deleted with what the running operator has staged.

    None where the shared folder is in a store that isn't mounted as files: tasks then have their own scratch space only.
    """
    scheme, _, rest = scratch_dir(spark).rpartition("://") if "://" in scratch_dir(spark) else scratch_dir(spark).rpartition("file:")
    if scheme not in ("", "file"):
        return None
    path = f"{rest}/arcline-{label}-{uuid.uuid4().hex}"
    own = _OWN.get()
    if own is not None:
        own.append(path)
    return path


def staged() -> list[str]:
    """Paths that the running operator has staged and not yet released."""
    return list(_OWN.get() or [])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that the running operator has staged and will not read again."""
    jvm, conf, own = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _OWN.get() or []
    for p in paths:
        if p in own:
            own.remove(p)
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most BATCH_ROWS rows a batch until the last operator of the session that is within leaves; then what the session had before."""
    key = spark._jsparkSession.hashCode()
    with _LOCK:
        depth, before = _RUNNING.get(key, (0, spark.conf.get(_BATCH)))
        _RUNNING[key] = depth + 1, before
        if not depth and not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        with _LOCK:
            depth, before = _RUNNING.pop(key)
            if depth > 1:
                _RUNNING[key] = depth - 1, before
            else:
                spark.conf.set(_BATCH, before)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is staged within is deleted at the end, also after an error, but for paths that are taken out of the list; Arrow batches are small."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        with small_batches(spark):
            yield own
    finally:
        release(spark, list(own))
        _OWN.reset(token)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is staged, and whose other staged tables are deleted before it returns or raises.

    The result's table is left under ``spark.checkpoint.dir`` for whatever reads it next: an outer ``scratch`` or the caller deletes it.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with scratch(docs.sparkSession) as own:
            result = stage(operator(docs, *args, **kwargs), operator.__name__.strip("_"))
            path = own.pop()
        outer = _OWN.get()
        if outer is not None:
            outer.append(path)
        return result

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (staged) that ``table`` (a row a key) has the keys of, with its other columns; nulls are equal.

    Keys that over a 500th of all rows ask for, fewer than 500 therefore, are answered by broadcast; the others by a shuffle in which none is hot.
    """
    asked = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys], F.lit(True).alias("_met"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * 500 > max(1, rows.count())).drop("_n")
    hot = stage(often.join(asked, same).drop(*keys), "hot")
    columns = [*rows.columns, *[c for c in table.columns if c not in keys]]
    first = rows.join(F.broadcast(hot), same, "left")
    rest = first.where("_met IS NULL").select(*rows.columns).join(asked, same)
    return first.where("_met").select(*columns).unionByName(rest.select(*columns))


def carried(df: DataFrame, new: T.StructType, columns: list[str] | None = None) -> tuple[list[str], T.StructType]:
    """Input columns to pass through beside ``new`` ones (which win a clash of names), and the whole schema."""
    taken = {f.name.lower() for f in new}
    fields = [f for f in df.schema if (columns is None or f.name in columns) and f.name.lower() not in taken]
    return [f.name for f in fields], T.StructType([*fields, *new.fields])


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """``df``, staged, with a running sum of columns over its rows in a total ``order``: {new column: summed column}, the row itself left out.

    Rows are dealt to tasks by range; a task sums its own, and what stands before it comes from one row of sums for each task, so no
    task holds more than a range.
    """
    dealt = stage(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), label)
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sorted(dealt.groupBy("_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect(), key=lambda r: r["_range"])  # a row a task
    offsets, total = [], {k: 0 for k in sums}
    for r in ranges:
        offsets.append((r["_range"], *total.values()))
        total = {k: v + (r[k] or 0) for k, v in total.items()}
    kinds = {k: dict(dealt.dtypes)[c] for k, c in sums.items()}
    held = df.sparkSession.createDataFrame([(o[0], *(float(v) if kinds[k] == "double" else int(v) for k, v in zip(sums, o[1:], strict=True))) for o in offsets], ", ".join(["_range int", *(f"_{k} {'double' if t == 'double' else 'long'}" for k, t in kinds.items())]))
    out = dealt.join(F.broadcast(held), "_range")
    return out.select(*df.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(k) for k, c in sums.items()])


_FILTER_BITS, _BITMAP_BITS = 1 << 26, 1 << 15


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashes of ``column``: at most 2048 rows of 4 KB, whatever the number of keys."""
    h = F.pmod(F.xxhash64(column), F.lit(_FILTER_BITS))
    bits = keys.select(F.floor(h / _BITMAP_BITS).cast("int").alias("_filter_bucket"), (h % _BITMAP_BITS).alias("_filter_bit")).distinct()
    return bits.groupBy("_filter_bucket").agg(F.bitmap_construct_agg("_filter_bit").alias("_filter_bits"))


def with_maybe(df: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """``df`` with _maybe: false only where ``column`` is not among the bitmap's keys.

    The bitmap's size has a bound, so it is broadcast; rows that can't match need no shuffle.  Once it is full every row may match.
    """
    h = F.pmod(F.xxhash64(column), F.lit(_FILTER_BITS))
    at = (h % _BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.expr("substring(_filter_bits, cast(_filter_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = df.withColumn("_filter_bucket", F.floor(h / _BITMAP_BITS).cast("int")).withColumn("_filter_at", at).join(F.broadcast(bitmap), "_filter_bucket", "left")
    found = F.getbit(F.coalesce(byte, F.lit(0)).cast("long"), F.pmod("_filter_at", F.lit(8)))
    return joined.withColumn("_maybe", found == 1).drop("_filter_bucket", "_filter_at", "_filter_bits")


LONG, INT, STRING, DOUBLE, BOOL, BINARY = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same everywhere."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return splitmix(x) | np.uint64(1)


_AT_BYTE = constants(11, 1024)
_AT_WORD = constants(29, 4096)


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


class Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a slice, A-Z lower-cased, as 64-bit hashes; with SPACED, words between white space.

    ``hashes[k]`` is word k, ``starts[k]:ends[k]`` its bytes in ``folded``; ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = FOLD) -> None:
        self.folded = fold[data]
        inside = self.folded != 32
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cut] = inside[cut]
        stop = inside.copy()
        stop[:-1] &= begin[1:] | ~inside[1:]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        length = self.ends - self.starts
        where = np.flatnonzero(inside)
        if len(where):
            base = np.zeros(len(length), np.int64)
            np.cumsum(length[:-1], out=base[1:])
            at = np.arange(len(where)) - np.repeat(base, length)
            with np.errstate(over="ignore"):
                value = (self.folded[where].astype(np.uint64) + np.uint64(1)) * _AT_BYTE[at & 1023]
                self.hashes = splitmix(np.add.reduceat(value, base) + length.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def text(self, k: int, n: int) -> bytes:
        """Words k .. k + n - 1, joined by one space."""
        return b" ".join(self.folded[self.starts[i] : self.ends[i]].tobytes() for i in range(k, k + n))


def window_hashes(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n consecutive words from each start (``at``; else every start that has n words after it)."""
    if at is None:
        at = np.arange(max(0, len(words) - n + 1))
    with np.errstate(over="ignore"):
        out = np.full(len(at), n, np.uint64)
        for j in range(n):
            out += words[at + j] * _AT_WORD[j % 4096]
    return splitmix(out)


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    """One 64-bit hash of a whole run of words, whatever its length."""
    with np.errstate(over="ignore"):
        position = splitmix(np.arange(1, len(words) + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        total = np.sum(words * (position | np.uint64(1)), dtype=np.uint64) + np.uint64(len(words))
    return int(splitmix(np.array([total], np.uint64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
