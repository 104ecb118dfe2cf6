"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

Sources get blocks by the highest quotients target / (2 * seats + 1); each source's blocks go to its shards the same way, by shard
size.  In a shard the documents stand in a seeded order as one run of words, cut into blocks; a quota of q of n blocks takes the whole
run q // n times and then those blocks k for which (a * k + b) mod n < q mod n, with a prime to n: exactly that many, without a sort.

Seats need not be dealt one by one: with S parties and N blocks, divisors total / (N + S / 2) and total / (N - S / 2) give every party
a lower and an upper count, and only the at most 2 * S seats between them are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.llm.common import in_order, read, stage, tidy

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_TOKENS = 32
SHARD_TOKENS = 1 << 16
SEED = 20240917


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, weight: str, blocks: str, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``quota``: Sainte-Lague seats among the rows of each ``by`` group (rows are parties: one per source or shard).

    ``blocks`` names the group's number of seats, the same in all its rows.  ``key``, columns without nulls, names a party within all of ``parties``; ties go by it.
    Parties of no weight get none.  Seats are ranked by range over all groups, so a group of any size spreads over tasks.
    """
    by = by or []
    one = F.lit(1).cast("long")
    totals = parties.withColumn("_all", F.lit(0)).groupBy("_all", *by).agg(F.sum(weight).alias("_total"), F.sum(F.when(F.col(weight) > 0, 1.0).otherwise(0.0)).alias("_count"))
    total, count, n = F.col("_total"), F.col("_count"), F.col(blocks).cast("double")
    joined = parties.withColumn("_all", F.lit(0)).join(stage(totals, "weights"), ["_all", *by]).drop("_all")
    bounded = (
        joined.withColumn("_low", F.when((F.col(weight) > 0) & (n > count / 2 + 1), F.greatest(F.lit(0.0), F.floor(F.col(weight) * (n - count / 2 - 1) / total + 0.5))).otherwise(0.0))
        .withColumn("_high", F.when(F.col(weight) > 0, F.floor(F.col(weight) * (n + count / 2 + 1) / total + 0.5) + 1).otherwise(0.0))
        .withColumn("_low", F.col("_low").cast("long"))
        .withColumn("_high", F.greatest("_low", F.least(F.col("_high").cast("long"), F.col(blocks))))
    )
    bounded = stage(bounded.drop("_total", "_count"), "bounded")
    contested = bounded.where(F.col("_high") > F.col("_low")).select(*dict.fromkeys([*key, *by]), weight, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    contested = contested.withColumn("_quotient", F.col(weight) / (2 * F.col("_seat") + 1)).withColumn("_one", one)
    ranked = in_order(contested, [*(F.col(c) for c in by), F.col("_quotient").desc(), *(F.col(c) for c in key), F.col("_seat")], {"_rank": "_one"}, "seats")
    ranked = stage(ranked.withColumn("_all", F.lit(0)), "ranked")
    open_ = bounded.withColumn("_all", F.lit(0)).groupBy("_all", *by).agg((F.max(blocks) - F.sum("_low")).alias("_open"))
    first = ranked.groupBy("_all", *by).agg(F.min("_rank").alias("_first")).join(open_, ["_all", *by])
    won = ranked.join(stage(first, "open"), ["_all", *by]).where(F.col("_rank") - F.col("_first") < F.col("_open")).groupBy(*key).agg(F.count("*").alias("_won"))
    return bounded.join(won, key, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add target (double) to ``totals`` (_source, source, source_size): one row per source, _source being its name without nulls.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words; no target passes ``most`` times its
    source's size, and the excess goes to the others by weight until none is above: each gets min(most * size, level * weight), the
    level being found over the sources sorted by most * size / weight.
    """
    ordered = [F.col("source").isNull(), F.col("source")]
    placed = in_order(totals.withColumn("_one", F.lit(1).cast("long")), ordered, {"_at": "_one"}, "sources").drop("_one")
    weighed = placed.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_at", F.lit(len(weights))) + 1).cast("int")))
    weighed = stage(weighed.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight")), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    if not whole["size"]:
        return weighed.select(*totals.columns, F.lit(0.0).alias("target"))
    filled = in_order(weighed, [F.col("_ratio"), *ordered], {"_caps": "_cap", "_weights": "_weight"}, "filled")
    level = (F.lit(share * whole["size"]) - F.col("_caps")) / (F.lit(whole["weight"]) - F.col("_weights"))
    lowest = filled.withColumn("_level", level).where(F.col("_level") <= F.col("_ratio")).agg(F.min(F.struct("_ratio", "_level"))["_level"]).first()[0]
    target = F.col("_cap") if lowest is None else F.least("_cap", F.lit(lowest) * F.col("_weight"))
    return weighed.select(*totals.columns, target.cast("double").alias("target"))


@tidy
def mix(docs: DataFrame, *, text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """How many words of each document (doc_id, source, ``text``) the mix takes.

    Returns a row per document: doc_id, source, size, source_size, target, taken, passes (whole copies) and ranges
    (array<struct<first,last>>: words taken once more).  Null and empty texts have size 0 and taken 0; a null source is a source; repeated
    rows are documents of their own, whose order among themselves is of no account because they are equal.  A very long text is laid whole in one shard, which is the larger for it.
    Other columns, whatever their names, are not read and not returned.  An empty table gives
    no rows.  Words are ``[^\\x20\\x09-\\x0D]+``.  Shards have about ``shard_tokens`` words, or a sixteenth as many documents; sources and shards are ranked by range.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # one name for null and other sources
    sizes = stage(docs.select("doc_id", "source", key.alias("_source"), word_count(text).alias("size")), "sizes")
    totals = sizes.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    targets = stage(source_targets(totals, weights, share, most), "targets")
    blocks = targets.agg(F.round(F.sum("target") / block_tokens).cast("long")).first()[0] or 0
    quotas = apportion(targets.withColumn("_seats", F.lit(blocks)), "target", "_seats", ["_source"]).withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("_shards", F.greatest(F.lit(1), F.ceil((F.col("source_size") + 16 * F.col("_docs")) / shard_tokens)).cast("long"))
    quotas = stage(quotas.select("_source", "source_size", "target", "source_quota", "_shards"), "quotas")

    placed = sizes.withColumn("_place", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = placed.join(F.broadcast(quotas) if _few(quotas) else quotas, "_source")
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_place"), F.col("_shards")))
    shards = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_size"), F.first("source_quota").alias("source_quota"))
    shards = apportion(stage(shards, "parties"), "_size", "source_quota", ["_source", "_shard"], ["_source"])
    n = F.ceil(F.col("_size") / block_tokens).cast("long")
    shards = shards.select("_source", "_shard", n.alias("_n"), F.col("quota").alias("_quota"))
    shards = stage(shards.withColumn("_step", _prime_step("_n", seed)).withColumn("_shift", F.pmod(F.xxhash64(F.lit(seed + 3), "_source", "_shard"), F.greatest("_n", F.lit(1)))), "shards")

    run = Window.partitionBy("_source", "_shard").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_from", F.coalesce(F.sum("size").over(run), F.lit(0)).cast("long"))
    laid = laid.join(shards, ["_source", "_shard"])
    passes = F.when(F.col("_n") > 0, F.least(F.lit(int(most)), F.expr("_quota div _n"))).otherwise(0).cast("long")
    laid = laid.withColumn("passes", passes).withColumn("_more", F.when((F.col("_n") > 0) & (F.col("passes") < int(most)), F.expr("_quota % _n")).otherwise(0))
    laid = laid.withColumn("_blocks", F.expr(f"if(size > 0 and _more > 0, sequence(_from div {block_tokens}, (_from + size - 1) div {block_tokens}), array())"))
    chosen = F.expr(f"""transform(filter(_blocks, k -> (k * _step + _shift) % _n < _more), k -> struct(
        greatest(k * {block_tokens} - _from, 0L) as first, least((k + 1) * {block_tokens} - _from, size) - 1 as last))""")
    laid = laid.withColumn("ranges", chosen)
    taken = F.col("passes") * F.col("size") + F.expr("aggregate(ranges, 0L, (t, x) -> t + x.last - x.first + 1)")
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "ranges")


def mixed_texts(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mix, (doc_id, piece, text): each document's whole text as often as ``passes`` says, then its ``ranges`` joined by spaces.

    Documents are joined by doc_id, which has to name them; those without one or of no taken words, null and empty texts among them, give nothing.
    Very long texts are cut whole; other columns are not read; empty tables give no rows.
    """
    joined = docs.select("doc_id", F.col(text).alias("_text")).join(mixed.where("taken > 0").select("doc_id", "passes", "ranges"), "doc_id")
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("ranges", lambda x: F.slice(words, (x["first"] + 1).cast("int"), (x["last"] - x["first"] + 1).cast("int")))), " ")
    pieces = F.concat(F.array_repeat("_text", F.col("passes").cast("int")), F.when(F.size("ranges") > 0, F.array(some)).otherwise(F.array().cast("array<string>")))
    return joined.select("doc_id", F.posexplode(pieces).alias("piece", "text"))


def _few(quotas: DataFrame, most: int = 100_000) -> bool:
    """Whether so few sources are there that their quotas may be broadcast; else they are joined by a shuffle."""
    return quotas.count() <= most


def _prime_step(n: str, seed: int) -> Column:
    """A step below ``n`` and prime to it: the first of 64 seeded numbers whose greatest common divisor with n is 1, or else 1."""
    def gcd(a: Column, b: Column) -> Column:
        state = F.struct(a.alias("a"), b.alias("b"))
        steps = F.sequence(F.lit(1), F.lit(90))
        return F.aggregate(steps, state, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.greatest(s["b"], F.lit(1))).alias("b"))), lambda s: s["a"])

    size = F.greatest(F.col(n), F.lit(1))
    tries = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_source"), F.col("_shard"), i), size) + 1)
    fit = F.filter(tries, lambda a: gcd(size, a) == 1)
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(1)).cast("long")


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
