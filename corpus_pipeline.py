"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

``run(spark, sf_dir)`` applies STAGES to ``documents``.  All but the last return the columns of documents.  Stages take rows as they come: a
row is a document of its own, whether or not others share its doc_id or have none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline.llm import decontaminate, jaccard, lines, mixing, toxicity
from arcline.llm.common import key_filter, read, scratch, scratch_dir, stage, with_maybe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key`` (last, id, row), staged: unlike doc_id it names one row, and its order is that of doc_id, nulls last."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))
    return stage(docs.select(*COLUMNS, key.alias("_key")), "numbered")


def _texts(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("_key").alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those that it can't judge (null and empty ones) stay.

    Rows are judged one by one, repeated ones and those without doc_id too; labels are learnt by doc_id.  Empty tables give no rows.
    """
    model = toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one repeats or nearly repeats go, and documents of which nothing is left; n_chars follows the text.

    Earlier is by doc_id, null ids last, then by row, then by line; so of repeated rows one keeps its lines.  Null and empty texts stay.
    """
    numbered = _numbered(docs)
    left = lines.remove_lines(numbered, lines.near_duplicates(_texts(numbered)), doc_id="_key")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest doc_id (null ids last); documents without words stay all."""
    numbered = _numbered(docs)
    groups = jaccard.join(_texts(numbered))
    gone = stage(groups.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id.row").alias("_row")), "gone")
    marked = with_maybe(numbered.withColumn("_at", F.col("_key.row")), "_at", key_filter(gone, "_row"))
    left = marked.where("_maybe").join(gone, F.col("_at") == F.col("_row"), "left_anti")
    return marked.where(~F.col("_maybe")).unionByName(left).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages beyond the rule's share go; the others stay as they are, null and empty texts too."""
    marked = decontaminate.mark(docs, read(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with their source's target, the words taken, whole passes and ranges of a further one.

    Rows of a null source are a source; rows without words are never taken; an empty table gives no rows.
    """
    mixed = mixing.mix(docs)
    return mixed.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "ranges")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier, edit distances in whole tables and MinHash have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what all stages keep.  A stage's scratch tables go once its result is written; the stages' results and the mix's table
    stay under ``spark.checkpoint.dir``, because the returned DataFrame reads the latter."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, function in STAGES[:-1]:
        with scratch(spark):
            function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
