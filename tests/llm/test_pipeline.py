"""The pipeline's stages against what brute force decides on the same small input."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def make(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(80) + "\n" + text(60) for _ in range(60)]
    passage = text(40)
    shared = text(55)
    toxic = [f"{text(20)} idiot {text(9)} moron you {text(20)} worthless scum" for _ in range(30)]
    near = []
    for t in clean[:10]:
        w = t.replace("\n", " \n ").split(" ")
        w[7] = "changed"
        w[30] = "twice"
        w[50] = "thrice"
        near.append(" ".join(w))
    rows = [*[("clean", t) for t in clean], *[("toxic", t) for t in toxic], *[("copy", t) for t in clean[:5]], *[("near", t) for t in near], *[("bench", f"{text(20)} {passage} {text(20)}") for _ in range(5)], *[("line", f"{text(30)}\n{shared}") for _ in range(6)], ("clean", ""), ("clean", None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, (_, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, (k, _) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, docs, shared


def test_stages_decide_as_planted(spark, tmp_path):
    rows, docs, shared = make(spark, tmp_path)
    kind = [k for k, _ in rows]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    kept, current = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = stage(spark, current, str(tmp_path))
        if k < 4:
            assert current.columns == docs.columns
        path = str(tmp_path / f"stage{k}")
        current.write.parquet(path)
        current = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in current.collect()})
    ids = lambda *names: {i for i, k in enumerate(kind) if k in names}
    assert set(kept[0]) == ids("clean", "copy", "near", "bench", "line")
    assert set(kept[1]) == set(kept[0]) - ids("copy")
    assert sum(shared in (r.text or "") for r in kept[1].values()) == 1
    assert ids("clean", "line") <= set(kept[2]) and not set(kept[2]) & ids("copy")
    assert set(kept[3]) == set(kept[2]) - ids("bench")
    assert set(kept[4]) <= set(kept[3]) and all(r.taken > 0 for r in kept[4].values())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.taken for r in again.collect()} == {d: r.taken for d, r in kept[4].items()}
    assert again.where(F.col("taken") > 2 * F.col("size")).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    """Of five equal rows one is left, whatever their ids; other rows that share or lack an id stay as they are."""
    t = "a quick brown fox jumps over the lazy dog and runs into the deep dark woods again"
    rows = [(1, t), (1, t), (2, t), (None, t), (None, t), (1, "quite another text of many words that shares the id of the first one"), (None, "and one more text of several words that has no id at all today"), (None, None), (None, ""), (3, "")]
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA).withColumn("_row", F.lit("clash"))
    copies = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in copies) == sorted([(t, 1), *[(x or "", i or 0) for i, x in rows[5:]]])
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in lines) == sorted([(t, 1), *[(x or "", i or 0) for i, x in rows[5:]]])


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, docs, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_results_of_two_runs_can_both_be_read(spark, tmp_path):
    rows, docs, _ = make(spark, tmp_path)
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count()
    assert sorted(first.collect()) == sorted(second.collect())
