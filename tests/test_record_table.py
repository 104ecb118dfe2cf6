"""The record table on disk: what an upsert touches, versions, checks, and a stream that is started again."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from arcline.operators import records
from arcline.sources.record_table import Outrun, RecordTable
from arcline.streaming import requests


def rows(spark, ids, **changed):
    made = [{"id": f"i{k}", "job_id": f"j{k}", "created_at": f"2026-01-{k % 28 + 1:02d}", "recorded_at": "2026-01-01", "match_type": "singles", "decision": "IN", "job_result_json": "{}", "confidence": k / 10} | changed for k in ids]
    return spark.createDataFrame([tuple(m.get(f.name) for f in records.SCHEMA) for m in made], "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in records.SCHEMA) + ">")


def content(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    t = RecordTable(spark, str(tmp_path_factory.mktemp("records")), 64)
    t.upsert(rows(spark, range(500)), ("load", 0))
    return t


def test_a_small_batch_rewrites_its_buckets_only(spark, table):
    before, files = content(table.read()), table.manifest()["files"]
    done = table.upsert(rows(spark, range(10), decision="OUT", id=None).withColumn("id", F.concat(F.lit("n"), "job_id")))
    after = table.manifest()["files"]
    assert len(files) > 60 and 0 < len(done.touched) <= 10 and {int(b) for b in after if after[b] != files[b]} == set(done.touched)
    got = {r.job_id: r for r in table.read().collect()}
    assert len(got) == 500 and all((got[f"j{k}"].id, got[f"j{k}"].decision) == (f"i{k}", "OUT" if k < 10 else "IN") for k in range(500))
    assert content(table.read(done.version - 1)) == before


def test_a_batch_that_comes_again_changes_nothing(spark, table):
    batch = rows(spark, range(490, 505), decision="UNKNOWN")
    first = table.upsert(batch, ("w", 3))
    once = content(table.read())
    assert len(once) == 505
    again = table.upsert(batch, ("w", 3))
    assert (again.version, again.touched) == (first.version, ()) and content(table.read()) == once
    table.upsert(batch, ("w", 4))
    assert content(table.read()) == once


def test_find_opens_one_bucket(spark, table):
    found = table.find("j42")
    assert [r.id for r in found.collect()] == ["i42"] and len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) == 1
    assert table.find("nobody").count() == 0


def test_rows_that_break_a_rule_are_set_apart(spark, table):
    wrong = rows(spark, [900], id="i7").unionByName(rows(spark, [901, 902], id="same")).unionByName(rows(spark, [903], match_type="mixed")).unionByName(rows(spark, [904], decision=None)).unionByName(rows(spark, [7], confidence=9.0))
    done = table.upsert(wrong)
    apart = {r.job_id: r.violated for r in table.rejected(done.version).collect()}
    assert apart == {"j900": ["id_of_another_job"], "j902": ["id_repeated"], "j903": ["match_type"], "j904": ["decision"]} and done.rejected == 4
    got = {r.job_id: r for r in table.read().collect()}
    assert "j901" in got and got["j7"].confidence == 9.0 and not set(apart) & set(got)
    assert table.rejected(1) is None
    ids = [r.id for r in got.values()]
    assert len(set(ids)) == len(ids)


def test_a_writer_that_is_outrun_is_told(spark, table, monkeypatch):
    last = table.manifest()
    monkeypatch.setattr(RecordTable, "manifest", lambda self, version=None: {**last, "version": last["version"] - 1})
    with pytest.raises(Outrun):
        table.upsert(rows(spark, [1]))


def test_the_latest_of_repeated_jobs_counts_and_old_files_go(spark, tmp_path):
    t = RecordTable(spark, str(tmp_path), 4)
    assert t.read().count() == 0 and t.versions() == []
    t.upsert(rows(spark, [1, 1], id="a", created_at="2026-01-01").unionByName(rows(spark, [1], id="b", created_at="2026-01-02", decision="OUT")))
    assert [(r.id, r.decision) for r in t.read().collect()] == [("b", "OUT")]
    assert t.upsert(rows(spark, [])).touched == ()
    t.upsert(rows(spark, [2]).select("id", "job_id", "created_at", "recorded_at", "match_type", "decision", "job_result_json"))
    want = content(t.read())
    assert t.vacuum() >= 1 and t.versions() == [3] and content(t.read()) == want and len(want) == 2


def test_a_stream_that_starts_again_gives_the_same_table(spark, tmp_path):
    t, source = RecordTable(spark, str(tmp_path / "table"), 8), tmp_path / "in"
    source.mkdir()

    def land(name, jobs):
        (source / name).write_text("".join(json.dumps({"job_id": j, "session_id": s}) + "\n" for j, s in jobs))

    def to_records(batch):
        return batch.select(F.expr("uuid()").alias("id"), "job_id", F.col("session_id").alias("created_at"), F.lit("t").alias("recorded_at"), F.lit("singles").alias("match_type"), F.lit("IN").alias("decision"), F.lit("{}").alias("job_result_json"))

    def run(checkpoint):
        requests.record_stream(requests.request_stream(spark, str(source)), to_records, t, str(tmp_path / checkpoint)).awaitTermination()

    land("a.json", [("x", "1"), ("y", "1"), ("x", "2")])
    run("c")
    first = content(t.read())
    assert [(r[2], r[3]) for r in sorted(first, key=lambda r: r[2])] == [("x", "2"), ("y", "1")]
    run("other")  # the same batch number of the same writer, as after a crash between publishing and the stream's own commit
    assert content(t.read()) == first
    land("b.json", [("y", "9"), ("z", "9")])
    run("c")
    got = {r.job_id: r.id for r in t.read().collect()}
    assert set(got) == {"x", "y", "z"} and got["x"] in {r[0] for r in first} and got["y"] in {r[0] for r in first}
