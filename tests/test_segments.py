"""Topics in files: order, bounded batches, start and loss options, restarts; sessions that go on after one."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from cardwarden.sources import events as ev
from cardwarden.sources import segments
from cardwarden.sources.segments import SegmentReader, write_segments
from cardwarden.catalog import fixed_forest
from cardwarden.streaming.lifecycle import ModelStore, TrainingPolicy
from cardwarden.streaming.scoring import ScoringJob
from test_streams import ONCE, TINY, message, write_lines


@pytest.fixture
def topic(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("m"), "id").alias("value"))
    write_segments(rows, str(tmp_path / "topics" / "t"), F.when(F.col("id") < 80, 0).otherwise(1), ["id"], 30)
    return tmp_path / "topics"


def options(topic, **more):
    return {**ev.kafka_options("", "t", 40), "path": str(topic), "startingOffsets": "earliest"} | more


def test_segments_hold_offsets_in_order(topic):
    held = SegmentReader(options(topic))._segments()
    assert {p: [b for b, _ in s] for p, s in held.items()} == {0: [0, 30, 60], 1: [0]}
    reader = SegmentReader(options(topic))
    assert reader.initialOffset() == {"0": 0, "1": 0} and SegmentReader(options(topic, startingOffsets="latest")).initialOffset() == {"0": 80, "1": 20}
    rows = [r for s in reader.partitions({"0": 25, "1": 3}, {"0": 65, "1": 5}) for b in reader.read(s) for r in b.to_pylist()]
    assert [(r["partition"], r["offset"], r["value"]) for r in rows] == [(0, i, f"m{i}") for i in range(25, 65)] + [(1, 3, "m83"), (1, 4, "m84")]


def test_batches_are_bounded_and_shared(topic):
    reader, at = SegmentReader(options(topic)), []
    reader.initialOffset()
    for _ in range(4):
        at.append(reader.latestOffset())
    assert [sum(a.values()) for a in at] == [40, 80, 100, 100] and at[0] == {"0": 32, "1": 8}
    assert SegmentReader(options(topic, maxOffsetsPerTrigger="0")).latestOffset() == {"0": 80, "1": 20}


def test_lost_segments(topic):
    segment = topic / "t" / "partition=0" / "base=0"
    shutil.rmtree(segment)
    with pytest.raises(ValueError, match="lost"):
        SegmentReader(options(topic, failOnDataLoss="true")).partitions({"0": 0}, {"0": 40})
    slices = SegmentReader(options(topic)).partitions({"0": 0}, {"0": 40})
    assert [(s.start, s.end) for s in slices] == [(30, 40)]
    assert SegmentReader(options(topic)).partitions({"0": 0}, {"0": 20}) == []


def drain(query, total):
    try:
        while query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < total:
            query.processAllAvailable()
    finally:
        query.stop()


def test_a_restart_goes_on_at_the_committed_offset(spark, topic, tmp_path):
    taken = []

    def start():
        stream = ev.read_events(spark, segments.register(spark), options(topic, progressFile=str(tmp_path / "at.json")))
        return stream.writeStream.foreachBatch(lambda rows, n: taken.append((n, [tuple(r) for r in rows.collect()]))).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()

    drain(start(), 30)
    before = len(taken)
    assert 1 <= before and json.loads((tmp_path / "at.json").read_text())
    drain(start(), 100 - sum(len(r) for _, r in taken))
    rows = [r for n, part in dict(taken).items() for r in part]
    assert sorted((p, o) for p, o, _ in rows) == [(0, i) for i in range(80)] + [(1, i) for i in range(20)]
    assert all(len(part) <= 40 for _, part in taken)


@pytest.mark.parametrize("stops", [[4], [1, 2, 4], [2, 4]])
def test_a_resumed_session_trains_at_the_same_row(spark, tmp_path, stops):
    clock = [1000.0]
    policy = TrainingPolicy(warmup_size=50, window_size=70, retrain_seconds=0)
    source, done = tmp_path / "in", 0
    for stop in stops:
        for i in range(done, stop):
            write_lines(source, f"{i}.txt", [message(j) for j in range(i * 30, i * 30 + 30)])
            os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))
        done = stop
        job = ScoringJob(spark, str(tmp_path / "out"), policy=policy, forest=TINY, clock=lambda: clock[0], threshold=0.0, resume=True)
        job.start(ev.read_events(spark, "text", {"maxFilesPerTrigger": "1"}, str(source)), str(tmp_path / "cp"), ONCE).awaitTermination()
    rows = job.table("transactions_enriched").groupBy("model_version", "is_warmed_up").count().collect()
    # 60 rows are enough after the second file; each later file trains again on the window
    assert {(r["model_version"], r["is_warmed_up"]): r["count"] for r in rows} == {(None, False): 60, (1, True): 30, (2, True): 30}
    assert {r["transaccionID"] for r in job.window_rows().collect()} == {f"t{i:04d}" for i in range(50, 120)}
    assert job.models.load().version == 3 and job.table("batch_log").select("session_id").distinct().count() == 1


def test_the_model_store_keeps_a_few_versions(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "model"), keep=2)
    assert store.load() is None
    for n in range(5):
        store.save(fixed_forest(spark), f"s{n}", float(n))
    assert store.versions() == [5, 4] and store.load().version == 5 and store.load().session_id == "s4"
    assert sorted(os.listdir(tmp_path / "model" / "nodes")) == ["4", "5"]
    os.makedirs(tmp_path / "model" / "models" / "6")  # its writer died half-way
    assert store.load().version == 5
