"""Day tables: batches once, one version for a reader, bounded files, key filters, memory of a stream."""

import os

import numpy as np
from pyspark.sql import functions as F

from cardwarden import schemas
from cardwarden.sinks import daytable
from cardwarden.sinks.daytable import UNDATED, DayTable, create_file, filter_bits, may_hold
from cardwarden.sinks.outbox import Outbox
from cardwarden.sinks.tables import drop_expired
from cardwarden.sources import events as ev
from cardwarden.streaming import scoring
from cardwarden.streaming.dimensions import user_table
from cardwarden.streaming.memory import split_witnesses, with_witnesses
from cardwarden.streaming.scoring import ScoringJob
from test_streams import ONCE, contents, message, replayable, write_lines

SCHEMA = "k string, v int, d string"


def day_rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("d")).drop("d")


def numbers(spark, low, high, day="2024-01-01"):
    return spark.range(low, high).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"),
                                         F.lit(day).cast("date").alias("day"))


def test_a_batch_is_stored_once_on_each_day(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "k")
    rows = day_rows(spark, [("a", 1, "2024-01-01"), ("b", 2, "2024-01-02"), ("c", 3, None)])
    assert sorted(table.append(rows, "w", 0)) == ["2024-01-01", "2024-01-02", UNDATED]
    assert table.append(rows, "w", 0) == []
    assert table.append(rows.filter("k = 'a'"), "w", 1) == ["2024-01-01"]
    assert table.append(rows.limit(0), "w", 2) == []
    assert sorted(map(tuple, table.read().select("k", "batch_id").collect())) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert table.read(["2024-01-02", None]).count() == 2 and table.read([]) is None
    assert not os.listdir(tmp_path / "t" / "_staging")


def test_two_hundred_micro_batches_end_in_few_files(spark, tmp_path):
    clock = [0.0]
    table = DayTable(spark, str(tmp_path / "t"), None, max_files=20, clock=lambda: clock[0])
    for n in range(200):
        table.append(numbers(spark, n * 3, n * 3 + 3).coalesce(1), "w", n)
        clock[0] += 5
        assert len(table.live_files()) <= 20
    got = table.read().agg(F.count("*"), F.countDistinct("k"), F.sum("v"), F.countDistinct("batch_id")).first()
    assert tuple(got) == (600, 600, sum(range(600)), 200)
    clock[0] += 1e6
    table.compact("2024-01-01")
    on_disk = [f for f in os.listdir(tmp_path / "t" / "day=2024-01-01") if f.endswith(".parquet")]
    assert sorted(on_disk) == sorted(os.path.basename(f) for f in table.live_files())
    assert len([f for f in os.listdir(tmp_path / "t" / "day=2024-01-01") if f.startswith("_manifest")]) <= 2


def test_a_reader_keeps_its_version_during_a_compaction(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "k", max_files=100)
    for n in range(6):
        table.append(numbers(spark, n * 10, n * 10 + 10), "w", n)
    before = table.read()
    files = set(table.live_files())
    table.max_files = 2
    table.compact("2024-01-01")
    assert not files & set(table.live_files())
    assert before.count() == 60 == table.read().count()
    # every key can still be found, and only in the files of now
    assert table.not_stored(numbers(spark, 55, 65), "x", 0, ["2024-01-01"]).count() == 5


def test_a_lost_race_is_seen(spark, tmp_path, monkeypatch):
    table, other = (DayTable(spark, str(tmp_path / "t"), None, max_files=100) for _ in range(2))
    table.append(numbers(spark, 0, 5), "w", 0)
    real, first = daytable.create_file, []

    def late(spark, path, text):
        if not first:
            first.append(1)
            other.append(numbers(spark, 5, 9), "v", 0)
        return real(spark, path, text)

    monkeypatch.setattr(daytable, "create_file", late)
    table.append(numbers(spark, 9, 12), "w", 1)
    assert table.read().count() == 12
    # a manifest whose writer died half-way is passed over
    version = table.manifest("2024-01-01").version + 1
    assert create_file(spark, table._manifest_path("2024-01-01", version), '{"files": {')
    assert not create_file(spark, table._manifest_path("2024-01-01", version), "")
    assert table.read().count() == 12
    table.append(numbers(spark, 12, 13), "w", 2)
    assert table.read().count() == 13 and table.manifest("2024-01-01").version == version + 1


def test_key_filters_rule_files_out(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "k", max_files=3, file_bytes=3000)
    for n in range(8):
        table.append(numbers(spark, n * 1000, n * 1000 + 1000).coalesce(1), "w", n)
    some = numbers(spark, 3500, 3510)
    assert 1 <= len(table.files_that_may_hold(some, ["2024-01-01"])) < len(table.live_files())
    assert table.files_that_may_hold(numbers(spark, 10**6, 10**6 + 1), ["2024-01-01"]) == []
    batch = numbers(spark, 7990, 8010)
    plain = batch.join(table.read().select("k"), "k", "left_anti")
    assert sorted(r["k"] for r in table.not_stored(batch, "x", 0, ["2024-01-01"]).collect()) == sorted(r["k"] for r in plain.collect())
    plan = table.not_stored(some, "x", 0, ["2024-01-01"])._jdf.queryExecution().executedPlan().toString()
    opened = len(table.files_that_may_hold(some, ["2024-01-01"]))
    assert f"InMemoryFileIndex({opened} paths)" in plan


def test_few_absent_keys_seem_present():
    rng = np.random.default_rng(5)
    held, absent = rng.integers(-2**63, 2**63 - 1, (2, 20_000))
    bits = filter_bits(held)
    assert may_hold(bits, held).all() and may_hold(bits, absent).mean() < 0.02
    assert not may_hold(filter_bits(held[:0]), absent).any()


def test_undated_rows_expire_by_the_time_they_came(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "k", clock=lambda: 86400.0 * 10)
    table.append(day_rows(spark, [("a", 1, None)]), "w", 0)
    table.clock = lambda: 86400.0 * 20
    table.append(day_rows(spark, [("b", 1, None)]), "w", 1)
    assert drop_expired(spark, table.path, "1970-01-16") == [UNDATED]
    assert [r["k"] for r in table.read().collect()] == ["b"]
    assert drop_expired(spark, table.path, "1970-01-16") == []


# --- replays and memory ------------------------------------------------------------------


def test_a_batch_repeated_after_midnight_adds_nothing(spark, tmp_path, monkeypatch):
    write_lines(tmp_path / "in", "a.txt", [message(1), message(2, fecha_hora_transaccion=None)])
    batch = ev.parse_events(spark.read.text(str(tmp_path / "in")), schemas.TRANSACTION)
    job = replayable(spark, str(tmp_path / "out"))
    job.process(batch, 0)
    before = contents(spark, job.folder)
    assert before["transactions_raw"] == (2, 2)
    monkeypatch.setattr(scoring.F, "current_date", lambda: F.lit("2031-05-05").cast("date"))
    job.process(batch, 0)
    job.process(batch, 1)
    assert contents(spark, job.folder) == before


def stream_of(spark, folder, files=1):
    return ev.read_events(spark, "text", {"maxFilesPerTrigger": str(files)}, str(folder))


def test_ids_are_remembered_across_days(spark, tmp_path):
    source = tmp_path / "in"
    later = {"fecha_hora_transaccion": "2024-01-09 10:00:00"}
    lines = [[message(1), message(2)], [message(1, **later), message(3), message(3, TransactionAmt=5.0)],
             [message(2, fecha_hora_transaccion=None), message(3), message(1)]]
    for i, part in enumerate(lines):
        write_lines(source, f"{i}.txt", part)
        os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))
    job = ScoringJob(spark, str(tmp_path / "out"))
    job.start(stream_of(spark, source), str(tmp_path / "cp"), ONCE).awaitTermination()
    assert job.table("transactions_raw").count() == 3 == job.table("transactions_enriched").count()
    first = job.table("transactions_raw").filter("transaccionID = 't0003'").collect()
    assert [r["TransactionAmt"] for r in first] == [13.0]
    # the state outlives a restart
    write_lines(source, "9.txt", [message(1, fecha_hora_transaccion="2024-02-01 10:00:00"), message(8)])
    again = ScoringJob(spark, job.folder)
    again.start(stream_of(spark, source), str(tmp_path / "cp"), ONCE).awaitTermination()
    assert job.table("transactions_raw").count() == 4


def test_witnesses_go_back_to_one_read_of_the_source(spark, tmp_path):
    write_lines(tmp_path / "in", "a.txt", [message(1), message(1), message(2)])
    parsed = ev.parse_events(stream_of(spark, tmp_path / "in"), schemas.TRANSACTION)
    seen = []

    def note(batch, _):
        rows, new = split_witnesses(batch.persist(), "transaccionID")
        seen.append((rows.count(), sorted(r[0] for r in new.collect())))

    query = with_witnesses(parsed, "transaccionID", "1 hour").writeStream.foreachBatch(note).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start()
    query.awaitTermination()
    assert seen[0] == (3, ["t0001", "t0002"])
    assert len(query.lastProgress["sources"]) == 1
    assert split_witnesses(spark.range(3), "id")[1] is None


# --- dimensions in buckets ----------------------------------------------------------------


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    table = user_table(spark, str(tmp_path / "users"))
    names = [f for f in table.schema.names if f != "usuarioID"]
    users = spark.range(300).select(F.col("id").cast("string").alias("usuarioID"), F.lit(1).alias("arrival"), *[
        F.lit(None).cast(table.schema[n].dataType).alias(n) for n in names])
    table.upsert(users, "s1", 0)
    table.compact()
    held = table._pointer()["buckets"]
    assert len(held) == table.buckets and set(held.values()) == {1}
    for n in range(5):
        table.upsert(users.filter("usuarioID = '7'").withColumn("usuario", F.lit(f"name {n}")), "s1", n + 1)
        table.compact()
        now = table._pointer()["buckets"]
        assert [v for v in now.values()].count(n + 2) == 1 and sum(now[b] != held[b] for b in now) == 1
    rows = table.snapshot()
    assert rows.count() == 300 and rows.filter("usuario = 'name 4'").count() == 1
    assert sorted(os.listdir(tmp_path / "users" / "versions")) == ["5", "6"]
    folders = [f for v in os.listdir(tmp_path / "users" / "buckets") for f in os.listdir(tmp_path / "users" / "buckets" / v)
               if f.startswith("bucket=")]
    assert len(folders) == table.buckets + 1  # the last version's and the one it replaced
    # a version whose writer died half-way is passed over
    assert create_file(spark, table._pointer_path(7), '{"version"')
    assert table.snapshot().count() == 300
    table.upsert(users.limit(1), "s2", 0)
    assert table.compact() == 8


# --- outbox -------------------------------------------------------------------------------


def test_an_outbox_sends_every_row_once(spark, tmp_path):
    outbox, topic = Outbox(spark, str(tmp_path / "o")), []
    feed = lambda low, high: spark.range(low, high).select(
        F.format_string("%04d", "id").alias("key"), F.col("id").cast("string").alias("value"))

    def send(rows):
        topic.extend(sorted((r["number"], r["key"]) for r in rows.collect()))

    def sent():
        return max((n for n, _ in topic), default=None)

    assert outbox.put(feed(0, 30), "w", 0) and not outbox.put(feed(0, 30), "w", 0)
    assert outbox.publish(send, sent) == 30 and outbox.publish(send, sent) == 0
    assert outbox.put(feed(30, 31), "w", 1) and outbox.put(feed(31, 50).limit(0), "w", 2) and outbox.put(feed(31, 50), "v", 0)

    def dies(rows):
        send(rows)
        raise InterruptedError

    try:
        outbox.publish(dies, sent)
    except InterruptedError:
        assert outbox.published() == 30 and len(topic) == 31
    assert not outbox.put(feed(30, 31), "w", 1)
    assert outbox.publish(send, sent) == 19 and outbox.published() == 50
    assert topic == [(i, f"{i:04d}") for i in range(50)]
    assert len(outbox._files("entries")) == 1 and len(outbox._files("marks")) == 2
    # a sink that cannot tell gets the rows above the mark again
    assert outbox.put(feed(50, 52), "w", 3)
    try:
        outbox.publish(dies)
    except InterruptedError:
        outbox.publish(send)
    assert [n for n, _ in topic[50:]] == [50, 51, 50, 51]


def test_a_repeated_batch_sends_its_feed_once(spark, tmp_path):
    write_lines(tmp_path / "in", "a.txt", [message(i) for i in range(20)])
    batch = ev.parse_events(spark.read.text(str(tmp_path / "in")), schemas.TRANSACTION)
    topic = {}

    def job():
        return ScoringJob(spark, str(tmp_path / "out"), feeds=("enriched",), session_id="one",
                          feed_send=lambda feed, rows: topic.setdefault(feed, []).extend(rows.collect()))

    job().process(batch, 0)
    job().process(batch, 0)
    assert sorted(r["number"] for r in topic["enriched"]) == list(range(20)) and list(topic) == ["enriched"]
