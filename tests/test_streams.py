"""Stream results against the batch operators, replays, late starts and the model lifecycle."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cardwarden import jobs, schemas
from cardwarden.catalog import fixed_forest
from cardwarden.functions.scalars import secret_key
from cardwarden.operators.forest import ForestParams
from cardwarden.operators.joins import with_profile
from cardwarden.operators.projections import enriched_projection
from cardwarden.sinks import reports
from cardwarden.sinks.daytable import DayTable
from cardwarden.sinks.feeds import as_feed, discard, no_profiles
from cardwarden.session import delete_path
from cardwarden.sinks.tables import (
    DimensionTable, append_batch, append_first_wins, batch_days, drop_expired, full_refresh,
    not_stored_before,
)
from cardwarden.sources import events as ev
from cardwarden.sources import files
from cardwarden.sources import views as V
from cardwarden.streaming.dimensions import card_table, start_upserts, user_table
from cardwarden.streaming.lifecycle import ActiveModel, TrainingPolicy
from cardwarden.streaming.runner import StreamGroup
from cardwarden.streaming.scoring import ScoringJob

ONCE = {"availableNow": True}
TINY = ForestParams(trees=10, max_samples=64)


def message(i, **more):
    base = {
        "transaccionID": f"t{i:04d}", "usuarioID": f"u{i % 7}", "tarjetaID": f"c{i % 7}",
        "fecha_hora_transaccion": "2024-01-05 10:00:00", "TransactionAmt": 10.0 + i % 50,
        "TransactionDT": i * 60, "C1": i % 5, "D1": i % 9, "ProductCD": "W", "isFraud": int(i % 29 == 0)}
    return json.dumps({**base, **more})


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def text_stream(spark, folder):
    return ev.read_events(spark, "text", {"maxFilesPerTrigger": "1"}, str(folder))


def run(job, spark, source, checkpoint):
    job.start(text_stream(spark, source), str(checkpoint), ONCE).awaitTermination()


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    write_lines(folder, "a.txt", [message(i) for i in range(100)] + [
        "not json", '{"transaccionID":"bad1","TransactionAmt":"x"}',
        message(5, TransactionAmt=999.0)])
    return folder


def test_scored_rows_equal_the_batch_plan(spark, source, tmp_path):
    profiles = spark.createDataFrame([("u1", 20.0, 4.0)], schemas.PROFILE)
    job = ScoringJob(spark, str(tmp_path / "out"), profiles=lambda: profiles)
    run(job, spark, source, tmp_path / "cp")
    stored = job.table("transactions_enriched")
    assert stored.count() == 101 == job.table("transactions_raw").count()
    assert stored.filter("transaccionID = 't0005'").first()["TransactionAmt"] == 15.0
    assert stored.filter("transaccionID = 'bad1'").first()["TransactionAmt"] is None
    batch = ev.accepted(ev.parse_events(spark.read.text(str(source)), schemas.TRANSACTION),
                        "transaccionID").filter("TransactionAmt is null or TransactionAmt < 900")
    expected = enriched_projection(
        with_profile(batch, profiles).withColumn("score", F.lit(-1.0)), False)
    columns = [c for c in schemas.ENRICHED_COLUMNS if c != "processed_at"]
    assert stored.select(columns).exceptAll(expected.select(columns)).isEmpty()
    bad = {r["reason"]: r["n"] for r in job.table("quarantine").groupBy("reason").agg(
        F.count("*").alias("n")).collect()}
    assert bad == {"unreadable": 1, "wrong_type": 1}
    log = job.table("batch_log").first()
    assert log["rows"] == 101 and log["alerts"] == 0 and log["total_scored"] == 0


def contents(spark, out):
    """Rows of every output, as (table, rows, distinct rows)."""
    found = {}
    for table in ("transactions_raw", "transactions_enriched", "quarantine", "features", "batch_log",
                  "feed_alerts", "feed_scores", "feed_enriched"):
        path = os.path.join(out, table)
        if os.path.isdir(path):
            rows = spark.read.json(path) if table.startswith("feed") else spark.read.parquet(path)
            rows = rows.drop("written_by", "batch_id", "session_id")
            found[table] = (rows.count(), rows.distinct().count())
    return found


def replayable(spark, out):
    job = ScoringJob(spark, out, feeds=("alerts", "scores", "enriched"))
    job.models.save(fixed_forest(spark), "earlier", 0.0)
    return job


def test_a_batch_is_stored_in_few_files_whatever_the_width_of_the_state(spark, source, tmp_path):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        job = ScoringJob(spark, str(tmp_path / "out"))
        run(job, spark, source, tmp_path / "cp")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    for name in ("transactions_raw", "transactions_enriched"):
        table = DayTable(spark, job.path(name))
        for held in table.manifests(table.days()).values():
            assert len(held.files) == 1 and not held.retired
    assert job.table("transactions_raw").count() == 101
    assert not list((tmp_path / "out" / "staging").glob("*/*"))


def test_replays_add_nothing(spark, source, tmp_path):
    out = str(tmp_path / "out")
    run(replayable(spark, out), spark, source, tmp_path / "cp")
    before = contents(spark, out)
    assert before["quarantine"] == (2, 2) and before["transactions_raw"] == (101, 101)
    assert before["features"][0] == before["feed_enriched"][0] == before["feed_scores"][0] == 101
    run(replayable(spark, out), spark, source, tmp_path / "cp")
    run(replayable(spark, out), spark, source, tmp_path / "lost")
    assert contents(spark, out) == before
    write_lines(source, "b.txt", [message(i) for i in range(90, 130)])
    run(replayable(spark, out), spark, source, tmp_path / "cp")
    after = contents(spark, out)
    assert after["transactions_raw"] == after["transactions_enriched"] == (131, 131)
    assert after["feed_enriched"] == (131, 131) and after["batch_log"][0] == 2


@pytest.mark.parametrize("lost", [None, "transactions_raw", "transactions_enriched", "features", "feed_scores"])
def test_repeating_a_batch_restores_what_is_missing(spark, source, tmp_path, lost):
    """A retry inside a session, after a failure that left one output unwritten."""
    job = replayable(spark, str(tmp_path / "out"))
    batch = ev.parse_events(spark.read.text(str(source)), schemas.TRANSACTION)
    job.process(batch, 0)
    before = contents(spark, job.folder)
    if lost:
        assert delete_path(spark, job.path(lost))
    job.process(batch, 0)
    assert contents(spark, job.folder) == before
    assert job._seen == 101
    job.process(batch, 1)
    assert contents(spark, job.folder) == before


def test_empty_batch_changes_nothing(spark, source, tmp_path):
    job = replayable(spark, str(tmp_path / "out"))
    batch = ev.parse_events(spark.read.text(str(source)), schemas.TRANSACTION)
    job.process(batch.limit(0), 0)
    assert contents(spark, job.folder) == {}
    job.process(batch, 1)
    before = contents(spark, job.folder)
    job.process(batch.limit(0), 2)
    assert contents(spark, job.folder) == before


def test_stored_side_is_pruned_to_the_days_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", None)], "k string, d string")
    rows = rows.withColumn("day", F.to_date("d"))
    append_batch(rows, path, "k", "w", 0, batch_days(rows))
    batch = rows.filter("k = 'b'").unionByName(spark.createDataFrame(
        [("n", "2024-01-02", None)], rows.schema).withColumn("day", F.to_date("d")))
    fresh = not_stored_before(batch, path, "k", "w", 1, batch_days(batch))
    assert [r["k"] for r in fresh.collect()] == ["n"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("PartitionFilters: [")[1:]]
    assert any(f.startswith("isnotnull(day") and "2024-01-02" in f.split("]")[0] for f in filters)
    same = not_stored_before(batch, path, "k", "w", 0, batch_days(batch))
    assert sorted(r["k"] for r in same.collect()) == ["b", "n"]
    undated = rows.filter("k = 'c'")
    assert not_stored_before(undated, path, "k", "w", 1, batch_days(undated)).isEmpty()


def test_lifecycle_from_no_model_to_alerts_and_a_cached_model(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    clock = [1000.0]
    policy = TrainingPolicy(warmup_size=50, window_size=80, retrain_seconds=100)

    def job():
        return ScoringJob(spark, out, policy=policy, forest=TINY, clock=lambda: clock[0],
                          threshold=0.0)

    def versions(rows):
        return {(r["model_version"], r["is_warmed_up"]): r["count"]
                for r in rows.groupBy("model_version", "is_warmed_up").count().collect()}

    first = job()
    for i in range(3):
        write_lines(source, f"{i}.txt", [message(j) for j in range(i * 40, i * 40 + 40)])
        os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))
    run(first, spark, source, tmp_path / "cp")
    # 40 rows are not enough, 80 are: the third file is scored by the fresh model
    assert versions(first.table("transactions_enriched")) == {(None, False): 80, (1, True): 40}
    assert first.table("fraud_alerts").count() == 40
    assert first.models.load().forest.n_samples == 50
    feed = spark.read.json(first.path("feed_alerts"))
    assert feed.count() == 40 and "alerted_at" in feed.first()["value"]

    # a new session scores with the stored model but raises no alert until it has trained
    clock[0] = 2000.0
    write_lines(source, "3.txt", [message(j) for j in range(120, 180)])
    second = job()
    run(second, spark, source, tmp_path / "cp")
    rows = second.table("transactions_enriched")
    assert versions(rows)[(1, False)] == 60 and rows.filter("not is_warmed_up and is_suspicious").count() == 60
    assert second.table("fraud_alerts").count() == 40
    assert second.models.load().version == 2


def test_window_is_the_tail_of_the_session(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    policy = TrainingPolicy(warmup_size=10, window_size=30, retrain_seconds=0)
    job = ScoringJob(spark, out, policy=policy, forest=TINY)
    for i in range(4):
        write_lines(source, f"{i}.txt", [message(j) for j in range(i * 20, i * 20 + 20)])
        os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))
    run(job, spark, source, tmp_path / "cp")
    held = sorted(os.listdir(os.path.join(job.path("features"), f"written_by={job.writer}")))
    assert [h for h in held if h.startswith("batch")] == ["batch_id=0", "batch_id=2", "batch_id=3"]
    window = {r["transaccionID"] for r in job.window_rows().collect()}
    warm = {r["transaccionID"] for r in job.warmup_rows().collect()}
    assert window == {f"t{i:04d}" for i in range(50, 80)}
    assert warm == {f"t{i:04d}" for i in range(10)}
    assert job.models.load().forest.n_samples == 30


def test_policy():
    with pytest.raises(ValueError):
        TrainingPolicy(warmup_size=6000)
    policy = TrainingPolicy(warmup_size=10, window_size=20, retrain_seconds=60)
    mine, other = (ActiveModel(1, s, 100.0, None) for s in ("a", "b"))
    assert policy.warmup_due(None, "a", 10) and not policy.warmup_due(None, "a", 9)
    assert policy.warmup_due(other, "a", 10) and not policy.warmup_due(mine, "a", 10)
    assert policy.retrain_due(mine, "a", 10, 160.0) and not policy.retrain_due(mine, "a", 10, 159.0)
    assert not policy.retrain_due(other, "a", 10, 160.0) and not policy.retrain_due(None, "a", 10, 160.0)


def user(i, **more):
    return json.dumps({"usuarioID": f"u{i}", "email": "a@b.example", "promedio_de_gastos": 1.0 * i, **more})


def test_dimension_keeps_the_last_row_with_its_nulls(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "0.txt", [user(1), user(2), user(1, promedio_de_gastos=5.0), "junk"])
    write_lines(source, "1.txt", [user(2, email=None), user(3)])
    for i in range(2):
        os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))
    table = user_table(spark, str(tmp_path / "users"))

    def go(cp, every):
        start_upserts(text_stream(spark, source), schemas.USER, table, str(tmp_path / cp), ONCE,
                      every).awaitTermination()
        return sorted((r["usuarioID"], r["promedio_de_gastos"], r["email"])
                      for r in table.snapshot().collect())

    expected = [("u1", 5.0, "a@b.example"), ("u2", 2.0, None), ("u3", 3.0, "a@b.example")]
    assert go("cp", 0) == expected
    assert table.compact() == 1 and table.compact() is None
    assert not [f for _, _, files in os.walk(tmp_path / "users/deltas") for f in files if f.endswith(".parquet")]
    assert go("lost", 1) == expected
    write_lines(source, "2.txt", [user(1, promedio_de_gastos=None)])
    assert go("cp", 0) == [("u1", None, "a@b.example"), *expected[1:]]
    assert table.compact() is not None
    assert len([v for v in os.listdir(tmp_path / "users/versions") if v.isdigit()]) == 2
    assert table.snapshot().count() == 3
    table.upsert(table.snapshot().withColumn("arrival", F.lit(1)), "zz", 0)
    table.upsert(table.snapshot().withColumn("arrival", F.lit(1)), "zz", 0)
    older = table.snapshot()
    assert table.compact(grace=True) is not None
    assert older.count() == 3 == table.snapshot().count()


def test_card_table_key(spark, tmp_path):
    table = card_table(spark, str(tmp_path / "cards"))
    assert isinstance(table, DimensionTable) and table.key == "tarjetaID"
    assert table.snapshot().isEmpty()


def test_first_write_wins_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(
        [("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 3, "2024-01-02")], "k string, n int, d string")
    append_first_wins(rows, path, "k", [F.col("n")], F.col("d"))
    append_first_wins(rows.withColumn("n", F.col("n") - 10), path, "k", [F.col("n")], F.col("d"))
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "n").collect()) == [("a", 1), ("b", 3)]
    assert drop_expired(spark, path, "2024-01-02") == ["2024-01-01"]
    assert [r["k"] for r in spark.read.parquet(path).collect()] == ["b"]
    undated = str(tmp_path / "u")
    append_first_wins(rows.withColumn("d", F.lit(None).cast("string")), undated, "k", [F.col("n")], F.col("d"))
    assert drop_expired(spark, undated, "2024-01-02") == []
    assert drop_expired(spark, undated, "2999-01-01") == ["__HIVE_DEFAULT_PARTITION__"]
    full_refresh(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_retention_job(spark, source, tmp_path):
    job = replayable(spark, str(tmp_path / "out"))
    batch = ev.parse_events(spark.read.text(str(source)), schemas.TRANSACTION)
    job.process(batch, 0)
    assert jobs.retention(spark, job.folder, "2024-01-06")["transactions_raw"] == []
    gone = jobs.retention(spark, job.folder, "2024-12-31")
    assert gone["transactions_raw"] == gone["transactions_enriched"] == ["2024-01-05"] and gone["features"] == 0
    assert jobs.retention(spark, job.folder, "2999-01-01")["features"] == 1
    left = [f for d, _, files in os.walk(job.folder) for f in files
            if f.endswith((".parquet", ".json")) and "/model" not in d]
    assert not left


def test_secret_key_must_be_configured(spark):
    with pytest.raises(ValueError):
        secret_key(spark)
    spark.conf.set("cardwarden.secret.key", "k" * 16)
    try:
        assert secret_key(spark) == "k" * 16
    finally:
        spark.conf.unset("cardwarden.secret.key")


def test_group_of_streams(spark, tmp_path):
    group = StreamGroup(spark, {})
    with pytest.raises(RuntimeError):
        group.await_termination()
    source = tmp_path / "in"
    write_lines(source, "0.txt", [user(1)])
    table = user_table(spark, str(tmp_path / "users"))
    group = StreamGroup(spark, {"users": lambda: start_upserts(
        text_stream(spark, source), schemas.USER, table, str(tmp_path / "cp"),
        {"processingTime": "1 second"})}).start()
    group.queries["users"].processAllAvailable()
    assert group.await_termination(0) in (False, None)
    group.stop()
    assert not group.queries["users"].isActive and table.snapshot().count() == 1


def test_parsing_keeps_source_positions(spark):
    raw = spark.createDataFrame([(bytearray(message(1).encode()), 2, 7)], "value binary, partition int, offset long")
    row = ev.with_arrival(ev.parse_events(raw, schemas.TRANSACTION)).first()
    assert row["transaccionID"] == "t0001" and row["arrival"] == 7 * 65536 + 2
    options = ev.kafka_options("h:1", "t")
    assert options["maxOffsetsPerTrigger"] == "200" and options["startingOffsets"] == "latest"


def test_files_and_reports(spark, tmp_path, sf_dir):
    region = V.table(spark, sf_dir, "region")
    reports.write_csv(region, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), ["r_name", "absent"])
    assert back.columns == ["r_name"] and back.count() == 5
    typed = files.read_csv(spark, str(tmp_path / "csv"), schema=region.schema)
    assert typed.exceptAll(region).isEmpty()
    reports.write_report({"r": region}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/r")).count() == 5
    reports.write_parquet(region, str(tmp_path / "pq"))
    assert files.read_parquet(spark, str(tmp_path / "pq"), ["r_name"]).columns == ["r_name"]
    reports.append_metrics(region, str(tmp_path / "m"))
    reports.append_metrics(region, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 10
    discard(region)
    assert no_profiles(spark).isEmpty()
    assert as_feed(region).columns == ["value"]
