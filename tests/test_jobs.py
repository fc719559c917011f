"""The offline jobs end to end on small files."""

from pyspark.sql import functions as F

from cardwarden import jobs
from cardwarden.operators import model_selection as MS
from cardwarden.sources import views as V
from cardwarden.streaming.lifecycle import ModelStore


def test_offline_jobs(spark, sf_dir, tmp_path, monkeypatch):
    tx = V.transactions(spark, sf_dir).withColumnRenamed("transaccionID", "TransactionID").drop(
        "usuarioID", "tarjetaID", "terminalID", "fecha_hora_transaccion").withColumn(
        "addr2", F.when(F.col("C14") == 0, F.col("addr2")))
    tx.write.option("header", True).csv(str(tmp_path / "tx"))
    V.identities(spark, sf_dir).withColumnRenamed("transaccionID", "TransactionID").write.option(
        "header", True).csv(str(tmp_path / "id"))
    cleaned = str(tmp_path / "clean")
    rows = jobs.clean_files(spark, str(tmp_path / "tx"), str(tmp_path / "id"), cleaned, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows.count()
    assert rows.count() == tx.count() and "addr2" not in rows.columns and "id_02" in rows.columns
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]).first()
    assert not any(nulls)

    jobs.statistics(spark, cleaned, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats/correlation")).filter("col_a = col_b").filter(
        "abs(corr - 1) > 1e-9").isEmpty()

    monkeypatch.setitem(MS.MODELS, "top_25", (MS.MODELS["top_25"][0], 20, 64, 1.0))
    result = jobs.train(spark, cleaned, str(tmp_path / "model"), "top_25").first()
    assert result["tn"] + result["fp"] + result["fn"] + result["tp"] == 200
    assert 0 <= result["auc_roc"] <= 1
    stored = ModelStore(spark, str(tmp_path / "model")).load()
    assert stored.forest.features[-2:] == ["amt_ratio", "log_amt"] and stored.forest.params.trees == 20


def test_evaluation_job(spark, sf_dir, tmp_path):
    V.scored(V.transactions(spark, sf_dir)).write.parquet(str(tmp_path / "enriched"))
    metrics = str(tmp_path / "metrics")
    frames = jobs.evaluate(spark, str(tmp_path / "enriched"), metrics)
    jobs.evaluate(spark, str(tmp_path / "enriched"), metrics, include_warmup=True)
    assert frames["summary"].first()["n_samples"] == 500
    assert sorted(r[0] for r in spark.read.parquet(metrics).select("samples_evaluated").collect()) == [500, 1000]
    assert frames["report"].count() == 5


def test_smaller_settings_of_a_grid_are_prefixes(spark, sf_dir):
    grid = MS.grid_search(V.transactions(spark, sf_dir), "transaccionID", trees=(5, 15),
                          samples=("auto", 64), contaminations=(0.05, 0.2)).collect()
    assert len(grid) == 8 and all(0 <= r["f1"] <= 1 for r in grid)
    assert [r["f1"] for r in grid] == sorted((r["f1"] for r in grid), reverse=True)
