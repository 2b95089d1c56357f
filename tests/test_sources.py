"""Files in and out: feature files, training files, archives, quarantine, alert enrichment."""

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import alerts as I
from flowquarry.operators import flows as L
from flowquarry.plans.views import packets
from flowquarry.runtime import staging_path
from flowquarry.schemas import FEATURES
from flowquarry.sources import records, sinks


def test_feature_file_round_trip(spark, folder):
    table = L.flow_features(packets(spark, folder))
    path = staging_path(spark, "features")
    sinks.write_features(table, path)
    back = records.read_log_csv(spark, path)
    assert back.columns == ["id", *FEATURES]
    assert back.select("id").distinct().count() == table.count()
    assert back.agg(F.sum("spkts")).first() == table.agg(F.sum("spkts")).first()


def test_missing_columns_are_named(spark):
    path = staging_path(spark, "incomplete")
    spark.createDataFrame([(1, 2.0)], "id long, dur double").write.csv(path, header=True)
    with pytest.raises(ValueError, match="proto"):
        records.read_log_csv(spark, path)
    with pytest.raises(ValueError, match="label"):
        records.read_training_csv(spark, path)


def test_archive_is_pruned_by_folder(spark, folder):
    path = staging_path(spark, "archive")
    rows = packets(spark, folder)
    sinks.write_archive(rows, path)
    newest = sinks.read_archive(spark, path, 48)
    last = rows.agg(F.max("ts")).first()[0]
    assert newest.count() == rows.filter(F.col("ts") >= F.lit(last) - F.expr("interval 48 hours")).count() > 0
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_known_places_replace_unknown_ones(spark):
    rows = spark.createDataFrame([("1.1.1.1",), ("10.0.0.1",), (None,)], "source_ip string").withColumn(
        "source_info", I.address_info(F.col("source_ip")))
    places = spark.createDataFrame([("1.1.1.1", "AU", "dns")], "ip string, country string, organization string")
    found = {r["source_ip"]: r["source_info"] for r in I.with_places(rows, places).collect()}
    assert found["1.1.1.1"]["country"] == "AU" and not found["1.1.1.1"]["is_private"]
    assert found["10.0.0.1"]["country"] == "Unknown" and found["10.0.0.1"]["is_private"]
    assert found[None] is None


def test_work_folder_is_required_on_a_cluster(spark, monkeypatch):
    from flowquarry import runtime

    class Cluster:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.work_dir(Session())
