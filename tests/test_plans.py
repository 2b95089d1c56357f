"""Plans that must hold at scale: what is read, and what is exchanged."""

from pyspark.sql import functions as F

from flowquarry.operators import prepare as E
from flowquarry.plans.views import TRAIN_KEY, packets, training
from flowquarry.runtime import staging_path
from flowquarry.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_small_dictionaries_do_not_exchange_the_rows(spark, folder, monkeypatch):
    rows = training(spark, folder)
    codes = E.encoder_fit(rows, ["status", "service"])
    small = E.encoder_transform(rows, codes, ["status", "service"], TRAIN_KEY)
    assert "BroadcastHashJoin" in plan_of(small) and "SortMergeJoin" not in plan_of(small)
    monkeypatch.setattr(E, "MOST_CODES", 0)
    large = E.encoder_transform(rows, codes, ["status", "service"], TRAIN_KEY)
    assert small.exceptAll(large.select(small.columns)).isEmpty() and small.count() == large.count()


def test_archive_opens_only_the_newest_folders(spark, folder):
    path = staging_path(spark, "archive-plan")
    rows = packets(spark, folder)
    sinks.write_archive(rows, path)
    found = sinks.read_archive(spark, path, 2)
    assert sinks.newest_hour(spark.read.parquet(path))[0] == str(rows.agg(F.to_date(F.max("ts"))).first()[0])
    scans = found._jdf.queryExecution().sparkPlan().toString()
    partition_filters = scans.split("PartitionFilters:")[1].split("]")[0]
    assert "date" in partition_filters and "hour" in partition_filters
    newest = rows.agg(F.max("ts")).first()[0]
    assert found.count() == rows.filter(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 2 HOURS")).count()
