"""Detection end to end: fitted models beat the majority class, and batch, CSV and reloaded detectors agree."""

from pyspark.sql import functions as F

from flowquarry.operators import detection as D
from flowquarry.plans.detection import detector, labelled_flows, shown
from flowquarry.runtime import staging_path
from flowquarry.schemas import FEATURES


def test_batch_csv_and_reloaded_detectors_agree(spark):
    folder = "/root/testdata/sf0.01"  # 150 flows are held out
    model, rows = detector(spark, folder)
    batch = {r.id: r for r in shown(D.detect(rows, model)).collect()}
    truth = {r.id: r.label for r in labelled_flows(spark, folder).select("id", "label").collect()}
    held = [i for i in truth if i % 5 == 0]
    floor = max(sum(truth[i] for i in held), len(held) - sum(truth[i] for i in held)) / len(held)
    for name in ("pred_knn", "pred_mlp", "pred_xgb", "prediction"):
        assert sum(batch[i][name] == truth[i] for i in held) / len(held) > floor, name
    assert set(batch) == set(truth)

    path, logs = staging_path(spark, "saved"), staging_path(spark, "logs")
    D.save(model, path)
    again = D.load(spark, path)
    assert {r.id: r for r in shown(D.detect(rows, again)).collect()} == batch
    # One broken record among the logs: it is an error, and the others do not change.
    broken = rows.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("state", F.lit(None).cast("string"))
    rows.unionByName(broken).select("id", *FEATURES).write.csv(logs, header=True)
    scored = D.detect_csv(spark, logs, again)
    found = {r.id: r for r in shown(scored).collect()}
    assert found.pop(-1).prediction == -1 and found == batch
    raised = D.alerts(scored, F.lit("2024-01-01T00:00:00")).collect()
    assert {r.log_id for r in raised} == {i for i, r in batch.items() if r.is_attack and r.confidence >= 0.7}
    partial = D.load(spark, path, ("mlp", "never_saved"))
    assert set(partial.models) == {"mlp"}


def test_flows_are_made_once(spark, folder, monkeypatch):
    """Categories, scaler, tree and result read stored flows; before, each of them went back to the packets."""
    from flowquarry.plans import detection as P
    from flowquarry.plans.registry import CATALOGUE

    sent = []
    fit = P._unfitted
    monkeypatch.setattr(P, "_unfitted", lambda rows: sent.append(rows) or fit(rows))
    for name in ("prepared_flows", "detection_neighbours"):
        assert CATALOGUE[name].build(spark, folder).count() > 0
    for rows in sent:
        assert "parquet" not in rows._jdf.queryExecution().executedPlan().toString().lower()
