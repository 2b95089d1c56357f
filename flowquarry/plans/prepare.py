"""Queries of record parsing and data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.operators import flows as L
from flowquarry.operators import prepare as E
from flowquarry.plans.flows import FLOWS_SQL, flows
from flowquarry.plans.registry import query
from flowquarry.plans.views import TRAIN_KEY, TRAIN_NUMERIC, TRAIN_SQL, events, training
from flowquarry.runtime import staging_path, table
from flowquarry.schemas import FEATURES
from flowquarry.sources import records as R

_TKEY = ", ".join(TRAIN_KEY)
_ORDER = ["mix", *TRAIN_KEY]
_ORDER_SQL = ", ".join(_ORDER)
_SHOWN = ["dur", "proto", "service", "state", "spkts", "dpkts", "ct_src_ltm", "is_sm_ips_ports"]

# Lines of 6 fields are padded, lines of 56 are cut.
_LINE_SQL = """ln AS (SELECT event_id, '  ' || CAST(event_id AS VARCHAR) || ',tcp,' || event_type || ',FIN,'
    || CAST(user_id AS VARCHAR) || ',abc' || repeat(',' || CAST(event_id % 9 AS VARCHAR), (event_id % 2) * 50) || ' ' AS line
  FROM events)"""
_FIELDS_SQL = ", ".join(f"f[{FEATURES.index(c) + 1}] AS {c}" for c in _SHOWN)


def _lines(spark, folder):
    n = F.col("event_id")
    tail = F.when(n % 2 == 1, F.repeat(F.concat(F.lit(","), (n % 9).cast("string")), 50)).otherwise("")
    line = F.concat(
        F.lit("  "), n.cast("string"), F.lit(",tcp,"), "event_type", F.lit(",FIN,"), F.col("user_id").cast("string"),
        F.lit(",abc"), tail, F.lit(" "),
    )
    return events(spark, folder).select("event_id", line.alias("line"))


@query("headerless_lines", "A08", f"""WITH {_LINE_SQL}, p AS (SELECT event_id,
    list_concat(string_split(trim(line), ','), list_transform(range(42), lambda x: '0'))[1:42] AS f FROM ln)
SELECT event_id, {_FIELDS_SQL} FROM p""")
def _(spark, folder):
    return R.parse_lines(_lines(spark, folder), "line", ["event_id"]).select("event_id", *_SHOWN)


@query("lines_with_id", "A08", f"""WITH {_LINE_SQL}, p AS (SELECT event_id,
    list_concat(string_split(trim(line), ','), list_transform(range(43), lambda x: '0'))[1:43] AS f FROM ln)
SELECT event_id, f[1] AS id, f[2] AS dur, f[3] AS proto, f[43] AS is_sm_ips_ports FROM p""")
def _(spark, folder):
    parsed = R.parse_lines(_lines(spark, folder), "line", ["event_id"], has_id=True)
    return parsed.select("event_id", "id", "dur", "proto", "is_sm_ips_ports")


@query("json_records", "A09", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k,
  '0' AS dur, '' AS service, '0' AS spkts FROM events""")
def _(spark, folder):
    parsed = R.parse_json(events(spark, folder), "props", ["event_id"], ["k", *FEATURES])
    return parsed.select("event_id", "k", "dur", "service", "spkts")


@query("typed_log_rejects", "A10", f"""WITH {_LINE_SQL}, p AS (SELECT event_id,
    list_concat(string_split(trim(line), ','), list_transform(range(43), lambda x: '0'))[1:43] AS f FROM ln)
SELECT event_id, TRY_CAST(f[1] AS BIGINT) AS id, TRY_CAST(f[2] AS DOUBLE) AS dur,
  TRY_CAST(f[7] AS BIGINT) AS dpkts, TRY_CAST(f[2] AS DOUBLE) IS NULL AS rejected FROM p""")
def _(spark, folder):
    parsed = R.parse_lines(_lines(spark, folder), "line", [], has_id=True)
    logs = R.typed_logs(parsed)
    return logs.select(
        F.col("id").alias("event_id"), "id", "dur", "dpkts", F.array_contains("reject", "dur").alias("rejected")
    )


@query("batch_container", "A11", """SELECT user_id, event_id AS id, value AS dur, event_type AS service FROM events""")
def _(spark, folder):
    # Containers of at most 100 consecutive logs, unpacked again.
    logs = events(spark, folder).withColumn("batch", F.floor(F.col("event_id") / 100))
    packed = logs.groupBy("batch").agg(F.collect_list(F.struct(
        "user_id", F.col("event_id").alias("id"), F.col("value").alias("dur"), F.col("event_type").alias("service")
    )).alias("logs"))
    return R.explode_batch(packed)


_TRAIN_SCHEMA = T.StructType([
    *[T.StructField(c, T.LongType()) for c in TRAIN_KEY], *[T.StructField(c, T.DoubleType()) for c in TRAIN_NUMERIC],
    T.StructField("status", T.StringType()), T.StructField("service", T.StringType()),
    T.StructField("label", T.IntegerType()), T.StructField("attack_cat", T.StringType()), T.StructField("mix", T.LongType()),
])


@query("training_csv", "A06", f"""WITH {TRAIN_SQL}
SELECT {_TKEY.replace('l_linenumber', 'CAST(l_linenumber AS BIGINT) AS l_linenumber')}, quantity, price, status, label FROM tr""")
def _(spark, folder):
    path = staging_path(spark, "training-csv")
    training(spark, folder).write.csv(path, header=True)
    return R.read_training_csv(spark, path, _TRAIN_SCHEMA).select(*TRAIN_KEY, "quantity", "price", "status", "label")


_CSV_SHOWN = ["proto", "service", "state", "spkts", "dpkts", "sbytes", "swin", "stcpb", "ct_srv_dst"]


@query("log_csv", "A07 A12 H15", f"""WITH {FLOWS_SQL}
SELECT spkts * 1000003 + stcpb AS id, {", ".join(_CSV_SHOWN)}, round(rate, 6) AS rate FROM fl""")
def _(spark, folder):
    path = staging_path(spark, "flow-csv")
    identity = (F.col("spkts") * 1000003 + F.col("stcpb")).alias("id")
    flows(spark, folder).select(identity, *FEATURES).write.csv(path, header=True)
    return R.read_log_csv(spark, path).select("id", *_CSV_SHOWN, F.round("rate", 6).alias("rate"))


@query("column_drop", "E01", f"WITH {TRAIN_SQL} SELECT {_TKEY}, quantity, price, discount, tax, status, service, label FROM tr")
def _(spark, folder):
    return E.drop_columns(training(spark, folder), ["id", "attack_cat", "mix"])


def _with_gaps(spark, folder):
    """The labels of all documents: two columns that are NULL where nobody labelled."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    docs = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.withColumn("size", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")))


_GAPS_SQL = """ga AS (SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, l.quality, l.toxic,
  CASE WHEN d.doc_id % 4 <> 0 THEN d.n_chars::DOUBLE END AS size
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("null_profile", "E02", f"WITH {_GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls,
  round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 6) AS percent FROM ga HAVING count(*) FILTER ({c} IS NULL) > 0"""
    for c in ("doc_id", "n_chars", "quality", "toxic", "size")))
def _(spark, folder):
    return E.null_profile(_with_gaps(spark, folder)).withColumn("percent", F.round("percent", 6))


@query("null_drop", "E03", f"""WITH {_GAPS_SQL}, n AS (SELECT *, quality IS NULL OR toxic IS NULL OR size IS NULL AS bad FROM ga)
SELECT count(*) AS rows_before, count(*) FILTER (bad) AS removed, round(count(*) FILTER (bad) / count(*) * 100, 6) AS percent
FROM n""")
def _(spark, folder):
    return E.null_drop_report(_with_gaps(spark, folder)).withColumn("percent", F.round("percent", 6))


@query("median_fill", "E04", f"""WITH {_GAPS_SQL}
SELECT doc_id, n_chars, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM ga)) AS size FROM ga""")
def _(spark, folder):
    return E.median_fill(_with_gaps(spark, folder), ["size"]).select("doc_id", "n_chars", "size")


@query("class_distribution", "E05", f"""WITH {TRAIN_SQL}
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM tr) * 100, 6) AS percent FROM tr GROUP BY label""")
def _(spark, folder):
    return E.class_distribution(training(spark, folder)).withColumn("percent", F.round("percent", 6))


_CODES_SQL = TRAIN_SQL + """,
co AS (SELECT field, value, CAST(row_number() OVER (PARTITION BY field ORDER BY value) - 1 AS INTEGER) AS code FROM (
  SELECT DISTINCT 'status' AS field, status AS value FROM tr UNION SELECT DISTINCT 'service', service FROM tr))"""


@query("encoder_codes", "E06", f"WITH {_CODES_SQL} SELECT * FROM co")
def _(spark, folder):
    return E.encoder_fit(training(spark, folder), ["status", "service"])


@query("encoder_transform", "E07", f"""WITH {_CODES_SQL}, un AS (
  SELECT * REPLACE (CASE WHEN mix % 3 = 0 THEN 'never-seen' ELSE service END AS service) FROM tr)
SELECT {_TKEY}, coalesce(a.code, 0) AS service, coalesce(b.code, 0) AS status FROM un
LEFT JOIN co a ON a.field = 'service' AND a.value = un.service LEFT JOIN co b ON b.field = 'status' AND b.value = un.status""")
def _(spark, folder):
    rows = training(spark, folder)
    codes = E.encoder_fit(rows, ["status", "service"])
    unseen = rows.withColumn("service", F.when(F.col("mix") % 3 == 0, "never-seen").otherwise(F.col("service")))
    return E.encoder_transform(unseen, codes, ["service", "status"], TRAIN_KEY).select(*TRAIN_KEY, "service", "status")


@query("numeric_coercion", "E08", f"""WITH {_LINE_SQL}, p AS (SELECT event_id,
    list_concat(string_split(trim(line), ','), list_transform(range(42), lambda x: '0'))[1:42] AS f FROM ln)
SELECT event_id, coalesce(TRY_CAST(f[1] AS DOUBLE), 0.0) AS dur, coalesce(TRY_CAST(f[2] AS DOUBLE), 0.0) AS proto,
  coalesce(TRY_CAST(f[5] AS DOUBLE), 0.0) AS spkts, coalesce(TRY_CAST(f[6] AS DOUBLE), 0.0) AS dpkts FROM p""")
def _(spark, folder):
    parsed = R.parse_lines(_lines(spark, folder), "line", ["event_id"])
    return E.coerce_numbers(parsed, ["dur", "proto", "spkts", "dpkts"]).select("event_id", "dur", "proto", "spkts", "dpkts")


@query("ordered_features", "E09", f"WITH {FLOWS_SQL} SELECT proto, service, state, spkts, dpkts FROM fl")
def _(spark, folder):
    some = flows(spark, folder).select("dpkts", "state", "proto", "spkts", "service")
    return E.ordered_features(some, strict=False)


@query("standard_scaler", "E10", f"""WITH {TRAIN_SQL}
SELECT {_TKEY}, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in TRAIN_NUMERIC)}
FROM tr""")
def _(spark, folder):
    rows = training(spark, folder)
    scaled = E.Scaler.fit(rows, TRAIN_NUMERIC).transform(rows)
    return scaled.select(*TRAIN_KEY, *[F.round(c, 6).alias(c) for c in TRAIN_NUMERIC])


_RANKED_SQL = TRAIN_SQL + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER_SQL}) AS rn,
  count(*) OVER (PARTITION BY label) AS n_class FROM tr),
sp AS (SELECT *, CASE WHEN rn * 100 <= n_class * 20 THEN 'test' WHEN rn * 100 <= n_class * 35 THEN 'val' ELSE 'train' END
  AS split FROM rk)"""


@query("stratified_split", "E11", f"WITH {_RANKED_SQL} SELECT {_TKEY}, label, split FROM sp")
def _(spark, folder):
    return E.split_three(training(spark, folder), _ORDER).select(*TRAIN_KEY, "label", "split")


@query("unstratified_split", "E12", f"""WITH {TRAIN_SQL}, rk AS (
  SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rn, count(*) OVER () AS n FROM tr)
SELECT {_TKEY}, CASE WHEN rn * 100 <= n * 20 THEN 'test' WHEN rn * 100 <= n * 35 THEN 'val' ELSE 'train' END AS split FROM rk""")
def _(spark, folder):
    return E.split_three(training(spark, folder), _ORDER, label=None).select(*TRAIN_KEY, "split")


@query("split_report", "E13", f"""WITH {_RANKED_SQL}
SELECT split, count(*) AS n, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS attack FROM sp GROUP BY split""")
def _(spark, folder):
    return E.split_report(E.split_three(training(spark, folder), _ORDER))


@query("input_validation", "E14", f"""WITH {_LINE_SQL}, p AS (SELECT event_id,
    list_concat(string_split(trim(line), ','), list_transform(range(42), lambda x: '0'))[1:42] AS f FROM ln)
SELECT event_id, TRY_CAST(f[6] AS DOUBLE) IS NOT NULL AS valid,
  CASE WHEN TRY_CAST(f[6] AS DOUBLE) IS NULL THEN 'number:dpkts' ELSE '' END AS errors FROM p""")
def _(spark, folder):
    checked = E.validate(R.parse_lines(_lines(spark, folder), "line", ["event_id"]))
    return checked.select("event_id", "valid", F.concat_ws("|", "errors").alias("errors"))


@query("preprocess_lines", "E15 L2")
def _(spark, folder):
    known = flows(spark, folder)
    codes = E.encoder_fit(known, ["proto", "service", "state"])
    encoded = E.coerce_numbers(E.encoder_transform(known, codes, ["proto", "service", "state"], L.KEY), FEATURES)
    scaler = E.Scaler.fit(encoded, FEATURES)
    return E.preprocess(R.parse_lines(_lines(spark, folder), "line", ["event_id"]), codes, scaler, ["event_id"])


@query("category_profile", "E16", f"""WITH {TRAIN_SQL}
SELECT 'label' AS field, CAST(label AS VARCHAR) AS value, count(*) AS n FROM tr GROUP BY ALL
UNION ALL SELECT 'attack_cat', attack_cat, count(*) FROM tr GROUP BY ALL
UNION ALL SELECT 'attacks_only', attack_cat, count(*) FROM tr WHERE label = 1 GROUP BY ALL""")
def _(spark, folder):
    rows = training(spark, folder)
    attacks = F.when(F.col("label") == 1, F.col("attack_cat"))
    counts = E.value_counts(rows.withColumn("attacks_only", attacks), ["label", "attack_cat", "attacks_only"])
    return counts.filter(F.col("value").isNotNull()).orderBy("field", F.desc("n"), "value")


_CORR = [*TRAIN_NUMERIC, "label"]


@query("correlation_matrix", "E17", f"WITH {TRAIN_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS left_field, '{b}' AS right_field, round(corr({a}, {b}), 6) AS corr FROM tr"
    for i, a in enumerate(_CORR) for b in _CORR[i:]))
def _(spark, folder):
    return E.correlations(training(spark, folder), _CORR).withColumn("corr", F.round("corr", 6))


@query("row_slice", "E18", f"WITH {TRAIN_SQL} SELECT {_TKEY}, label, price FROM tr ORDER BY {_TKEY} LIMIT 10 OFFSET 240")
def _(spark, folder):
    return E.row_slice(training(spark, folder), TRAIN_KEY, 240, 10).select(*TRAIN_KEY, "label", "price")


@query("stratified_sample", "F12", f"""WITH {_RANKED_SQL}
SELECT {_TKEY}, label FROM sp WHERE rn <= floor(n_class * 0.4::DOUBLE)""")
def _(spark, folder):
    return E.stratified_sample(training(spark, folder), _ORDER, 0.4).select(*TRAIN_KEY, "label")


@query("progressive_round_sizes", "F11", f"""WITH {TRAIN_SQL}, c AS (SELECT label, count(*) AS n FROM tr GROUP BY label)
SELECT CAST(r.i AS INTEGER) AS round, label, CAST(floor(n * (0.2::DOUBLE + 0.8::DOUBLE * (r.i / 24.0::DOUBLE))) AS BIGINT) AS size
FROM c, range(25) r(i)""")
def _(spark, folder):
    return E.round_sizes(training(spark, folder))


