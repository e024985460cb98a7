"""The sample streams that queries and their SQL share, derived from ``events``: a user is a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The frames of the queries.
WINDOW_MS, HOP_MS = 20, 10


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("arrival_seq", F.row_number().over(w).cast("bigint")).select(
        F.col("user_id").alias("session"), "arrival_seq", ((F.col("arrival_seq") - 1) * 4).alias("t_ms"), F.floor(F.col("value") * 10).cast("bigint").alias("raw"),
        F.get_json_object("props", "$.k").cast("bigint").alias("env"), "event_type", "value",
    )


def rewound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of odd users jumps back after their fortieth sample."""
    back = F.when((F.col("session") % 2 == 1) & (F.col("arrival_seq") > 40), 100_000).otherwise(0)
    return samples(spark, sf_dir).withColumn("t_ms", F.col("t_ms") - back)


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh sample comes with a time before that of the one before it."""
    return samples(spark, sf_dir).withColumn("t_ms", F.col("t_ms") - F.when(F.col("arrival_seq") % 7 == 3, 12).otherwise(0))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks press and views release."""
    action = F.when(F.col("event_type") == "click", "press").otherwise("release")
    return samples(spark, sf_dir).where("event_type IN ('click', 'view')").select("session", F.col("arrival_seq").alias("seq"), F.col("arrival_seq").alias("after_seq"), action.alias("action"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device lines; every thirteenth is broken."""
    text = F.concat_ws(" ", "t_ms", "raw", "env")
    return samples(spark, sf_dir).select("session", "arrival_seq", F.when(F.col("arrival_seq") % 13 == 0, F.concat(text, F.lit(" x"))).otherwise(text).alias("line"))


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "label_start").when(F.col("event_type") == "view", "label_end").otherwise("phase")
    return samples(spark, sf_dir).select("session", F.col("arrival_seq").alias("line"), kind.alias("type"), "t_ms")


def phase_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "purchase", "CLICK").when(F.col("event_type") == "error", "ARTIFACT_NO_LABEL").when(F.col("event_type") == "signup", "REST")
    label = F.when(F.col("event_type") == "purchase", "CLICK")
    return samples(spark, sf_dir).select("session", F.col("arrival_seq").alias("line"), name.alias("name"), label.alias("label"), "t_ms", F.lit(0.004).alias("duration_s")).where("name IS NOT NULL")


SQL = """
s AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival_seq,
        (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 4 AS t_ms, CAST(floor(value * 10) AS BIGINT) AS raw,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS env, event_type, value FROM events),
r AS (SELECT session, arrival_seq, t_ms - CASE WHEN session % 2 = 1 AND arrival_seq > 40 THEN 100000 ELSE 0 END AS t_ms, raw, env, value FROM s),
late AS (SELECT session, arrival_seq, t_ms - CASE WHEN arrival_seq % 7 = 3 THEN 12 ELSE 0 END AS t_ms, raw, env, value FROM s)"""

RECORDS = """
lr AS (SELECT session, arrival_seq AS line, t_ms, CASE event_type WHEN 'click' THEN 'label_start' WHEN 'view' THEN 'label_end' ELSE 'phase' END AS type FROM s),
li AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY line) AS ord, start_ms, t_ms AS end_ms FROM (
        SELECT *, lag(type) OVER w AS b, lag(t_ms) OVER w AS start_ms FROM lr WHERE type <> 'phase' WINDOW w AS (PARTITION BY session ORDER BY line))
       WHERE type = 'label_end' AND b = 'label_start' AND t_ms > start_ms),
pm AS (SELECT session, arrival_seq AS line, t_ms, CASE event_type WHEN 'purchase' THEN 'CLICK' WHEN 'error' THEN 'ARTIFACT_NO_LABEL' ELSE 'REST' END AS name,
        CASE event_type WHEN 'purchase' THEN 'CLICK' END AS label FROM s WHERE event_type IN ('purchase', 'error', 'signup')),
pw AS (SELECT * FROM (SELECT session, row_number() OVER w AS ord, name, label, t_ms AS start_ms, coalesce(lead(t_ms) OVER w, t_ms + 4) AS end_ms
        FROM pm WINDOW w AS (PARTITION BY session ORDER BY line)) WHERE end_ms > start_ms)"""


def frames_sql(source: str = "r", value: str = "raw", lf: str = "(env * 0.5)", slope: str = "value", window: int = WINDOW_MS, hop: int = HOP_MS) -> str:
    """CTEs up to ``fr``: a row for each frame of two samples or more of ``source``. A frame holds what came before the
    first sample at or past its end, and that one where it is at its end."""
    return f"""
seg AS (SELECT *, sum(reset) OVER (PARTITION BY session ORDER BY arrival_seq) AS segment FROM (
         SELECT *, CASE WHEN t_ms + {hop} < lag(t_ms) OVER (PARTITION BY session ORDER BY arrival_seq) THEN 1 ELSE 0 END AS reset FROM {source})),
b AS (SELECT session, segment, arg_min(t_ms, arrival_seq) AS t0, max(t_ms) AS last FROM seg GROUP BY ALL),
f AS (SELECT session, segment, k AS frame, t0 + {window} + k * {hop} AS end_ms FROM (
       SELECT *, unnest(range(0, greatest((last - t0 - {window}) // {hop} + 1, 0))) AS k FROM b)),
fc AS (SELECT f.*, min(arrival_seq) AS shut FROM f JOIN seg ON seg.session = f.session AND seg.segment = f.segment AND t_ms >= end_ms GROUP BY ALL),
fm AS (SELECT seg.*, frame, end_ms, abs({value} - lag({value}) OVER (PARTITION BY seg.session, seg.segment, frame ORDER BY arrival_seq)) AS step
      FROM seg JOIN fc f ON seg.session = f.session AND seg.segment = f.segment AND arrival_seq <= shut AND t_ms BETWEEN end_ms - {window} AND end_ms),
fr AS (SELECT session, segment, frame, end_ms, count(*) AS n, sqrt(avg({value}::DOUBLE * {value})) AS rms_state, sqrt(avg({lf}::DOUBLE * {lf})) / greatest(sqrt(avg({value}::DOUBLE * {value})), 1e-6) AS lf_energy_ratio, coalesce(sum(step), 0)::DOUBLE AS waveform_length,
        median({slope}::DOUBLE) AS slope_burst, arg_max(env, arrival_seq) AS env_in, arg_max({value}, arrival_seq) AS filtered_raw_hp
       FROM fm GROUP BY ALL HAVING count(*) >= 2)"""
