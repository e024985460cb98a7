"""Registered queries over the driver's tables and the SQL that checks them.

Every query reads its whole table. Results of recurrences are rounded to six digits on both sides.
"""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sql as functions_sql
from ..operators import decide, dsp, evaluate, frames, islands, protocol, record, training
from ..sources import sessions
from ..sources.shared import shared_dir
from ..streaming import detector
from . import binding as B

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Parsing and cleansing


@query(f"WITH {B.SQL} SELECT session, arrival_seq, t_ms, raw, env FROM s WHERE arrival_seq % 13 <> 0")
def parse_lines(spark, sf):
    """O-PRJ-1/2, O-SET-1."""
    return frames.parsed_lines(B.lines(spark, sf))


@query(f"WITH {B.SQL} SELECT session, count(*) AS n_lines, count(*) FILTER (arrival_seq % 13 = 0) AS n_errors FROM s GROUP BY session")
def parse_errors(spark, sf):
    """O-PRJ-3, O-AGG-12."""
    return frames.line_counts(B.lines(spark, sf))


@query(f"WITH {B.SQL} SELECT session, arrival_seq, t_ms, CAST(trunc(value - 200) AS BIGINT) AS raw, env FROM s WHERE arrival_seq % 11 <> 0")
def clean_raw(spark, sf):
    """O-SRC-6: negative values are cut towards zero too."""
    text = F.when(F.col("arrival_seq") % 11 == 0, F.lit("n/a")).otherwise((F.col("value") - 200).cast("string"))
    rows = B.samples(spark, sf).select("session", "arrival_seq", F.col("t_ms").cast("string").alias("t_ms"), text.alias("raw"), F.col("env").cast("string").alias("env"))
    return frames.clean_samples(rows)


# Segments, windows, frames

_F = f"WITH {B.SQL}, {B.frames_sql()}"


@query(f"{_F} SELECT session, arrival_seq, t_ms, raw, env, CAST(segment AS BIGINT) AS segment FROM seg")
def segments(spark, sf):
    """O-FRM-1."""
    return frames.with_segments(B.rewound(spark, sf), B.HOP_MS).select("session", "arrival_seq", "t_ms", "raw", "env", "segment")


@query(f"{_F} SELECT session, arrival_seq, CAST(segment AS BIGINT) AS segment, greatest(coalesce(t_ms - lag(t_ms) OVER (PARTITION BY session, segment ORDER BY arrival_seq), 1), 1) AS dt_ms FROM seg")
def sample_dt(spark, sf):
    """O-DSP-2."""
    return frames.with_dt(frames.with_segments(B.rewound(spark, sf), B.HOP_MS)).select("session", "arrival_seq", "segment", "dt_ms")


@query(f"""{_F} SELECT session, arrival_seq, round(sqrt(avg(raw::DOUBLE * raw) OVER (PARTITION BY session, segment ORDER BY t_ms RANGE BETWEEN 180 PRECEDING AND CURRENT ROW)), 6) AS rms FROM seg""")
def rolling_rms(spark, sf):
    """O-DSP-10."""
    rows = frames.with_segments(B.rewound(spark, sf), B.HOP_MS).withColumn("raw", F.col("raw").cast("double"))
    return rounded(frames.rolling_rms(rows, "raw"), "rms").select("session", "arrival_seq", "rms")


def _frames(spark, sf) -> DataFrame:
    return _framed(B.rewound(spark, sf))


def _framed(samples: DataFrame) -> DataFrame:
    rows = samples.withColumns({"raw": F.col("raw").cast("double"), "lf": F.col("env") * 0.5})
    return frames.frames(rows, "raw", B.WINDOW_MS, B.HOP_MS, slope="value", lf="lf")


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, end_ms - {B.WINDOW_MS} AS start_ms, end_ms, n FROM fr")
def frames_basic(spark, sf):
    """O-FRM-2..5."""
    return _frames(spark, sf).select("session", "segment", "frame", "start_ms", "end_ms", "n")


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, round(rms_state, 6) AS rms_state, round(lf_energy_ratio, 6) AS lf_energy_ratio FROM fr")
def frames_rms(spark, sf):
    """O-FRM-6/7."""
    return rounded(_frames(spark, sf), "rms_state", "lf_energy_ratio").select("session", "segment", "frame", "rms_state", "lf_energy_ratio")


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, waveform_length FROM fr")
def frames_waveform_length(spark, sf):
    """O-FRM-8."""
    return _frames(spark, sf).select("session", "segment", "frame", "waveform_length")


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, slope_burst FROM fr")
def frames_slope_median(spark, sf):
    """O-FRM-9, O-AGG-4."""
    return _frames(spark, sf).select("session", "segment", "frame", "slope_burst")


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, env_in, CAST(filtered_raw_hp AS DOUBLE) AS filtered_raw_hp FROM fr")
def frames_last(spark, sf):
    """O-FRM-10."""
    return _frames(spark, sf).select("session", "segment", "frame", "env_in", "filtered_raw_hp")


@query(f"WITH {B.SQL}, {B.frames_sql('late')} SELECT session, CAST(segment AS BIGINT) AS segment, frame, n, waveform_length, filtered_raw_hp::DOUBLE AS filtered_raw_hp FROM fr")
def frames_late(spark, sf):
    """O-FRM-3, with rows that come late."""
    return _framed(B.late(spark, sf)).select("session", "segment", "frame", "n", "waveform_length", "filtered_raw_hp")


@query(f"WITH {B.SQL}, {B.frames_sql('s')} SELECT session, row_number() OVER (PARTITION BY session ORDER BY end_ms) AS arrival_seq, end_ms AS t_ms, waveform_length, round(rms_state, 6) AS rms_state, round(slope_burst, 6) AS slope_burst, round(lf_energy_ratio, 6) AS lf_energy_ratio FROM fr")
def recorded_features(spark, sf):
    """O-SRC-7, O-SNK-1, O-REC-6: frames of all sessions written as recorded feature rows and read by their header."""
    rows = record.feature_rows(_framed(B.samples(spark, sf)), F.lit(0.0))
    root = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    sessions.write_rows(rows.select("session", *sorted(c for c in rows.columns if c != "session")), root, "features.csv", ("t_ms",))
    read = sessions.read_features(spark, root, training.FEATURES).withColumn("session", F.col("session").cast("bigint"))
    return rounded(read, "rms_state", "slope_burst", "lf_energy_ratio")


@query(f"""{_F}, x AS (SELECT session, CAST(segment AS BIGINT) AS segment, frame, waveform_length, row_number() OVER w AS i, count(*) OVER w3 AS c,
  lag(waveform_length, 2) OVER w AS a, lag(waveform_length) OVER w AS b FROM fr WINDOW w AS (PARTITION BY session ORDER BY segment, frame), w3 AS (PARTITION BY session ORDER BY segment, frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT session, segment, frame, a AS step_0, b AS step_1, waveform_length AS step_2 FROM x WHERE c = 3""")
def sequence_window(spark, sf):
    """O-FRM-11/12, O-PRJ-4."""
    rows = frames.sequences(_frames(spark, sf), ["waveform_length"], 3).where("steps IS NOT NULL")
    return rows.select("session", "segment", "frame", *[F.get(F.get("steps", i), 0).alias(f"step_{i}") for i in range(3)])


@query(f"WITH {B.SQL} SELECT session, arrival_seq, t_ms FROM (SELECT *, max(t_ms) OVER (PARTITION BY session) AS latest FROM s) WHERE t_ms >= greatest(0, latest - 100)")
def plot_window(spark, sf):
    """O-FRM-13."""
    latest = F.max("t_ms").over(Window.partitionBy("session"))
    return B.samples(spark, sf).withColumn("latest", latest).where("t_ms >= greatest(0, latest - 100)").select("session", "arrival_seq", "t_ms")


# Filters

_DSP = f"""WITH RECURSIVE {B.SQL},
m AS (SELECT session, arrival_seq AS rn, t_ms, raw::DOUBLE AS raw, 250::DOUBLE AS fs, 0::DOUBLE AS hx, 0::DOUBLE AS hp, 0::DOUBLE AS x2, 0::DOUBLE AS y1, 0::DOUBLE AS y2, 0::DOUBLE AS lp,
        raw::DOUBLE AS base, raw::DOUBLE AS filtered, 0::DOUBLE AS centered, 0::DOUBLE AS lf, 0::DOUBLE AS fast, 0::DOUBLE AS slow FROM s WHERE arrival_seq = 1
  UNION ALL
  SELECT session, rn, t_ms, raw, fs, raw, hp2, hp, y, y1, lp2, base, lp2, lp2 - base,
         lf + (sec / (rcl + sec)) * (lp2 - base - lf), fast + (dt / (40 + dt)) * (abs(lp2 - base - centered) - fast), slow + (dt / (400 + dt)) * (abs(lp2 - base - centered) - slow)
  FROM (SELECT *, lp + sec / (1::DOUBLE / (2 * pi() * 230) + sec) * (y - lp) AS lp2, 1::DOUBLE / (2 * pi() * 10) AS rcl
  FROM (SELECT *, (hp2 + turn * hp + x2 - turn * y1 - (1 - alpha) * y2) / (1 + alpha) AS y
  FROM (SELECT *, sin(omega) / 40 AS alpha, -2 * cos(omega) AS turn
  FROM (SELECT *, 2 * pi() * least(greatest(60::DOUBLE / greatest(fs, 1::DOUBLE), 0::DOUBLE), 0.49::DOUBLE) AS omega
  FROM (SELECT session, rn, t_ms, raw, dt, sec, 0.95::DOUBLE * fs0 + 0.05::DOUBLE / sec AS fs, (rc / (rc + sec)) * (hp + raw - hx) AS hp2, hp, x2, y1, y2, lp, base, centered, lf, fast, slow
  FROM (SELECT g.session, g.arrival_seq AS rn, g.t_ms, g.raw::DOUBLE AS raw, greatest(g.t_ms - m.t_ms, 1)::DOUBLE AS dt, greatest(g.t_ms - m.t_ms, 1) / 1000::DOUBLE AS sec, m.fs AS fs0, m.hx, m.hp, m.x2, m.y1, m.y2, m.lp, m.base,
               m.centered, m.lf, m.fast, m.slow, 1::DOUBLE / (2 * pi() * 20) AS rc
        FROM m JOIN s g ON g.session = m.session AND g.arrival_seq = m.rn + 1))))))),
sn AS (SELECT *, sqrt(avg(centered * centered) OVER w) AS rms_state, sqrt(avg(lf * lf) OVER w) AS lf_energy, fast / greatest(slow, 1) AS slope_burst, CAST(rn AS BIGINT) AS arrival_seq
       FROM m WINDOW w AS (PARTITION BY session ORDER BY t_ms RANGE BETWEEN 180 PRECEDING AND CURRENT ROW)),
sr AS (SELECT *, lf_energy / greatest(rms_state, 5) AS artifact_ratio, rms_state / 5 AS u FROM sn)"""


def _snapshots(spark, sf) -> DataFrame:
    return dsp.snapshots(B.samples(spark, sf))


@query(f"{_DSP} SELECT session, arrival_seq, round(filtered, 6) AS filtered, round(centered, 6) AS centered, base AS baseline_raw FROM sr")
def filter_chain(spark, sf):
    """O-DSP-3..8."""
    return rounded(_snapshots(spark, sf), "filtered", "centered").select("session", "arrival_seq", "filtered", "centered", "baseline_raw")


@query(f"{_DSP} SELECT session, arrival_seq, round(lf, 6) AS lf, round(rms_state, 5) AS rms_state, round(lf_energy, 5) AS lf_energy FROM sr")
def lf_tracker(spark, sf):
    """O-DSP-9/10."""
    return rounded(rounded(_snapshots(spark, sf), "lf"), "rms_state", "lf_energy", digits=5).select("session", "arrival_seq", "lf", "rms_state", "lf_energy")


@query(f"{_DSP} SELECT session, arrival_seq, round(slope_burst, 6) AS slope_burst FROM sr")
def slope_burst(spark, sf):
    """O-DSP-1/11."""
    return rounded(_snapshots(spark, sf), "slope_burst").select("session", "arrival_seq", "slope_burst")


@query(f"{_DSP} SELECT session, arrival_seq, round(artifact_ratio, 5) AS artifact_ratio, round(greatest(artifact_ratio, CASE WHEN rn >= 5 THEN slope_burst ELSE 1 END), 5) AS artifact_score, round(u, 5) AS u FROM sr")
def artifact_score(spark, sf):
    """O-DSP-12/13."""
    return rounded(_snapshots(spark, sf), "artifact_ratio", "artifact_score", "u", digits=5).select("session", "arrival_seq", "artifact_ratio", "artifact_score", "u")


@query(f"{_DSP} SELECT session, arrival_seq, round(filtered, 6) AS filtered_raw, round(rms_state, 5) AS rect, round(rms_state, 5) AS a, 5::DOUBLE AS sigma, round(u, 5) AS z FROM sr")
def snapshot_aliases(spark, sf):
    """O-PRJ-19."""
    rows = rounded(dsp.with_aliases(_snapshots(spark, sf)), "rect", "a", "z", digits=5)
    return rounded(rows, "filtered_raw").select("session", "arrival_seq", "filtered_raw", "rect", "a", "sigma", "z")


@query(f"""WITH RECURSIVE {B.SQL}, m AS (
  SELECT session, arrival_seq, raw, 0::DOUBLE AS env_out, raw::DOUBLE AS base, 10 * 0.99::DOUBLE AS noise FROM s WHERE arrival_seq = 1
  UNION ALL SELECT session, arrival_seq, raw, e, CASE WHEN e < 4 * noise THEN 0.998::DOUBLE * base + 0.002::DOUBLE * raw ELSE base END, CASE WHEN e < 4 * noise THEN 0.99::DOUBLE * noise + 0.01::DOUBLE * e ELSE noise END
  FROM (SELECT g.session, g.arrival_seq, g.raw, m.base, m.noise, 0.9::DOUBLE * m.env_out + 0.1::DOUBLE * abs(g.raw - m.base) AS e FROM m JOIN s g ON g.session = m.session AND g.arrival_seq = m.arrival_seq + 1))
SELECT session, arrival_seq, raw, round(env_out, 6) AS env_out, round(base, 6) AS base, round(noise, 6) AS noise FROM m""")
def device_envelope(spark, sf):
    """O-SRC-14."""
    return rounded(dsp.device_envelope(B.samples(spark, sf)), "env_out", "base", "noise")


@query(f"""WITH {B.SQL}, w AS (SELECT session, arrival_seq, list_sort(list(raw::DOUBLE) OVER (PARTITION BY session ORDER BY t_ms RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW)) AS v FROM s),
 p AS (SELECT *, v[CAST(floor((len(v) - 1) * 0.5::DOUBLE) AS INT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] AS p90 FROM w)
SELECT session, arrival_seq, list_median(v) AS rest_center, round(greatest(p90 - p50, 1.4826::DOUBLE * list_median(list_transform(v, lambda x: abs(x - p50))), 5), 6) AS rest_scale FROM p""")
def rest_stats(spark, sf):
    """O-DSP-14/15."""
    rows = frames.with_segments(B.samples(spark, sf))
    return rounded(dsp.rest_statistics(rows, "raw"), "rest_scale").select("session", "arrival_seq", "rest_center", "rest_scale")


# Islands and joins

_R = f"WITH {B.SQL}, {B.RECORDS}"
_CL = "cl AS (SELECT session, ord, start_ms, end_ms FROM li)"


@query(f"{_R} SELECT session, ord, start_ms, end_ms FROM li")
def label_intervals(spark, sf):
    """O-ISL-1."""
    return islands.label_intervals(B.label_records(spark, sf))


@query(f"{_R} SELECT session, ord, name, label, start_ms, end_ms FROM pw")
def phase_windows(spark, sf):
    """O-ISL-2."""
    return islands.phase_windows(B.phase_markers(spark, sf))


@query(f"""{_R}, e AS (SELECT session, max(t_ms) AS session_end_ms FROM s GROUP BY session), o AS (SELECT session, start_ms, CASE WHEN ord % 5 > 0 THEN end_ms END AS end_ms FROM li)
SELECT session, start_ms, coalesce(end_ms, session_end_ms) AS end_ms, CASE WHEN end_ms IS NULL THEN 'session_end' ELSE 'label_end' END AS closed_by FROM o JOIN e USING (session)""")
def forced_close(spark, sf):
    """O-ISL-4; every fifth interval is left open."""
    open_ones = islands.label_intervals(B.label_records(spark, sf)).withColumn("end_ms", F.when(F.col("ord") % 5 > 0, F.col("end_ms")))
    ends = B.samples(spark, sf).groupBy("session").agg(F.max("t_ms").alias("session_end_ms"))
    return islands.forced_close(open_ones.drop("ord"), ends)


@query(f"""WITH {B.SQL}, e AS (SELECT session, arrival_seq, CASE raw % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' ELSE 'cancel' END AS phase, t_ms FROM s),
p AS (SELECT *, lead(phase) OVER w AS n, lead(t_ms) OVER w AS nt FROM e WINDOW w AS (PARTITION BY session ORDER BY arrival_seq))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY arrival_seq) AS ord, t_ms AS down_ms, CASE WHEN n = 'up' THEN nt END AS up_ms FROM p WHERE phase = 'down'""")
def press_pairs(spark, sf):
    """O-ISL-3, on phases taken from the values."""
    phase = F.when(F.col("raw") % 3 == 0, "down").when(F.col("raw") % 3 == 1, "up").otherwise("cancel")
    return islands.presses(B.samples(spark, sf).select("session", F.col("arrival_seq").alias("ord"), phase.alias("phase"), "t_ms"))


_E = f"""{_R}, {B.frames_sql("s")},
ft AS (SELECT session, frame, end_ms AS t_ms, waveform_length, rms_state, slope_burst, lf_energy_ratio FROM fr),
ex AS (SELECT ft.*, CASE WHEN hit = 1 THEN 1 ELSE 0 END AS label FROM ft LEFT JOIN (SELECT ft.session, ft.frame, max(CASE WHEN t_ms BETWEEN start_ms AND end_ms THEN 1 ELSE 0 END) AS hit
      FROM ft JOIN li ON ft.session = li.session AND t_ms BETWEEN start_ms - 4 AND end_ms + 4 GROUP BY ALL) h USING (session, frame) WHERE hit IS NULL OR hit = 1)"""


def _feature_frames(spark, sf) -> DataFrame:
    return _framed(B.samples(spark, sf)).select("session", F.col("frame").alias("ord_frame"), F.col("end_ms").alias("t_ms"), *training.FEATURES)


def _examples(spark, sf) -> DataFrame:
    return training.label_frames(_feature_frames(spark, sf), islands.label_intervals(B.label_records(spark, sf)), 4)


@query(f"{_E} SELECT session, t_ms, waveform_length, label FROM ex")
def label_frames(spark, sf):
    """O-JOIN-1, O-PRJ-14, O-ML-1."""
    return _examples(spark, sf).select("session", "t_ms", "waveform_length", "label")


@query(f"""{_R}, d AS (SELECT session, t_ms AS down_ms FROM s WHERE raw % 3 = 0), c AS (SELECT d.session, down_ms, arg_min(CASE WHEN contains(upper(name), 'ARTIFACT') THEN 'artifact' WHEN label IS NULL THEN 'rest' ELSE 'other' END, ord) AS b
 FROM d JOIN pw ON d.session = pw.session AND down_ms BETWEEN start_ms AND end_ms GROUP BY ALL)
SELECT session, down_ms, coalesce(b, 'other') AS bucket FROM d LEFT JOIN c USING (session, down_ms)""")
def classify_false_downs(spark, sf):
    """O-JOIN-2, O-PRJ-15."""
    downs = B.samples(spark, sf).where("raw % 3 = 0").select("session", F.col("t_ms").alias("down_ms"))
    return evaluate.classify_downs(downs, islands.phase_windows(B.phase_markers(spark, sf)))


@query(f"""{_R} SELECT session, coalesce(sum((end_ms - start_ms) / 1000.0::DOUBLE) FILTER (label IS NULL AND NOT contains(upper(name), 'ARTIFACT')), 0).round(6) AS rest_seconds,
 coalesce(sum((end_ms - start_ms) / 1000.0::DOUBLE) FILTER (contains(upper(name), 'ARTIFACT')), 0).round(6) AS artifact_seconds FROM pw GROUP BY session""")
def phase_seconds(spark, sf):
    """O-AGG-11."""
    return rounded(evaluate.phase_seconds(islands.phase_windows(B.phase_markers(spark, sf))), "rest_seconds", "artifact_seconds")


_GREEDY = """cs AS (SELECT session, list({'o': ord, 'd': down_ms} ORDER BY ord) AS ps FROM pr WHERE up_ms IS NOT NULL GROUP BY session),
gm AS (SELECT cl.session, cl.ord, [x.o] AS hit, CASE WHEN x IS NULL THEN []::BIGINT[] ELSE [x.o] END AS used FROM (SELECT cl.*, list_filter(ps, lambda p: p.d BETWEEN start_ms - TOL AND end_ms + TOL)[1] AS x FROM cl LEFT JOIN cs USING (session) WHERE ord = 1) cl
 UNION ALL SELECT session, ord, [x.o], CASE WHEN x IS NULL THEN used ELSE list_append(used, x.o) END
 FROM (SELECT cl.session, cl.ord, used, list_filter(ps, lambda p: NOT list_contains(used, p.o) AND p.d BETWEEN start_ms - TOL AND end_ms + TOL)[1] AS x FROM gm JOIN cl ON cl.session = gm.session AND cl.ord = gm.ord + 1 LEFT JOIN cs ON cs.session = cl.session)),
gr AS (SELECT session, ord AS click_ord, hit[1] AS press_ord FROM gm WHERE hit[1] IS NOT NULL)""".replace("TOL", "20")
_PR = """pr AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY arrival_seq) AS ord, t_ms AS down_ms, CASE WHEN n = 'up' THEN nt END AS up_ms FROM (
 SELECT *, lead(phase) OVER w AS n, lead(t_ms) OVER w AS nt FROM (SELECT session, arrival_seq, CASE raw % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' ELSE 'cancel' END AS phase, t_ms FROM s) WINDOW w AS (PARTITION BY session ORDER BY arrival_seq)) WHERE phase = 'down')"""


def _raw_events(spark, sf) -> DataFrame:
    phase = F.when(F.col("raw") % 3 == 0, "down").when(F.col("raw") % 3 == 1, "up").otherwise("cancel")
    return B.samples(spark, sf).select("session", F.col("arrival_seq").alias("ord"), phase.alias("phase"), "t_ms")


@query(f"{_R.replace('WITH', 'WITH RECURSIVE', 1)}, {_CL}, {_PR}, {_GREEDY} SELECT session, click_ord, press_ord FROM gr")
def greedy_match(spark, sf):
    """O-JOIN-3."""
    return evaluate.greedy_match(islands.label_intervals(B.label_records(spark, sf)), islands.presses(_raw_events(spark, sf)), 20, 20)


@query(f"{_R.replace('WITH', 'WITH RECURSIVE', 1)}, {_CL}, {_PR}, {_GREEDY} SELECT session, ord, down_ms, up_ms FROM pr WHERE up_ms IS NOT NULL AND NOT EXISTS (FROM gr WHERE gr.session = pr.session AND press_ord = pr.ord)")
def unused_presses(spark, sf):
    """O-JOIN-4."""
    pressed = islands.presses(_raw_events(spark, sf))
    return evaluate.unused_presses(pressed, evaluate.greedy_match(islands.label_intervals(B.label_records(spark, sf)), pressed, 20, 20))


@query(f"{_E} SELECT count(*) AS n, count(DISTINCT session) AS sessions, sum(label)::BIGINT AS positives FROM ex WHERE session IN (SELECT session FROM pw WHERE label IS NOT NULL)")
def eligible_examples(spark, sf):
    """O-JOIN-5, O-SRC-9."""
    eligible = islands.phase_windows(B.phase_markers(spark, sf)).where("label IS NOT NULL").select("session")
    return _examples(spark, sf).join(eligible, "session", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"), F.sum("label").alias("positives"))


@query(f"{_E}, v AS (SELECT DISTINCT session FROM ex WHERE session % 4 = 0) SELECT session IN (FROM v) AS held, count(*) AS n FROM ex GROUP BY ALL")
def split_examples(spark, sf):
    """O-JOIN-10, O-SET-3."""
    rows = _examples(spark, sf)
    held = rows.where("session % 4 = 0").select("session").distinct()
    kept = rows.join(held, "session", "left_anti").withColumn("held", F.lit(False)).unionByName(rows.join(held, "session", "left_semi").withColumn("held", F.lit(True)))
    return kept.groupBy("held").agg(F.count("*").alias("n"))


# Scores and statistics

_SIG = "CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-({0}))) ELSE exp({0}) / (1 + exp({0})) END"


@query(f"{_F} SELECT session, CAST(segment AS BIGINT) AS segment, frame, round({_SIG.format('((waveform_length - 5000) / 800)')}, 6) AS p, round({_SIG.format('(0.8 * ((rms_state - 1200) / 400) - 0.5 * ((slope_burst - 90) / 1) + 0.1)')}, 6) AS q FROM fr")
def model_scores(spark, sf):
    """O-PRJ-7, 9, 10, 11."""
    c, none = F.col, F.lit(None).cast("double")
    scaled = [C.normalise(c("rms_state"), F.lit(1200.0), F.lit(400.0), F.lit(1e-6)), C.normalise(c("slope_burst"), F.lit(90.0), none, none)]
    rows = _frames(spark, sf).withColumns({"p": C.threshold_score(c("waveform_length"), 5000.0, 800.0), "q": C.logreg_score(scaled, [0.8, -0.5, 9.0], 0.1)})
    return rounded(rows, "p", "q").select("session", "segment", "frame", "p", "q")


@query("SELECT user_id AS session, sha256(string_agg(DISTINCT event_type, '|' ORDER BY event_type)) AS feature_hash FROM events GROUP BY user_id")
def feature_hash(spark, sf):
    """O-PRJ-6, on the event types of each user."""
    names = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("session")).agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return names.select("session", C.feature_hash(F.col("names")).alias("feature_hash"))


@query(f"""WITH {B.SQL}, l AS (SELECT session, list_sort(list(raw::DOUBLE)) AS v FROM s GROUP BY session)
SELECT session, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] AS p90, v[CAST(floor((len(v) - 1) * 0.1::DOUBLE) AS INT) + 1] AS p10 FROM l""")
def lower_percentile(spark, sf):
    """O-AGG-5; ranks from counts, not from gathered values."""
    values = B.samples(spark, sf).select("session", F.col("raw").cast("double").alias("value"))
    return training.robust_statistics(values, ["session"]).select("session", "p90", "p10")


@query(f"""WITH {B.SQL}, l AS (SELECT session, list_sort(list(raw::DOUBLE)) AS v FROM s GROUP BY session), d AS (SELECT session, v, list_median(v) AS c FROM l), e AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - c))) AS mad FROM d)
SELECT session, c AS center, mad, round(greatest(1.4826::DOUBLE * mad, (v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] - v[CAST(floor((len(v) - 1) * 0.1::DOUBLE) AS INT) + 1]) / 2.563::DOUBLE, 1e-6), 6) AS scale FROM e""")
def robust_scale(spark, sf):
    """O-AGG-4, 6, 7."""
    values = B.samples(spark, sf).select("session", F.col("raw").cast("double").alias("value"))
    return rounded(training.robust_statistics(values, ["session"]), "scale").select("session", "center", "mad", "scale")


@query(f"""{_E}, u AS (SELECT 'waveform_length' AS feature, waveform_length AS x FROM ex UNION ALL SELECT 'slope_burst', slope_burst FROM ex), l AS (SELECT feature, list_sort(list(x)) AS v FROM u GROUP BY feature),
d AS (SELECT *, list_median(v) AS c FROM l)
SELECT feature, c AS center, round(greatest(1.4826::DOUBLE * list_median(list_transform(v, lambda x: abs(x - c))), (v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] - v[CAST(floor((len(v) - 1) * 0.1::DOUBLE) AS INT) + 1]) / 2.563::DOUBLE, 1e-6), 6) AS scale FROM d""")
def fit_normalization(spark, sf):
    """O-AGG-8, O-PRJ-8."""
    return rounded(training.fit_normalisation(_examples(spark, sf), ["waveform_length", "slope_burst"]), "scale")


_CONF = """tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall, (tp + tn) / greatest(tp + fp + tn + fn, 1)::DOUBLE AS accuracy"""


@query(f"""{_E}, c AS (SELECT session, count(*) FILTER (waveform_length >= 5000 AND label = 1) AS tp, count(*) FILTER (waveform_length >= 5000 AND label = 0) AS fp, count(*) FILTER (waveform_length < 5000 AND label = 0) AS tn, count(*) FILTER (waveform_length < 5000 AND label = 1) AS fn FROM ex GROUP BY session),
p AS (SELECT *, {_CONF} FROM c) SELECT session, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1 FROM p""")
def confusion(spark, sf):
    """O-AGG-1/2, O-ML-5."""
    scored = _examples(spark, sf).withColumn("p", C.threshold_score(F.col("waveform_length"), 5000.0, 800.0))
    return rounded(training.confusion(scored, ["session"]), "precision", "recall", "accuracy", "f1")


_TS = """vals AS (SELECT KEY AS k, waveform_length AS v, count(*) AS n, sum(label) AS pos FROM SRC GROUP BY ALL),
cand AS (SELECT k, v, (v + lead(v) OVER (PARTITION BY k ORDER BY v)) / 2 AS mid, count(*) OVER (PARTITION BY k) AS d FROM vals),
thr AS (SELECT k, CASE WHEN d = 1 THEN v ELSE mid END AS threshold FROM cand WHERE d = 1 OR mid IS NOT NULL),
tf AS (SELECT k, threshold, tp / greatest(said, 1)::DOUBLE AS p, tp / greatest(tot, 1)::DOUBLE AS r FROM (SELECT thr.k, threshold, coalesce(sum(pos) FILTER (v >= threshold), 0) AS tp, coalesce(sum(n) FILTER (v >= threshold), 0) AS said, sum(pos) AS tot FROM thr JOIN vals USING (k) GROUP BY ALL)),
tb AS (SELECT k, threshold, f1 FROM (SELECT *, 2 * p * r / greatest(p + r, 1e-12) AS f1 FROM tf) QUALIFY row_number() OVER (PARTITION BY k ORDER BY f1 DESC, threshold) = 1),
md AS (SELECT KEY AS k, median(waveform_length) FILTER (label = 1) AS m1, median(waveform_length) FILTER (label = 0) AS m0 FROM SRC GROUP BY ALL),
th AS (SELECT tb.k, threshold, f1, greatest(abs(coalesce(m1, threshold) - coalesce(m0, threshold)) / 4, 1) AS softness FROM tb JOIN md USING (k))"""


@query(f"{_E}, {_TS.replace('KEY', 'session').replace('SRC', 'ex')} SELECT k AS session, threshold, round(f1, 6) AS f1, softness FROM th")
def threshold_search(spark, sf):
    """O-ML-3/4, O-AGG-3, O-LIM-4."""
    return rounded(training.threshold_search(_examples(spark, sf), "waveform_length", ["session"]), "f1")


@query(f"{_E} SELECT session, count(*) AS n, round(count(*) / (2 * greatest(sum(label), 1)), 6) AS pos_weight, round(count(*) / (2 * greatest(count(*) - sum(label), 1)), 6) AS neg_weight FROM ex GROUP BY session")
def class_weights(spark, sf):
    """O-AGG-13."""
    return rounded(training.class_weights(_examples(spark, sf), ["session"]), "pos_weight", "neg_weight")


@query(f"{_E} SELECT session, t_ms, label FROM (SELECT *, row_number() OVER (ORDER BY session, t_ms) AS n, greatest(floor(count(*) OVER () * 0.5::DOUBLE), 1) AS most FROM ex) WHERE n <= most")
def study_prefix_subset(spark, sf):
    """O-ML-13, O-LIM-2: one prefix of all examples, sessions in order."""
    return training.prefix(_examples(spark, sf), 0.5, ["t_ms"]).select("session", "t_ms", "label")


_START = [x for r in [random.Random(7)] for x in (r.uniform(-0.01, 0.01), r.uniform(-0.01, 0.01))]


@query(f"""{_E.replace('WITH', 'WITH RECURSIVE', 1)}, u AS (SELECT 'a' AS feature, waveform_length AS x FROM ex UNION ALL SELECT 'b', slope_burst FROM ex), l AS (SELECT feature, list_sort(list(x)) AS v FROM u GROUP BY feature), d AS (SELECT *, list_median(v) AS c FROM l),
st AS (SELECT feature, c, greatest(1.4826::DOUBLE * list_median(list_transform(v, lambda x: abs(x - c))), (v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] - v[CAST(floor((len(v) - 1) * 0.1::DOUBLE) AS INT) + 1]) / 2.563::DOUBLE, 1e-6) AS sc FROM d),
nx AS (SELECT ex.session, ex.t_ms, ex.label, (waveform_length - sa.c) / sa.sc AS xa, (slope_burst - sb.c) / sb.sc AS xb FROM ex, (FROM st WHERE feature = 'a') sa, (FROM st WHERE feature = 'b') sb),
wt AS (SELECT count(*)::DOUBLE AS n, count(*) / (2 * greatest(sum(label), 1)) AS pw, count(*) / (2 * greatest(count(*) - sum(label), 1)) AS nw FROM nx),
lg AS (SELECT 0 AS e, {_START[0]!r}::DOUBLE AS wa, {_START[1]!r}::DOUBLE AS wb, 0::DOUBLE AS b
 UNION ALL SELECT e + 1, wa - 0.05::DOUBLE * (ga / n + 1e-4 * wa), wb - 0.05::DOUBLE * (gb / n + 1e-4 * wb), b - 0.05::DOUBLE * g / n
 FROM (SELECT e, wa, wb, b, n, sum(diff * xa) AS ga, sum(diff * xb) AS gb, sum(diff) AS g FROM (SELECT lg.*, n, xa, xb, ({_SIG.format('(wa * xa + wb * xb + b)')} - label) * CASE WHEN label = 1 THEN pw ELSE nw END AS diff FROM lg, nx, wt WHERE e < 200) GROUP BY e, wa, wb, b, n))
SELECT session, t_ms, label, round({_SIG.format('(wa * xa + wb * xb + b)')}, 6) AS p FROM nx, (FROM lg WHERE e = 200)""")
def logreg_fit(spark, sf):
    """O-ML-6: 200 epochs over all examples."""
    rows = _examples(spark, sf)
    model = training.fit_logreg(rows, ["waveform_length", "slope_burst"])
    scaled = [(F.col(f) - model["center"][f]) / max(model["scale"][f], 1e-6) for f in model["features"]]
    return rounded(rows.select("session", "t_ms", "label", C.logreg_score(scaled, model["weights"], model["bias"]).alias("p")), "p")


_STUDY = """SELECT {0}::DOUBLE AS fraction, count(*) FILTER (said AND label = 1) AS tp, count(*) FILTER (said AND label = 0) AS fp, count(*) FILTER (NOT said AND label = 0) AS tn, count(*) FILTER (NOT said AND label = 1) AS fn,
 any_value(threshold) AS threshold, any_value(n) AS train_examples FROM (SELECT label, waveform_length >= threshold AS said, threshold, n FROM ex, (SELECT threshold FROM th{1}), (SELECT count(*) AS n FROM tr{1}) WHERE session % 4 = 0)"""
_FRACTIONS = (0.25, 0.5, 1.0)


@query(f"{_E}, tb0 AS (SELECT *, row_number() OVER (ORDER BY session, t_ms) AS n, count(*) OVER () AS c FROM ex WHERE session % 4 <> 0), "
       + ", ".join(f"tr{i} AS (SELECT * FROM tb0 WHERE n <= greatest(floor(c * {x}::DOUBLE), 1)), " + re.sub(r"\b(vals|cand|thr|tf|tb|md|th)\b", rf"\g<1>{i}", _TS.replace("KEY", "1").replace("SRC", f"tr{i}")) for i, x in enumerate(_FRACTIONS, 1))
       + " SELECT * FROM (" + " UNION ALL ".join(_STUDY.format(x, i) for i, x in enumerate(_FRACTIONS, 1)) + ")")
def study_threshold(spark, sf):
    """O-JOIN-8, O-ML-2/5/13: threshold models of growing prefixes of the training sessions, on the others."""
    rows = _examples(spark, sf)
    parts = training.study_threshold(rows.where("session % 4 != 0"), rows.where("session % 4 = 0"), "waveform_length", _FRACTIONS, ["t_ms"])
    return parts.select("fraction", "tp", "fp", "tn", "fn", "threshold", "train_examples")


# Decisions


_PSC = f"{_E}, sc AS (SELECT session, t_ms, row_number() OVER (PARTITION BY session ORDER BY t_ms) AS i, waveform_length AS wl FROM ft), ps AS (SELECT session, i, t_ms, {_SIG.format('((wl - 5000) / 800)')} AS p, 0.6::DOUBLE AS en, 0.4::DOUBLE AS ex, 1 AS ed, 2 AS rd, 20 AS me, 80 AS rf FROM sc), fin AS (SELECT session, arg_max(t_ms, arrival_seq) AS final FROM s GROUP BY session)"
#: Events of ``ps`` by the gates in it; ``ge0`` as live runs see them, ``ge`` with open presses closed at the last sample.
_GATE = """gt AS (SELECT session, 0::BIGINT AS i, 0::BIGINT AS t_ms, false AS active, NULL::BOOLEAN AS pending, 0::BIGINT AS cnt, 0::BIGINT AS start_ms, 0::BIGINT AS until_ms, NULL::VARCHAR AS phase, 0::BIGINT AS dur, 0::BIGINT AS ev_start, 0::INTEGER AS me FROM (SELECT DISTINCT session FROM ps)
 UNION ALL SELECT session, i, t_ms, CASE WHEN go THEN target ELSE active END, CASE WHEN go OR target = active THEN NULL ELSE target END, CASE WHEN go OR target = active THEN 0 ELSE c2 END,
   CASE WHEN go AND target THEN t_ms ELSE start_ms END, CASE WHEN go AND NOT target THEN t_ms + rf ELSE until_ms END,
   CASE WHEN go THEN CASE WHEN target THEN 'down' WHEN greatest(t_ms - start_ms, 0) >= me THEN 'up' ELSE 'cancel' END END, CASE WHEN go AND NOT target THEN greatest(t_ms - start_ms, 0) ELSE 0 END, CASE WHEN target THEN t_ms ELSE start_ms END, me
 FROM (SELECT *, target <> active AND c2 >= CASE WHEN target THEN ed ELSE rd END AS go FROM (SELECT *, CASE WHEN pending = target THEN cnt + 1 ELSE 1 END AS c2 FROM (
   SELECT g.session, g.i, g.t_ms, g.ed, g.rd, g.me, g.rf, gt.active, gt.pending, gt.cnt, gt.start_ms, gt.until_ms, (CASE WHEN gt.active THEN g.p > g.ex ELSE g.p >= g.en END) AND g.t_ms >= gt.until_ms AS target FROM gt JOIN ps g ON g.session = gt.session AND g.i = gt.i + 1)))),
ge0 AS (SELECT session, i, phase, ev_start AS start_ms, t_ms AS end_ms, dur AS duration_ms FROM gt WHERE phase IS NOT NULL),
lf AS (SELECT session, max(i) AS last FROM ps GROUP BY session),
ge AS (SELECT * FROM ge0 UNION ALL SELECT session, i + 1, CASE WHEN greatest(final - start_ms, 0) >= me THEN 'up' ELSE 'cancel' END, start_ms, final, greatest(final - start_ms, 0) FROM gt JOIN fin USING (session) JOIN lf USING (session) WHERE active AND i = last),
ev AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY i) AS ord, phase, start_ms, end_ms, duration_ms FROM ge),
sw AS (SELECT session, ord, phase, CASE WHEN phase = 'down' THEN start_ms ELSE end_ms END AS t_ms, CASE WHEN phase = 'down' THEN 0 ELSE duration_ms END AS duration_ms, 'active' AS source_state FROM ev)"""
_RPS = _PSC.replace("WITH", "WITH RECURSIVE", 1)
GATE = decide.Gate(enter_dwell=1, release_dwell=2, min_event_ms=20)


def _ends(spark, sf) -> DataFrame:
    return decide.session_ends(B.samples(spark, sf))


def _edges(spark, sf) -> DataFrame:
    return decide.edge_events(_scored(spark, sf), GATE, _ends(spark, sf))


def _scored(spark, sf) -> DataFrame:
    return _feature_frames(spark, sf).select("session", "ord_frame", "t_ms", C.threshold_score(F.col("waveform_length"), 5000.0, 800.0).alias("p"))


@query(f"{_PSC} SELECT session, t_ms, coalesce(last_value(CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i), 0)::INTEGER AS active FROM ps")
def hysteresis(spark, sf):
    """O-DEC-1."""
    return decide.hysteresis(_scored(spark, sf)).select("session", "t_ms", "active")


@query(f"{_RPS}, {_GATE} SELECT session, ord, phase, start_ms, end_ms, duration_ms FROM ev")
def decision_events(spark, sf):
    """O-DEC-2..6, O-DEC-9."""
    return _edges(spark, sf)


@query(f"{_RPS}, {_GATE} SELECT session, ord, phase, t_ms, duration_ms, source_state FROM sw")
def switch_events(spark, sf):
    """O-PRJ-12."""
    return decide.switch_events(_edges(spark, sf))


@query(f"""{_RPS}, {_GATE} SELECT session, ord, '{{"type":"switch","phase":"' || phase || '","t_ms":' || t_ms || ',"duration_ms":' || duration_ms || ',"source_state":"active"}}' AS json FROM sw""")
def event_json(spark, sf):
    """O-PRJ-13, O-SNK-2/3."""
    return decide.event_json(decide.switch_events(_edges(spark, sf)))


@query(f"{_RPS}, {_GATE} SELECT session, i AS ord_frame, t_ms, active::INTEGER AS active FROM gt WHERE i > 0")
def frame_states(spark, sf):
    """O-DEC-7/10."""
    scored = _scored(spark, sf).withColumn("ord_frame", F.row_number().over(Window.partitionBy("session").orderBy("t_ms")).cast("bigint"))
    return decide.frame_states(scored, GATE).select("session", "ord_frame", "t_ms", "active")


@query(f"{_RPS}, {_GATE} SELECT session, ord, count(*) FILTER (phase = 'up') OVER w AS clicks, last_value(CASE WHEN phase = 'up' THEN duration_ms END IGNORE NULLS) OVER w AS last_duration_ms FROM sw WINDOW w AS (PARTITION BY session ORDER BY ord)")
def click_counts(spark, sf):
    """O-AGG-15, O-DEC-10."""
    return decide.click_counts(decide.switch_events(_edges(spark, sf))).select("session", "ord", "clicks", "last_duration_ms")


@query(f"{_RPS}, {_GATE}, fl AS (SELECT session, end_ms AS t_ms, bool_or(phase = 'down') AS down, bool_or(phase = 'up') AS up FROM ev GROUP BY ALL) SELECT session, t_ms, coalesce(down, false) AS down, coalesce(up, false) AS up FROM ps LEFT JOIN fl USING (session, t_ms)")
def overlay_flags(spark, sf):
    """O-DEC-11, O-PRJ-20."""
    return decide.overlay(_scored(spark, sf), GATE, _ends(spark, sf)).select("session", "t_ms", "down", "up")


# Evaluation

_SCORES = f"""pr AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ord) AS ord, t_ms AS down_ms, CASE WHEN n = 'up' THEN nt END AS up_ms FROM (SELECT *, lead(phase) OVER w AS n, lead(t_ms) OVER w AS nt FROM sw WINDOW w AS (PARTITION BY session ORDER BY ord)) WHERE phase = 'down'),
{_CL}, {_GREEDY},
hi AS (SELECT gr.session, count(*) AS detected, list((down_ms - start_ms)::DOUBLE) AS dl, list((up_ms - end_ms)::DOUBLE) AS ul, list((greatest(up_ms - down_ms, 0) - (end_ms - start_ms))::DOUBLE) AS de FROM gr JOIN cl ON cl.session = gr.session AND cl.ord = click_ord JOIN pr ON pr.session = gr.session AND pr.ord = press_ord GROUP BY gr.session),
un AS (SELECT pr.session, ord, down_ms FROM pr WHERE up_ms IS NOT NULL AND NOT EXISTS (FROM gr WHERE gr.session = pr.session AND press_ord = pr.ord)),
bk AS (SELECT un.session, un.ord, coalesce(arg_min(CASE WHEN contains(upper(name), 'ARTIFACT') THEN 'artifact' WHEN label IS NULL THEN 'rest' ELSE 'other' END, pw.ord) FILTER (name IS NOT NULL), 'other') AS b FROM un LEFT JOIN pw ON un.session = pw.session AND down_ms BETWEEN pw.start_ms AND pw.end_ms GROUP BY ALL),
fd AS (SELECT session, count(*) FILTER (b = 'rest') AS fr_, count(*) FILTER (b = 'artifact') AS fa, count(*) FILTER (b = 'other') AS fo FROM bk GROUP BY session),
se AS (SELECT session, coalesce(sum((end_ms - start_ms) / 1000::DOUBLE) FILTER (label IS NULL AND NOT contains(upper(name), 'ARTIFACT')), 0) AS rs, coalesce(sum((end_ms - start_ms) / 1000::DOUBLE) FILTER (contains(upper(name), 'ARTIFACT')), 0) AS ar FROM pw GROUP BY session),
ca AS (SELECT session, count(*) FILTER (up_ms IS NULL) AS c FROM pr GROUP BY session), nc AS (SELECT session, count(*) AS c FROM cl GROUP BY session),
ss AS (SELECT x.session, coalesce(nc.c, 0) AS clicks, coalesce(detected, 0) AS detected, coalesce(nc.c, 0) - coalesce(detected, 0) AS missed, coalesce(ca.c, 0) AS cancelled, coalesce(fr_, 0) AS false_rest, coalesce(fa, 0) AS false_artifact, coalesce(fo, 0) AS false_other,
  coalesce(rs, 0) AS rest_seconds, coalesce(ar, 0) AS artifact_seconds, dl, ul, de
  FROM (SELECT DISTINCT session FROM s) x LEFT JOIN nc USING (session) LEFT JOIN hi USING (session) LEFT JOIN ca USING (session) LEFT JOIN fd USING (session) LEFT JOIN se USING (session))"""


def _session_scores(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = decide.switch_events(_edges(spark, sf))
    return evaluate.session_scores(
        B.samples(spark, sf).select("session").distinct(), events, islands.label_intervals(B.label_records(spark, sf)), islands.phase_windows(B.phase_markers(spark, sf)), 20, 20
    )


@query(f"{_RPS}, {_GATE}, {_SCORES} SELECT session, clicks, detected, missed, cancelled, false_rest, false_artifact, false_other, round(rest_seconds, 6) AS rest_seconds, round(artifact_seconds, 6) AS artifact_seconds, coalesce(list_sum(dl), 0)::DOUBLE AS down_sum, coalesce(list_sum(ul), 0)::DOUBLE AS up_sum, coalesce(list_sum(de), 0)::DOUBLE AS error_sum FROM ss")
def session_scores(spark, sf):
    """O-AGG-9, O-EVL-9, O-PRJ-16."""
    scores, hits = _session_scores(spark, sf)
    sums = hits.groupBy("session").agg(F.sum("down_latency").alias("down_sum"), F.sum("up_latency").alias("up_sum"), F.sum("duration_error").alias("error_sum"))
    rows = scores.join(sums, "session", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("down_sum", "up_sum", "error_sum")})
    return rounded(rows, "rest_seconds", "artifact_seconds")


@query(f"""{_RPS}, {_GATE}, {_SCORES}, t AS (SELECT count(*) AS sessions, sum(clicks)::BIGINT AS clicks, sum(detected)::BIGINT AS detected, sum(missed)::BIGINT AS missed, sum(cancelled)::BIGINT AS cancelled, sum(false_rest)::BIGINT AS false_rest, sum(false_artifact)::BIGINT AS false_artifact, sum(rest_seconds) AS rs, sum(artifact_seconds) AS ar, flatten(list(dl)) AS dl, flatten(list(ul)) AS ul, flatten(list(de)) AS de FROM ss)
SELECT sessions, clicks, detected, missed, cancelled, false_rest, false_artifact, round(rs, 6) AS rest_seconds, round(ar, 6) AS artifact_seconds, coalesce(list_median(dl), 0)::DOUBLE AS down_latency_median, round(coalesce(list_avg(dl), 0), 6)::DOUBLE AS down_latency_mean, coalesce(list_median(ul), 0)::DOUBLE AS up_latency_median, coalesce(list_median(de), 0)::DOUBLE AS duration_error_median,
 round(CASE WHEN clicks > 0 THEN detected / clicks ELSE 0 END, 6)::DOUBLE AS detection_rate, round(CASE WHEN rs > 0 THEN false_rest / (rs / 60) ELSE 0 END, 6)::DOUBLE AS false_rest_per_min, round(CASE WHEN ar > 0 THEN false_artifact / (ar / 60) ELSE 0 END, 6)::DOUBLE AS false_artifact_per_min FROM t""")
def aggregate_scores(spark, sf):
    """O-AGG-10, O-PRJ-17."""
    rows = evaluate.aggregate_scores(*_session_scores(spark, sf))
    return rounded(rows, "rest_seconds", "artifact_seconds", "down_latency_mean", "detection_rate", "false_rest_per_min", "false_artifact_per_min")


@query(f"""{_E}, fo AS (SELECT DISTINCT s.session AS fold FROM s), lo AS (SELECT fold, ex.* FROM fo JOIN ex ON ex.session <> fold), {_TS.replace('KEY', 'fold').replace('SRC', 'lo')} SELECT k AS session, threshold, round(f1, 6) AS f1, softness FROM th""")
def loso_threshold(spark, sf):
    """O-EVL-2/3, O-JOIN-6."""
    return rounded(evaluate.loso_models(_examples(spark, sf), B.samples(spark, sf).select("session").distinct(), "waveform_length"), "f1")


_GRID = "gd AS (SELECT (((e.i * 2 + x.i) * 3 + m.i) * 2 + d.i)::INTEGER AS config, e.v AS en, x.v AS ex, m.v AS me, d.v AS ed FROM (VALUES (0, 0.6::DOUBLE), (1, 0.7), (2, 0.8)) e(i, v), (VALUES (0, 0.4::DOUBLE), (1, 0.5)) x(i, v), (VALUES (0, 50), (1, 120), (2, 200)) m(i, v), (VALUES (0, 2), (1, 3)) d(i, v))"
#: Sessions under each gate stand for themselves, numbered ``config * 1000000 + session``.
_SWEEP = f"""{_E.replace('WITH', 'WITH RECURSIVE', 1)}, fo AS (SELECT DISTINCT s.session AS fold FROM s), lo AS (SELECT fold, ex.* FROM fo JOIN ex ON ex.session <> fold), {_TS.replace('KEY', 'fold').replace('SRC', 'lo')}, {_GRID},
sc AS (SELECT session, t_ms, row_number() OVER (PARTITION BY session ORDER BY t_ms) AS i, waveform_length AS wl FROM ft),
ps AS (SELECT config * 1000000 + session AS session, i, t_ms, {_SIG.format('((wl - threshold) / softness)')} AS p, en, gd.ex, ed, 2 AS rd, me, 80 AS rf FROM sc JOIN th ON k = session, gd),
fin AS (SELECT config * 1000000 + session AS session, arg_max(t_ms, arrival_seq) AS final FROM s, gd GROUP BY ALL), {_GATE},
lx AS (SELECT config * 1000000 + session AS session, ord, start_ms, end_ms FROM li, gd), px AS (SELECT config * 1000000 + session AS session, ord, name, label, start_ms, end_ms FROM pw, gd), sx AS (SELECT DISTINCT config * 1000000 + session AS session FROM s, gd),
{_SCORES.replace('FROM li', 'FROM lx').replace('LEFT JOIN pw ON', 'LEFT JOIN px pw ON').replace('FROM pw GROUP', 'FROM px GROUP').replace('SELECT DISTINCT session FROM s)', 'SELECT session FROM sx)')},
t AS (SELECT session // 1000000 AS config, count(*) AS sessions, sum(clicks)::BIGINT AS clicks, sum(detected)::BIGINT AS detected, sum(missed)::BIGINT AS missed, sum(cancelled)::BIGINT AS cancelled, sum(false_rest)::BIGINT AS false_rest, sum(false_artifact)::BIGINT AS false_artifact, sum(rest_seconds) AS rs, sum(artifact_seconds) AS ar, flatten(list(dl)) AS dl, flatten(list(ul)) AS ul, flatten(list(de)) AS de FROM ss GROUP BY ALL),
z AS (SELECT config::INTEGER AS config, sessions, clicks, detected, missed, cancelled, false_rest, false_artifact, rs AS rest_seconds, ar AS artifact_seconds, coalesce(list_median(dl), 0)::DOUBLE AS down_latency_median, coalesce(list_avg(dl), 0)::DOUBLE AS down_latency_mean, coalesce(list_median(ul), 0)::DOUBLE AS up_latency_median, coalesce(list_median(de), 0)::DOUBLE AS duration_error_median,
 CASE WHEN clicks > 0 THEN detected / clicks ELSE 0 END::DOUBLE AS detection_rate, CASE WHEN rs > 0 THEN false_rest / (rs / 60) ELSE 0 END::DOUBLE AS false_rest_per_min, CASE WHEN ar > 0 THEN false_artifact / (ar / 60) ELSE 0 END::DOUBLE AS false_artifact_per_min FROM t),
zr AS (SELECT *, detection_rate >= 0.5 AND down_latency_median <= 20 AS meets_floor FROM z)"""
_DOUBLES = ("rest_seconds", "artifact_seconds", "down_latency_mean", "detection_rate", "false_rest_per_min", "false_artifact_per_min")


@query(f"""{_SWEEP} SELECT zr.* REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _DOUBLES)}), row_number() OVER (ORDER BY CASE WHEN meets_floor THEN 0 ELSE 1 END, round(false_rest_per_min, 6), round(false_artifact_per_min, 6), -round(detection_rate, 6), down_latency_median, config) AS rank,
 en AS enter, ex AS "exit", ed AS enter_dwell, 2 AS release_dwell, me AS min_event_ms, 80 AS refractory_ms FROM zr JOIN gd USING (config)""")
def decision_sweep(spark, sf):
    """O-EVL-1, 4..7, O-JOIN-7, O-SRT-1, O-LIM-1: every session under the model of the others and each of the 36 gates,
    ranked."""
    grid, samples = evaluate.decision_grid(spark), B.samples(spark, sf)
    names = samples.select("session").distinct()
    models = evaluate.loso_models(_examples(spark, sf), names, "waveform_length")
    events = evaluate.replay(_feature_frames(spark, sf), models, "waveform_length", _ends(spark, sf), grid)
    wanted = names.crossJoin(F.broadcast(grid.select("config")))
    scores, hits = evaluate.session_scores(wanted, events, islands.label_intervals(B.label_records(spark, sf)), islands.phase_windows(B.phase_markers(spark, sf)), 20, 20)
    total = rounded(evaluate.aggregate_scores(scores, hits, ("config",)), *_DOUBLES)
    return evaluate.rank_sweep(total, 0.5, 20.0).join(F.broadcast(grid), "config")


@query("""WITH p(idx, name, d, label) AS (VALUES (0, 'SETTLE', 1.0, NULL), (1, 'REST', 2.0, NULL), (2, 'CLICK 1/3', 0.5, 'CLICK'), (3, 'REST', 1.0, NULL), (4, 'CLICK 2/3', 0.5, 'CLICK'), (5, 'REST', 1.0, NULL), (6, 'CLICK 3/3', 0.5, 'CLICK'), (7, 'ARTIFACT_NO_LABEL', 4.0, NULL), (8, 'REST', 2.0, NULL)),
t AS (SELECT *, sum(d) OVER (ORDER BY idx) AS e FROM p), x AS (SELECT event_id, value / 40 AS elapsed_s FROM events)
SELECT event_id, round(elapsed_s, 6) AS elapsed_s, idx::BIGINT AS phase_idx, name AS phase, round(elapsed_s - (e - d), 6)::DOUBLE AS phase_elapsed_s, round(e - elapsed_s, 6)::DOUBLE AS phase_left_s FROM x LEFT JOIN t ON elapsed_s >= e - d AND elapsed_s < e""")
def phase_at(spark, sf):
    """O-PRO-1..3, O-JOIN-9, O-AGG-16."""
    script = spark.createDataFrame(protocol.build(settle=1, rest=2, trials=3, press=0.5, gap=1, final_rest=2, artifact=4), protocol.SCHEMA)
    times = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("value") / 40).alias("elapsed_s"))
    return rounded(protocol.phase_at(times, script), "elapsed_s", "phase_elapsed_s", "phase_left_s")


@query(f"WITH {B.SQL} SELECT session, arrival_seq, t_ms, raw, env FROM s WHERE arrival_seq % 13 <> 0")
def sql_parse_line(spark, sf):
    """O-PRJ-1 as a function of SQL."""
    functions_sql.register(spark)
    return spark.sql("SELECT session, arrival_seq, p.* FROM (SELECT session, arrival_seq, parse_line(line) AS p FROM {lines}) WHERE p IS NOT NULL", lines=B.lines(spark, sf))


@query("""WITH p(idx, name, d, label) AS (VALUES (0, 'SETTLE', 1.0, NULL), (1, 'REST', 2.0, NULL), (2, 'CLICK 1/3', 0.5, 'CLICK'), (3, 'REST', 1.0, NULL), (4, 'CLICK 2/3', 0.5, 'CLICK'), (5, 'REST', 1.0, NULL), (6, 'CLICK 3/3', 0.5, 'CLICK'), (7, 'ARTIFACT_NO_LABEL', 4.0, NULL), (8, 'REST', 2.0, NULL)),
t AS (SELECT *, sum(d) OVER (ORDER BY idx) AS e FROM p) SELECT idx::BIGINT AS idx, name, label, d::DOUBLE AS duration_s, count(event_id) AS events FROM t LEFT JOIN events ON value / 40 >= e - d AND value / 40 < e GROUP BY ALL""")
def sql_protocol(spark, sf):
    """O-PRO-1..3 as a table function of SQL, with how many events fall into each phase. A row for each phase."""
    functions_sql.register(spark)
    return spark.sql(
        """WITH t AS (SELECT *, sum(duration_s) OVER (ORDER BY idx) AS end_s FROM build_protocol(settle => 1, rest => 2, trials => 3, press => 0.5, gap => 1, final_rest => 2, artifact => 4)),
        x AS (SELECT floor(value / 40 * 2) AS half, event_id, value / 40 AS at FROM {events}),
        n AS (SELECT t.idx, count(*) AS events FROM x JOIN (SELECT *, explode(sequence(CAST(floor((end_s - duration_s) * 2) AS BIGINT), CAST(floor(end_s * 2) AS BIGINT))) AS half FROM t) t
              ON x.half = t.half AND at >= end_s - duration_s AND at < end_s GROUP BY t.idx)
        SELECT t.idx, t.name, t.label, t.duration_s, coalesce(events, 0) AS events FROM t LEFT JOIN n USING (idx)""",
        events=spark.read.parquet(f"{sf}/events.parquet"),
    )


@query(f"""WITH {B.SQL}, p(idx, name, d, label) AS (VALUES (0, 'SETTLE', 0.021, NULL), (1, 'REST', 0.041, NULL), (2, 'CLICK 1/2', 0.021, 'CLICK'), (3, 'REST', 0.021, NULL), (4, 'CLICK 2/2', 0.021, 'CLICK'), (5, 'ARTIFACT_NO_LABEL', 0.041, NULL), (6, 'REST', 0.041, NULL)),
q AS (SELECT *, sum(d) OVER (ORDER BY idx)::DOUBLE AS e FROM p), x AS (SELECT session, arrival_seq, t_ms, idx, name, label FROM s JOIN q ON t_ms / 1000::DOUBLE >= e - d AND t_ms / 1000::DOUBLE < e),
y AS (SELECT *, lag(idx) OVER w AS b, lag(name) OVER w AS previous FROM x WINDOW w AS (PARTITION BY session ORDER BY arrival_seq))
SELECT session, t_ms, name, label, previous FROM y WHERE b IS NULL OR b <> idx""")
def prompt_markers(spark, sf):
    """O-REC-1/4, O-PRO-1."""
    script = spark.createDataFrame(protocol.build(settle=0.021, rest=0.041, trials=2, press=0.021, gap=0.021, final_rest=0.041, artifact=0.041), protocol.SCHEMA)
    return protocol.markers(B.samples(spark, sf), script).select("session", "t_ms", "name", "label", "previous")


# Recordings


_OPEN = """fin AS (SELECT session, arg_max(t_ms, arrival_seq) AS final FROM s GROUP BY session), op AS (SELECT * FROM mk QUALIFY lead(type) OVER (PARTITION BY session ORDER BY seq) IS NULL AND type = 'label_start'),
al AS (SELECT session, seq, type, t_ms, NULL AS closed_by FROM mk UNION ALL SELECT session, seq + 1, 'label_end', final, 'session_end' FROM op JOIN fin USING (session))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS line, type, 'CLICK' AS label, t_ms, closed_by FROM al"""


@query(f"""WITH {B.SQL}, mk AS (SELECT session, arrival_seq AS seq, t_ms, CASE row_number() OVER (PARTITION BY session ORDER BY arrival_seq) % 2 WHEN 1 THEN 'label_start' ELSE 'label_end' END AS type FROM s WHERE event_type IN ('click', 'view')), {_OPEN}""")
def toggle_labels(spark, sf):
    """O-REC-2/5, O-ISL-4."""
    samples = B.samples(spark, sf)
    return record.toggle_labels(samples, B.controls(spark, sf), _ends(spark, sf)).drop("phase", "duration_s", "host_time_s")


@query(f"""WITH {B.SQL}, c AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY session ORDER BY arrival_seq), 'view') AS b FROM s WHERE event_type IN ('click', 'view')),
mk AS (SELECT session, arrival_seq AS seq, t_ms, CASE event_type WHEN 'click' THEN 'label_start' ELSE 'label_end' END AS type FROM c WHERE b <> event_type), {_OPEN}""")
def hold_labels(spark, sf):
    """O-REC-3/7."""
    samples = B.samples(spark, sf)
    return record.hold_labels(samples, B.controls(spark, sf), _ends(spark, sf)).drop("phase", "duration_s", "host_time_s")


@query(f"""WITH {B.SQL}, p(idx, name, d, label) AS (VALUES (0, 'SETTLE', 0.021, NULL), (1, 'REST', 0.041, NULL), (2, 'CLICK 1/2', 0.021, 'CLICK'), (3, 'REST', 0.021, NULL), (4, 'CLICK 2/2', 0.021, 'CLICK')),
q AS (SELECT *, sum(d) OVER (ORDER BY idx)::DOUBLE AS e FROM p), x AS (SELECT session, arrival_seq, t_ms, idx, name, label, d FROM s LEFT JOIN q ON t_ms / 1000::DOUBLE >= e - d AND t_ms / 1000::DOUBLE < e),
y AS (SELECT *, lag(label) OVER w AS pl FROM x WINDOW w AS (PARTITION BY session ORDER BY arrival_seq) QUALIFY row_number() OVER w = 1 OR lag(idx) OVER w IS DISTINCT FROM idx),
rr AS (SELECT session, arrival_seq, 0 AS i, 'label_end' AS type, pl AS label, t_ms, NULL AS phase, NULL::DOUBLE AS duration_s, 'phase_transition' AS closed_by FROM y WHERE pl IS NOT NULL
 UNION ALL SELECT session, arrival_seq, 1, CASE WHEN name IS NULL THEN 'prompt_done' ELSE 'prompt_phase' END, label, t_ms, name, d, NULL FROM y
 UNION ALL SELECT session, arrival_seq, 2, 'label_start', label, t_ms, NULL, NULL, NULL FROM y WHERE label IS NOT NULL
 UNION ALL SELECT session, max(arrival_seq) + 1, 9, 'label_end', arg_max(label, arrival_seq), max(f), NULL, NULL, 'session_end' FROM y JOIN (SELECT session, max(t_ms) AS f FROM s GROUP BY session) USING (session) GROUP BY session HAVING max(arrival_seq) = max(arrival_seq) FILTER (label IS NOT NULL))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY arrival_seq, i) AS line, type, label, t_ms, phase, duration_s, closed_by FROM rr""")
def prompt_labels(spark, sf):
    """O-REC-1/4, O-JOIN-9."""
    script = spark.createDataFrame(protocol.build(settle=0.021, rest=0.041, trials=2, press=0.021, gap=0.021, final_rest=0, artifact=0), protocol.SCHEMA)
    return record.prompt_labels(B.samples(spark, sf), script, _ends(spark, sf), done=True).drop("host_time_s")


@query(f"""WITH {B.SQL}, {B.frames_sql('(SELECT * FROM s WHERE arrival_seq % 13 <> 0)')}, g AS (SELECT session, count(*) AS frames FROM fr GROUP BY session), li AS (SELECT session, count(*) // 2 AS a, count(*) % 2 AS b FROM s WHERE event_type IN ('click', 'view') GROUP BY session)
SELECT session, count(*) FILTER (arrival_seq % 13 <> 0) AS samples, coalesce(any_value(frames), 0) AS frames, coalesce(any_value(a + b), 0) AS labels, count(*) FILTER (arrival_seq % 13 = 0) AS parse_errors, arg_max(t_ms, arrival_seq) FILTER (arrival_seq % 13 <> 0) AS final_t_ms
FROM s LEFT JOIN g USING (session) LEFT JOIN li USING (session) GROUP BY session""")
def session_counts(spark, sf):
    """O-AGG-12."""
    lines = B.lines(spark, sf)
    parsed = frames.parsed_lines(lines)
    made = frames.frames(parsed.withColumn("raw", F.col("raw").cast("double")), "raw", B.WINDOW_MS, B.HOP_MS)
    labels = record.toggle_labels(B.samples(spark, sf), B.controls(spark, sf), _ends(spark, sf))
    return record.session_counts(lines, parsed, made, labels)


@query("SELECT user_id AS session, count(*) AS n_lines, round(count(*) / greatest(max(epoch(ts)) - min(epoch(ts)), 1e-6), 9) AS lines_per_s FROM events GROUP BY user_id")
def line_rates(spark, sf):
    """O-AGG-14."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("session"), seconds.alias("host_time_s"))
    return rounded(record.line_rates(rows), "lines_per_s", digits=9)


@query(f"""{_DSP}, z AS (SELECT sr.session, sr.arrival_seq, sr.t_ms, filtered, lf, lf_energy, slope_burst AS burst, rms_state AS level, artifact_ratio, s.raw, s.env FROM sr JOIN s ON s.session = sr.session AND s.arrival_seq = sr.arrival_seq), {B.frames_sql('z', 'filtered', 'lf_energy', 'burst')},
cz AS (SELECT fr.*, (fr.end_ms + 3) // 4 + 1 AS shut FROM fr)
SELECT z.session, z.arrival_seq, frame, coalesce(end_ms, z.t_ms) AS t_ms, coalesce(end_ms - {B.WINDOW_MS}, z.t_ms) AS window_start_ms, z.raw, z.env AS env_in, round(coalesce(cz.filtered_raw_hp, filtered), 4) AS filtered_raw_hp, round(coalesce(cz.rms_state, level), 4) AS rms_state,
 round(coalesce(cz.lf_energy_ratio, artifact_ratio), 4) AS lf_energy_ratio, round(coalesce(cz.slope_burst, burst), 4) AS slope_burst, round(coalesce(cz.waveform_length, 0), 4) AS waveform_length
FROM z LEFT JOIN cz ON cz.session = z.session AND cz.shut = z.arrival_seq""")
def monitor_rows(spark, sf):
    """O-PRJ-20, O-SNK-9."""
    snap = _snapshots(spark, sf)
    rows = snap.drop("raw").withColumnRenamed("filtered", "raw")
    made = frames.frames(rows.drop("segment"), "raw", B.WINDOW_MS, B.HOP_MS, slope="slope_burst", lf="lf_energy")
    found = record.monitor_rows(snap, made, B.WINDOW_MS, B.HOP_MS).drop("window_end_ms")
    return rounded(found, "filtered_raw_hp", "rms_state", "lf_energy_ratio", "slope_burst", "waveform_length", digits=4)


@query()
def rest_learning(spark, sf):
    """O-DSP-16/17; tests hold it against a plain loop."""
    return dsp.rest_learning(B.samples(spark, sf), F.col("event_type") == "view")


# Streams


@query(f"{_RPS}, {_GATE} SELECT session, row_number() OVER (PARTITION BY session ORDER BY i) AS ord, phase, start_ms, end_ms, duration_ms FROM ge0")
def stream_events(spark, sf):
    """O-STR-1/2, O-DEC-9: the same samples as a stream; live runs do not close an open press."""
    return detector.replay_stream(spark, B.samples(spark, sf).select("session", "arrival_seq", "t_ms", "raw", "env"), detector.threshold(5000.0, 800.0), GATE, B.WINDOW_MS, B.HOP_MS, filtered=False)
