"""The library's functions for SQL: ``register(spark)``, then ``SELECT parse_line(line)``, ``lower_percentile(xs, 0.9)``
or ``SELECT * FROM build_protocol(trials => 3)`` (O-PRJ-1, O-AGG-5, O-PRO-1). They are SQL themselves, so that the
optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .columns import INTEGER

_NUMBER = f"if(get(t, %d) RLIKE r'{INTEGER}', try_cast(replace(get(t, %d), '_', '') AS BIGINT), NULL)"
_PHASE = "named_struct('name', {}, 'duration_s', {}, 'label', CAST({} AS STRING), 'always', {})"

PARSE_LINE = f"""CREATE OR REPLACE TEMPORARY FUNCTION parse_line(line STRING) RETURNS STRUCT<t_ms: BIGINT, raw: BIGINT, env: BIGINT>
COMMENT 'Three whole numbers between white space; null for any other line.'
RETURN get(transform(
  transform(array(split(regexp_replace(line, r'^\\s+|\\s+$', ''), r'\\s+')), t -> if(size(t) = 3, named_struct('t_ms', {_NUMBER % (0, 0)}, 'raw', {_NUMBER % (1, 1)}, 'env', {_NUMBER % (2, 2)}), NULL)),
  p -> if(p.t_ms IS NOT NULL AND p.raw IS NOT NULL AND p.env IS NOT NULL, p, NULL)), 0)"""

LOWER_PERCENTILE = """CREATE OR REPLACE TEMPORARY FUNCTION lower_percentile(xs ARRAY<DOUBLE>, share DOUBLE) RETURNS DOUBLE
COMMENT 'The value at rank int((n - 1) * share); 0 for an empty array.'
RETURN coalesce(get(array_sort(xs), greatest(CAST(floor((size(xs) - 1) * share) AS INT), 0)), 0.0D)"""

BUILD_PROTOCOL = f"""CREATE OR REPLACE TEMPORARY FUNCTION build_protocol(
  settle DOUBLE DEFAULT 5, rest DOUBLE DEFAULT 20, trials INT DEFAULT 20, press DOUBLE DEFAULT 1, gap DOUBLE DEFAULT 3, final_rest DOUBLE DEFAULT 10, artifact DOUBLE DEFAULT 0)
RETURNS TABLE(idx BIGINT, name STRING, duration_s DOUBLE, label STRING)
COMMENT 'The phases of a prompted recording: optional parts only where they last, clicks always.'
RETURN SELECT inline(transform(filter(concat(
    array({_PHASE.format("'SETTLE'", "settle", "NULL", "false")}, {_PHASE.format("'REST'", "rest", "NULL", "false")}),
    if(trials > 0, flatten(transform(sequence(1, greatest(trials, 1)), i -> array(
      {_PHASE.format("concat('CLICK ', i, '/', trials)", "press", "'CLICK'", "true")}, {_PHASE.format("'REST'", "if(i < trials, gap, 0D)", "NULL", "false")}))), array()),
    array({_PHASE.format("'ARTIFACT_NO_LABEL'", "artifact", "NULL", "false")}, {_PHASE.format("'REST'", "final_rest", "NULL", "false")})),
  x -> x.always OR x.duration_s > 0),
  (x, i) -> named_struct('idx', CAST(i AS BIGINT), 'name', x.name, 'duration_s', x.duration_s, 'label', x.label)))"""


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; doing so again changes nothing."""
    for statement in (PARSE_LINE, LOWER_PERCENTILE, BUILD_PROTOCOL):
        spark.sql(statement)
