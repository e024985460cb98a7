"""Column functions: parsing, scoring, normalising and robust statistics (O-PRJ-*, O-AGG-5..7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an integer of a line may look like, underscores between digits included.
INTEGER = r"^[+-]?\d+(_\d+)*$"


def parse_line(line: Column) -> Column:
    """``struct<t_ms, raw, env>`` of a line of three whole numbers between white space; null for any other (O-PRJ-1)."""
    tokens = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    number = lambda i: F.when(F.get(tokens, i).rlike(INTEGER), F.regexp_replace(F.get(tokens, i), "_", "").try_cast("bigint"))
    parsed = F.struct(number(0).alias("t_ms"), number(1).alias("raw"), number(2).alias("env"))
    whole = parsed["t_ms"].isNotNull() & parsed["raw"].isNotNull() & parsed["env"].isNotNull()
    return F.when((F.size(tokens) == 3) & whole, parsed)


def whole_number(text: Column) -> Column:
    """A number cut to its whole part, as text; null where it is none, infinite or not a number (O-SRC-6)."""
    number = F.trim(text).try_cast("double")
    kept = ~F.isnan(number) & (F.abs(number) < 9.2e18)
    return F.when(kept, number).cast("bigint")


def stable_sigmoid(x: Column) -> Column:
    """O-PRJ-9; neither branch overflows."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def threshold_score(value: Column, threshold: Column | float, softness: Column | float) -> Column:
    """O-PRJ-10."""
    soft = F.greatest(F.lit(softness) if not isinstance(softness, Column) else softness, F.lit(1e-6))
    return stable_sigmoid((value - threshold) / soft)


def normalise(value: Column, center: Column, scale: Column, floor: Column) -> Column:
    """O-PRJ-7: missing statistics are 0, 1 and 1."""
    return (value - F.coalesce(center, F.lit(0.0))) / F.greatest(F.coalesce(scale, F.lit(1.0)), F.coalesce(floor, F.lit(1.0)))


def logreg_score(values: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    """O-PRJ-11: the shorter of values and weights decides how many count."""
    total = F.lit(0.0)
    for v, w in zip(values, weights):
        total = total + v * F.lit(float(w))
    return stable_sigmoid(total + F.lit(float(bias)))


def feature_hash(order: Sequence[str] | Column) -> Column:
    """O-PRJ-6."""
    names = order if isinstance(order, Column) else F.array(*[F.lit(x) for x in order])
    return F.sha2(F.array_join(names, "|"), 256)


def lower_percentile(values: Column, share: float) -> Column:
    """The value at rank ``int((n - 1) * share)`` of an array; 0 for an empty one (O-AGG-5)."""
    at = F.floor((F.size(values) - 1) * F.lit(share)).cast("int")
    return F.coalesce(F.get(F.array_sort(values), F.greatest(at, F.lit(0))), F.lit(0.0))


def array_median(values: Column) -> Column:
    """Mean of the middle two; null for an empty array (O-AGG-4)."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def robust_scale(values: Column, floor: float) -> Column:
    """``max(p90 - p50, 1.4826 MAD, floor)`` of an array, with lower-rank percentiles (O-DSP-15)."""
    centre = lower_percentile(values, 0.5)
    mad = array_median(F.transform(values, lambda x: F.abs(x - centre)))
    return F.coalesce(F.greatest(lower_percentile(values, 0.9) - centre, mad * 1.4826, F.lit(floor)), F.lit(floor))


def per_minute(count: Column, seconds: Column) -> Column:
    """O-PRJ-17; 0 where there is no time."""
    return F.when(seconds > 0, count / (seconds / 60.0)).otherwise(F.lit(0.0))


def is_artifact(name: Column) -> Column:
    return F.contains(F.upper(name), F.lit("ARTIFACT"))


def is_rest(name: Column, label: Column) -> Column:
    """O-PRJ-15."""
    return label.isNull() & ~is_artifact(name)
