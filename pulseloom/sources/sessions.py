"""Recorded sessions: folders with ``raw.csv``, ``features.csv``, ``labels.jsonl`` and ``meta.json`` (O-SRC-*, O-SNK-*).

Each of them may be one file or a folder of parts, as Spark writes it, with a header in every part.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import clean_samples

#: Columns of the files, in their order.
RAW_COLUMNS = ("host_time_s", "t_ms", "raw", "env", "line")
FEATURE_COLUMNS = ("host_time_s", "t_ms", "window_start_ms", "window_end_ms", "env_in", "filtered_raw_hp", "rms_state", "lf_energy_ratio", "slope_burst", "waveform_length")
DEBUG_COLUMNS = ("active", "probability", "down", "up")
RECORD = "type string, label string, host_time_s double, t_ms double, phase string, duration_s double, closed_by string, samples bigint, frames bigint, features bigint, labels bigint, parse_errors bigint"


def usable(session: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Sessions that evaluation takes: no leading underscore, no ``bad`` in the name, none of ``exclude`` in it (O-SRC-10)."""
    out = ~session.startswith("_") & ~F.contains(F.lower(session), F.lit("bad"))
    for x in exclude:
        out = out & ~F.contains(session, F.lit(x))
    return out


def _lines(spark: SparkSession, root: str, glob: str, name: str) -> DataFrame:
    """``(session, __file, __at, line)``: lines in order of ``__at`` within a file. Large files are read in splits; a
    line's place is that of its split and then its number as it is read."""
    rows = spark.read.text(f"{root}/{{session=,}}{glob}/{{file=,}}{name}").select(
        "value", F.col("_metadata.file_path").alias("__file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("__at")
    )
    session = F.regexp_extract("__file", r"([^/]+)/(?:file=)?" + name.replace(".", r"\.") + r"(?:/[^/]*)?$", 1)
    session = F.regexp_replace(session, "^session=", "")
    return rows.select(F.url_decode(session).alias("session"), "__file", "__at", F.regexp_replace("value", "\r$", "").alias("line"))


def _cells(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """CSV lines by the names in each file's own header; a column that is not there is null. With ``arrival_seq``."""
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(F.nullif(c, F.lit("")))
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.col("line")), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), plain)
    cut = rows.where("trim(line) != ''").select("session", "__file", "__at", cells.alias("cells"))
    w = Window.partitionBy("session", "__file").orderBy("__at")
    headed = cut.withColumns({"head": F.first("cells").over(w), "n": F.row_number().over(w)}).where("n > 1")
    picked = headed.select("session", "__file", "__at", *[F.get("cells", F.array_position(F.transform("head", lambda x: F.coalesce(x, F.lit(""))), c).cast("int") - 1).alias(c) for c in columns])
    order = Window.partitionBy("session").orderBy("__file", "__at")
    return picked.withColumn("arrival_seq", F.row_number().over(order).cast("bigint")).drop("__file", "__at")


def session_names(spark: SparkSession, root: str, glob: str = "*", exclude: tuple[str, ...] = (), first: str = "raw.csv", check: bool = True) -> list[str]:
    """Names, sorted, of the folders that have both ``first`` and ``labels.jsonl`` (O-SRC-9/10): listed by the file
    system that ``root`` is on, names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    wanted = lambda n: fnmatchcase(n, glob) and not n.startswith("_") and not (check and ("bad" in n.lower() or any(x and x in n for x in exclude)))
    has = lambda n, f: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/{f}"))
    return sorted(n for n in names if wanted(n) and has(n, first) and has(n, "labels.jsonl"))


def read_raw(spark: SparkSession, root: str, glob: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Samples of all usable sessions, by the header's names; rows that are no numbers are dropped (O-SRC-6)."""
    rows = _lines(spark, root, glob, "raw.csv").where(usable(F.col("session"), exclude))
    return clean_samples(_cells(rows, ("t_ms", "raw", "env")))


def read_features(spark: SparkSession, root: str, features: tuple[str, ...], glob: str = "*") -> DataFrame:
    """``(session, arrival_seq, t_ms, features..)``, by the header's names; a cell that is no number fails the job
    (O-SRC-7)."""
    rows = _cells(_lines(spark, root, glob, "features.csv").where(~F.col("session").startswith("_")), ("t_ms", *features))
    number = lambda c: F.coalesce(F.trim(c).cast("double"), F.raise_error(F.concat(F.lit(f"no number in {c}: "), F.coalesce(F.col(c), F.lit("null")))).cast("double"))
    return rows.select("session", "arrival_seq", number("t_ms").cast("bigint").alias("t_ms"), *[number(f).alias(f) for f in features])


def read_labels(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(session, line, type, ..)`` of all label records, times as whole numbers (O-SRC-8); a broken line fails."""
    rows = _lines(spark, root, glob, "labels.jsonl").where("trim(line) != ''")
    w = Window.partitionBy("session").orderBy("__file", "__at")
    parsed = rows.select("session", F.row_number().over(w).cast("bigint").alias("n"), F.from_json("line", RECORD, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("session", F.col("n").alias("line"), "r.*").withColumn("t_ms", F.col("t_ms").cast("bigint"))


def label_intervals_of(records: DataFrame) -> DataFrame:
    return records.select("session", "line", "type", "t_ms")


def markers_of(records: DataFrame) -> DataFrame:
    """Phase markers for ``islands.phase_windows``."""
    return records.where("type = 'prompt_phase'").select("session", "line", F.coalesce("phase", F.lit("")).alias("name"), "label", "t_ms", "duration_s")


def default_name(now: datetime | None = None) -> str:
    """A session's name where none is given (O-SNK-11)."""
    return (now or datetime.now()).strftime("%Y%m%d-%H%M%S")


def meta(port: str, baud: int, label_mode: str, label: str, source: str, label_keys: list[str] | None = None, label_key: str | None = None, quit_key: str | None = None, notes: str = "") -> str:
    """``meta.json`` (O-SNK-10): what a session must say, and what is given."""
    body = {
        "schema_version": 1, "created_at_utc": datetime.now(timezone.utc).isoformat(), "port": port, "baud": baud, "serial_contract": "t raw env", "label_schema": "interval_v1",
        "label_mode": label_mode, "label": label, "source": source, "files": {"raw": "raw.csv", "features": "features.csv", "labels": "labels.jsonl"},
    }
    optional = {"label_keys": label_keys, "label_key": label_key, "quit_key": quit_key, "notes": notes or None}
    return json.dumps(body | {k: v for k, v in optional.items() if v is not None}, indent=2)


def write_session(path: str, raw: DataFrame, features: DataFrame, labels: DataFrame, described: str, order: tuple[str, ...] = ("t_ms",)) -> None:
    """One session's folder (O-SNK-1): ``raw.csv``, ``features.csv`` (headers and columns as fixed), ``labels.jsonl`` and
    ``meta.json``, each one file. An existing folder is an error. ``labels`` come with ``line``, their order."""
    spark = raw.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    line = lambda columns: F.to_csv(F.struct(*columns)).alias("value")
    shown = [*FEATURE_COLUMNS, *[c for c in DEBUG_COLUMNS if c in features.columns]]
    one_file(raw.orderBy("arrival_seq").select(line(RAW_COLUMNS)), f"{path}/raw.csv", ",".join(RAW_COLUMNS) + "\n")
    one_file(features.orderBy(*order).select(line(shown)), f"{path}/features.csv", ",".join(shown) + "\n")
    records = labels.orderBy("line").drop("session", "line")
    one_file(records.select(F.to_json(F.struct(*records.columns)).alias("value")), f"{path}/labels.jsonl")
    one_file(spark.createDataFrame([], "value string"), f"{path}/meta.json", described)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def one_file(lines: DataFrame, path: str, head: str = "") -> None:
    """``lines(value)``, in their order, as one text file after ``head``: tasks write parts beside it, whose bytes are put
    one after another on the file system that ``path`` is on. The file has its name once it is whole."""
    spark = lines.sparkSession
    fs_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    parts, made, target = (fs_path(f"{path}{x}") for x in (".parts", ".new", ""))
    fs = target.getFileSystem(conf)
    lines.write.mode("overwrite").text(parts.toString())
    out = fs.create(made)
    try:
        out.write(bytearray(head.encode()))
        for status in sorted(fs.listStatus(parts), key=lambda x: x.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                given = fs.open(status.getPath())
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, conf, False)
                finally:
                    given.close()
    finally:
        out.close()
    fs.rename(made, target)
    # Other tools may change the file, so it must not have a checksum of what it was.
    fs.delete(fs_path(target.getParent(), f".{target.getName()}.crc"), False)
    fs.delete(parts, True)


def write_rows(rows: DataFrame, root: str, name: str, order: tuple[str, ...]) -> None:
    """Rows of many sessions as CSV, in folders ``session=.../file=name`` that the readers know too; one shuffle."""
    placed = rows.withColumn("file", F.lit(name)).repartition("session").sortWithinPartitions("session", *order)
    placed.write.mode("error").option("header", True).partitionBy("session", "file").csv(root)


def write_json_lines(events: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out (O-SNK-2)."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("error").text(path)


def report(rows: list[dict]) -> str:
    """CSV text of rows under the sorted union of their keys; no rows, no text (O-SNK-6)."""
    import csv
    import io

    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, sorted({k for r in rows for k in r}))
        writer.writeheader()
        writer.writerows(rows)
    return out.getvalue()
