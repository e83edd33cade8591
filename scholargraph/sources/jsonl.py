"""JSON-lines person dumps (plain or gzip) into validated rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scholargraph import schemas
from scholargraph.functions.text import php_empty, strip_ws
from scholargraph.session import cut_lineage

NAME_MAX = 512


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw lines with a sequence number that follows file order.

    ``seq`` = (file path, block start, position in block), so "later line
    wins" holds across files and splits. A gzip file is one split: the
    lines are re-spread over ``partitions`` right after the scan so parsing
    runs in parallel.
    """
    raw = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )
    if path.endswith(".gz") or partitions:
        raw = raw.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return raw


def scan_jsonl(lines: DataFrame, schema: str = schemas.PERSON) -> DataFrame:
    """Trim lines, skip blank ones, drop lines that are not JSON.

    ``lines(value, seq)`` -> ``(seq, line, rec)`` with ``rec`` decoded by
    ``schema``. A line that is valid JSON but not an object decodes to a
    record of nulls (the id check in S2 rejects it).
    """
    t = lines.select("seq", strip_ws("value").alias("line")).where(F.col("line") != "")
    return t.where(F.try_parse_json("line").isNotNull()).select(
        "seq", "line", F.from_json("line", schema).alias("rec")
    )


def _checked(lines: DataFrame, schema: str, name_max: int | None) -> DataFrame:
    """Every line that is not blank, with its id, name and why it is rejected (null: it is valid)."""
    t = lines.select("seq", strip_ws("value").alias("line")).where(F.col("line") != "")
    rec = F.from_json("line", schema)
    name = rec["fullName"]
    t = t.select("seq", "line", F.try_parse_json("line").isNotNull().alias("_ok"), rec["id"].alias("id"),
                 (F.substring(name, 1, name_max) if name_max else name).alias("fullName"))
    reason = F.when(~F.col("_ok"), F.lit("undecodable")).when(php_empty("id"), F.lit("empty id"))
    return t.withColumn("reason", reason).drop("_ok")


def import_persons(lines: DataFrame, schema: str = schemas.PERSON, name_max: int | None = NAME_MAX) -> tuple[DataFrame, DataFrame]:
    """Split lines into valid person rows and rejects.

    Valid: decodes and has a non-empty id (null, '' and '0' are empty).
    Output valid ``(seq, id, fullName, data)`` with the trimmed line as
    ``data``, which keeps the whole name; ``fullName`` is cut to ``name_max``
    characters, the width of the person table's column (None: not cut); rejects ``(seq, line,
    reason)``. Blank lines are neither.
    """
    t = _checked(lines, schema, name_max)
    return _split(t)


def _split(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = t.where(F.col("reason").isNull()).select("seq", "id", "fullName", F.col("line").alias("data"))
    return valid, t.where(F.col("reason").isNotNull()).select("seq", "line", "reason")


def split_lines(lines: DataFrame, schema: str = schemas.PERSON, name_max: int | None = NAME_MAX) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S2 and A7 in one pass over the lines: ``(valid, rejects, counters)``.

    The checked lines are written once (both outputs read them); ``imported``
    and ``skipped`` are observed by that job while it writes, so nothing is
    scanned or grouped for them.
    """
    seen = Observation()
    skipped = F.col("reason").isNotNull()
    watched = _checked(lines, schema, name_max).observe(seen, F.count_if(~skipped).alias("imported"), F.count_if(skipped).alias("skipped"))
    valid, rejects = _split(cut_lineage(watched, "checked-lines"))
    counters = [(name, int(n)) for name, n in seen.get.items() if n]
    return valid, rejects, lines.sparkSession.createDataFrame(counters, "counter string, n bigint")


def import_counters(valid: DataFrame, rejects: DataFrame) -> DataFrame:
    """A7 for the import job: imported and skipped line counts."""
    return valid.select(F.lit("imported").alias("counter")).unionByName(
        rejects.select(F.lit("skipped").alias("counter"))
    ).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
